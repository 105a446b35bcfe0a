"""Language-model scoring with a log-frequency Bloom filter.

A bigram model of the training texts.  The count of every bigram is quantised
to a level, and the events (bigram, 1) .. (bigram, level) are put into a Bloom
filter; so is, for every context word, the level of its number of distinct
followers.  A level is read back by probing (key, 1), (key, 2), (key, 4), ... until
the first miss, and then between.  Counts of single tokens are kept exactly, as the base score asks
for them.  The filter is made in parts (by context word; words too frequent
for one part by bigram), each sized by its own number of events, so that it
grows with the corpus; parts are broadcast in groups of bounded bytes, and
where there are several groups the texts are read once for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import held_out, table
from hearth.llm.registry import register
from hearth.llm.words import Cutter, Tally, mix, pair, slices
from hearth.session import cut_lineage

END, BEGIN, FOLLOWERS = (np.uint64(x) for x in (0xE0D0E0D0E0D0E0D1, 0xB0E6B0E6B0E6B0E7, 0xF0110F0110F01103))
PROBES = 6          # bits per event
BITS = 12           # filter bits for each event: one false hit in about 270
STEP = 1.25         # growth of the quantisation's steps


@cache
def steps() -> np.ndarray:
    """Least count of each level: 1, 2, 3, ... and from there growing by ``STEP``."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return np.array(out, np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(steps(), counts, side="right")


class Tokens:
    """Hashes of the tokens of texts: the words, then one end each."""

    def __init__(self):
        self.cutter = Cutter()

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(token hashes of all texts, index of each text's first token)."""
        words = self.cutter.cut(texts)
        counts = np.bincount(words.owner, minlength=len(texts)) + 1
        stops = np.cumsum(counts)
        tokens = np.full(int(stops[-1]) if len(stops) else 0, END, np.uint64)
        tokens[np.arange(len(words.hashes)) + words.owner] = words.hashes
        return tokens, stops - counts


def contexts(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = BEGIN
    return before


class Parts:
    """Which part holds what: a context word's bigrams lie together, those of a
    ``hot`` word (sorted hashes) are dealt out bigram by bigram."""

    def __init__(self, count: int, hot: np.ndarray):
        self.count, self.hot = np.uint64(count), hot

    def is_hot(self, context: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(context), bool)
        at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
        return self.hot[at] == context

    def of(self, context: np.ndarray, bigram: np.ndarray) -> np.ndarray:
        return (mix(np.where(self.is_hot(context), bigram, context)) % self.count).astype(np.int64)


def _events(keys: np.ndarray, level: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + level * np.uint64(0x9E3779B97F4A7C15))


def _positions(events: np.ndarray, size: np.ndarray | np.uint64, probe: int) -> np.ndarray:
    low = np.uint64(0xFFFFFFFF)
    spot = ((events & low) + np.uint64(probe) * ((events >> np.uint64(32)) | np.uint64(1))) & low
    return (spot * size) >> np.uint64(32)


def fill(keys: np.ndarray, levels: np.ndarray) -> tuple[bytes, int]:
    """A filter part with the events of all keys, and its number of bits."""
    size = -(-max(64, int(levels.sum()) * BITS) // 8) * 8
    if size >= 1 << 32:
        raise ValueError("a filter part has too many events: use smaller parts")
    bits = np.zeros(size // 8, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        events = _events(keys[levels >= level], np.uint64(level))
        for probe in range(PROBES):
            at = _positions(events, np.uint64(size), probe)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return bits.tobytes(), size


def read_levels(bits: np.ndarray, offset: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Level of each key whose part begins at byte ``offset`` and has ``size`` bits.  All levels
    up to a key's own are there, so a miss bounds it: levels 1, 2, 4, 8, ... are probed until
    the first miss, then the levels between by halving."""
    def there(at: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Which of the keys ``at`` have ``level``."""
        found, live, events = np.zeros(len(at), bool), np.arange(len(at)), _events(keys[at], level)
        for probe in range(PROBES):
            spot = _positions(events, size[at[live]], probe)
            hit = (bits[offset[at[live]] + (spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live, events = live[hit], events[hit]
        found[live] = True
        return found
    most = len(steps()) + 1
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), most)
    live, level = np.arange(len(keys)), 1
    while len(live) and level < most:
        hit = there(live, np.full(len(live), level, np.uint64))
        low[live[hit]], high[live[~hit]] = level, level
        live, level = live[hit], level * 2
    open_keys = np.flatnonzero(high - low > 1)
    while len(open_keys):
        middle = (low[open_keys] + high[open_keys]) // 2
        hit = there(open_keys, middle.astype(np.uint64))
        low[open_keys[hit]], high[open_keys[~hit]] = middle[hit], middle[~hit]
        open_keys = open_keys[high[open_keys] - low[open_keys] > 1]
    return low


@dataclass
class Model:
    """What training gives: totals, exact token counts ``vocabulary(w, c)`` and the
    filter ``parts(part, size, bits)`` as checkpointed tables; per part and per hot
    word one number on the driver (both at most tokens / ``part_tokens``)."""
    tokens: int
    distinct: int
    texts: int
    vocabulary: DataFrame
    parts: DataFrame
    sizes: np.ndarray
    hot: np.ndarray
    hot_followers: np.ndarray


def train(docs: DataFrame, part_tokens: int = 200_000) -> Model:
    """Model of all rows of ``docs(text)``; a null text is an empty one (its end token
    counts).  Repeated rows count as often as they stand there.  No rows: a model
    that gives every text probability 1 per token (0 in logarithms).

    Tokens are known by 64-bit hashes: two words of a vocabulary of 10^7 share one with a
    probability of 3 in a million."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, tally = Tokens(), Tally(1 << 19)

        def out(got):
            for keys, counts, _ in got:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["w", "c"])
        for batch in batches:
            for part in slices(batch):
                tokens, _ = machine.of(part.column("text").to_pylist())
                yield from out(tally.add(tokens, tokens))
        yield from out(tally.rest())
    vocabulary = cut_lineage(texts.mapInArrow(count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    end = int(END.view(np.int64))
    total = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("w") == end, F.col("c"))).alias("t")).first()
    n, distinct, rows = total["n"] or 0, total["v"], total["t"] or 0
    hot = np.sort(np.array([r["w"] for r in vocabulary.where((F.col("c") > part_tokens) & (F.col("w") != end)).select("w").collect()]
                           + ([int(BEGIN.view(np.int64))] if rows > part_tokens else []), np.int64).view(np.uint64))
    parts = Parts(max(1, -(-n // part_tokens)), hot)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, tally = Tokens(), Tally(1 << 19)

        def out(got):
            for keys, counts, before in got:
                where = parts.of(before, keys)
                order = np.lexsort((before, where))
                where, keys, counts, before = where[order], keys[order], counts[order], before[order]
                cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
                packed = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    words, runs = np.unique(before[a:b], return_counts=True)
                    packed.append(np.array([len(words)], np.int64).tobytes() + words.tobytes() + runs.astype(np.uint32).tobytes()
                                  + keys[a:b].tobytes() + counts[a:b].astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]]), pa.array(packed, pa.binary())], ["part", "packed"])
        for batch in batches:
            for part in slices(batch):
                tokens, starts = machine.of(part.column("text").to_pylist())
                before = contexts(tokens, starts)
                yield from out(tally.add(pair(before, tokens), before))
        yield from out(tally.rest())

    def make_part(key: tuple, rows: pa.Table) -> pa.Table:
        before, keys, counts = [], [], []
        for cell in rows.column("packed"):
            buffer = cell.as_py()
            m = int(np.frombuffer(buffer, np.int64, 1)[0])
            words, runs = np.frombuffer(buffer, np.uint64, m, 8), np.frombuffer(buffer, np.uint32, m, 8 + 8 * m)
            k, at = int(runs.sum()), 8 + 12 * m
            before.append(np.repeat(words, runs))
            keys.append(np.frombuffer(buffer, np.uint64, k, at))
            counts.append(np.frombuffer(buffer, np.int64, k, at + 8 * k))
        whole = Tally()
        whole.held = [(np.concatenate(keys), np.concatenate(counts), np.concatenate(before))]
        (bigrams, sums, before), = whole.rest()
        words, followers = np.unique(before, return_counts=True)
        hot_here = parts.is_hot(words)
        bits, size = fill(np.concatenate([bigrams, words[~hot_here] ^ FOLLOWERS]),
                          level_of(np.concatenate([sums, followers[~hot_here]])))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([size], pa.int64()), "bits": pa.array([bits], pa.binary()),
                         "hot": pa.array([words[hot_here].view(np.int64)], pa.list_(pa.int64())),
                         "followers": pa.array([followers[hot_here].astype(np.int64)], pa.list_(pa.int64()))})
    made = cut_lineage(texts.mapInArrow(count_pairs, "part long, packed binary").groupBy("part")
                       .applyInArrow(make_part, "part long, size long, bits binary, hot array<long>, followers array<long>"))
    sizes = np.full(int(parts.count), 64, np.int64)
    for r in made.select("part", "size").collect():
        sizes[r["part"]] = r["size"]
    many = {r["h"]: r["t"] for r in made.select(F.explode(F.arrays_zip("hot", "followers")).alias("x"))
            .groupBy(F.col("x.hot").alias("h")).agg(F.sum("x.followers").alias("t")).collect()}
    return Model(n, distinct, rows, vocabulary, made.select("part", "size", "bits"), sizes, hot,
                 np.array([many.get(int(h), 0) for h in hot.view(np.int64)], np.int64))


def _groups(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of parts of at most ``most`` bytes together (one part at least)."""
    out, start, held = [], 0, 0
    for i, size in enumerate(sizes // 8):
        if i > start and held + size > most:
            out.append((start, i))
            start, held = i, 0
        held += int(size)
    return out + [(start, len(sizes))]


def _filter(model: Model, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the parts ``first`` .. ``last`` - 1 and where each begins."""
    starts = np.concatenate([[0], np.cumsum(model.sizes[first:last] // 8)])
    bits = np.zeros(int(starts[-1]), np.uint8)
    for r in model.parts.where(F.col("part").between(first, last - 1)).select("part", "bits").toLocalIterator():
        at = int(starts[r["part"] - first])
        bits[at:at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return bits, starts[:-1]


def _counts(model: Model, k: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every ``of``-th part of the vocabulary: sorted hashes and counts of the repeated
    tokens, sorted hashes of those that occur once."""
    w, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    mine = model.vocabulary.where(F.pmod(F.xxhash64("w"), F.lit(of)) == k) if of > 1 else model.vocabulary
    packed = mine.mapInArrow(_pack, "w binary, c binary")
    for r in packed.toLocalIterator():
        w.append(np.frombuffer(r["w"], np.int64))
        c.append(np.frombuffer(r["c"], np.int64))
    words, counts = np.concatenate(w).view(np.uint64), np.concatenate(c)
    w.clear()
    c.clear()
    if counts.max(initial=0) < 1 << 32:
        counts = counts.astype(np.uint32)
    once = np.sort(words[counts == 1])
    words, counts = words[counts > 1], counts[counts > 1]
    order = np.argsort(words)
    return words[order], counts[order], once


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(x).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for x in ("w", "c")], ["w", "c"])


def score(docs: DataFrame, model: Model, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of ``docs(doc_id, text)``.

    A token of count c after context h of count c(h) with T(h) distinct followers has
    ``(D + T * P1) / (c(h) + T)``: D the least count of the level read for the
    bigram (never over c(h) or c), T likewise, ``P1 = (c + 1) / (N + V + 1)``; after an
    unknown word it is P1.  The levels round down and c(h) is exact, so the
    probabilities of all followers sum to one at most, but for false hits of the filter.
    Null text: empty, one end token.  Rows come back as often as they stand there; no rows: none.

    What is broadcast at once is at most ``broadcast_bytes`` of filter and as much
    vocabulary; beyond it the rows are checkpointed and read once more for every further
    group, with the same result."""
    sc = docs.sparkSession.sparkContext
    vocabulary_groups = max(1, -(-model.distinct * 16 // broadcast_bytes))
    groups = _groups(model.sizes, broadcast_bytes)
    parts, hot, hot_followers, sizes = Parts(len(model.sizes), model.hot), model.hot, model.hot_followers, model.sizes
    n, v, texts = model.tokens, model.distinct, model.texts
    least = np.concatenate([[0], steps()])
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.lit(None).cast("binary").alias("uni"), F.lit(0.0).alias("score"))

    def look_up(words: np.ndarray, counts: np.ndarray, once: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(tokens, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        for known, values in ((words, counts), (once, None)):
            if len(known):
                at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                hit = known[at] == distinct
                out[hit] = 1 if values is None else values[at[hit]]
        return out[back]

    def unigrams(shared) -> Callable:
        """Adds the counts of the tokens that this part of the vocabulary knows to ``uni``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, known = Tokens(), shared.value
            for batch in batches:
                for part in slices(batch):
                    tokens, starts = machine.of(part.column("text").to_pylist())
                    got, ends = look_up(*known, tokens), [*starts[1:], len(tokens)]
                    old = part.column("uni").to_pylist()
                    new = [(got[a:b] + (np.frombuffer(o, np.int64) if o else 0)).astype(np.int64).tobytes() for a, b, o in zip(starts, ends, old)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(new, pa.binary()), part.column("score")],
                                                     ["doc_id", "text", "uni", "score"])
        return run

    def bigrams(shared, first: int, last: int, last_pass: bool) -> Callable:
        """Adds the logarithms of the tokens whose bigram lies in the parts ``first`` .. ``last`` - 1."""
        def sums(x, starts):
            return np.add.reduceat(x, starts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine, (bits, offsets, vocabulary) = Tokens(), shared.value
            for batch in batches:
                for part in slices(batch):
                    tokens, starts = machine.of(part.column("text").to_pylist())
                    if vocabulary is not None:
                        c = look_up(*vocabulary, tokens)
                    else:
                        c = np.concatenate([np.frombuffer(u, np.int64) for u in part.column("uni").to_pylist()])
                    before, c_before = contexts(tokens, starts), np.empty_like(c)
                    c_before[1:] = c[:-1]
                    c_before[starts] = texts
                    keys = pair(before, tokens)
                    where = parts.of(before, keys)
                    p1 = (c + 1) / (n + v + 1)
                    p = p1.copy()
                    mine = np.flatnonzero((where >= first) & (where < last) & (c_before > 0))
                    spot, size = offsets[where[mine] - first], sizes[where[mine]].astype(np.uint64)
                    known = np.flatnonzero(c[mine] > 0)
                    d = np.zeros(len(mine), np.int64)
                    # each bigram once: the frequent ones have the most levels to read
                    asked, one, back = np.unique(keys[mine][known], return_index=True, return_inverse=True)
                    d[known] = least[read_levels(bits, spot[known][one], size[known][one], asked)][back]
                    d = np.minimum(d, np.minimum(c[mine], c_before[mine]))
                    t, is_hot = np.zeros(len(mine), np.int64), parts.is_hot(before[mine])
                    if is_hot.any():
                        t[is_hot] = hot_followers[np.searchsorted(hot, before[mine][is_hot])]
                    cold = np.flatnonzero(~is_hot)
                    if len(cold):
                        words, one, back = np.unique(before[mine][cold], return_index=True, return_inverse=True)
                        t[cold] = least[read_levels(bits, spot[cold][one], size[cold][one], words ^ FOLLOWERS)][back]
                    t = np.minimum(np.maximum(t, 1), c_before[mine])
                    p[mine] = (d + t * p1[mine]) / (c_before[mine] + t)
                    own = np.zeros(len(tokens), bool)
                    own[(where >= first) & (where < last)] = True
                    total = sums(np.where(own, np.log10(p), 0.0), starts) + part.column("score").to_numpy()
                    if last_pass:
                        out = [part.column("doc_id"), pa.array(sums(np.ones(len(tokens), np.int64), starts)),
                               pa.array(sums((c > 0).astype(np.int64), starts)), pa.array(sums(np.log10(p1), starts)), pa.array(total)]
                        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                    else:
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), part.column("uni"), pa.array(total)],
                                                         ["doc_id", "text", "uni", "score"])
        return run

    def passed(rows: DataFrame, make: Callable, data: tuple, schema: str) -> DataFrame:
        """One reading of the rows; what was broadcast for it is released."""
        shared = sc.broadcast(data)
        out = cut_lineage(rows.mapInArrow(make(shared), schema))
        shared.destroy()
        return out
    carried, vocabulary = "doc_id long, text string, uni binary, score double", None
    if vocabulary_groups == 1:
        vocabulary = _counts(model, 0, 1)
    else:
        for k in range(vocabulary_groups):
            state = passed(state, unigrams, _counts(model, k, vocabulary_groups), carried)
    for i, (first, last) in enumerate(groups):
        final = i == len(groups) - 1
        schema = "doc_id long, n_tokens long, n_known long, base_score double, score double" if final else carried
        state = passed(state, lambda shared: bigrams(shared, first, last, final), (*_filter(model, first, last), vocabulary), schema)
    return state


@register("op11_lm_scoring")
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document under the model of those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"), 7, 2)))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known",
                                     F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
