"""Phrase collocation mining by best-first branch-and-bound growth.

A phrase's score is its lowest ``1000 * a * n / (l * r)`` over all cuts into two
parts, and ``a`` is at most either part's count, so no phrase scores more than
``1000 * n / f`` of any of its prefixes or suffixes: the count of the first word
bounds all that can grow from it, the count of the last word all that ends
there.  Words enter the frontier in order of that bound, rarest first.  A round
counts the phrases that begin or end with a word new in the frontier, growing
frequent prefixes (or suffixes) word by word; then the phrases with both ends in the
frontier are scored exactly.  A language is settled when its ``top``-th surviving
score is above the bound of every word outside the frontier; the others go on
with a wider frontier, at the last with all words.

Growth is steered by hashed bit tables of fixed size (a false hit only costs a
count); what is scored are counts of the phrases themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearth.llm.common import table
from hearth.llm.registry import register
from hearth.llm.words import Cutter, Tally, Words, pair, slices
from hearth.session import cut_lineage

LONGEST = 5
SHARES = (1 / 64, 1 / 4, 1.0)   # of all word occurrences, that the frontier may hold, round by round
# lower case for A-Z, one byte for all that ends a piece
_BREAK = 10
_FOLD = bytes(_BREAK if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def lang_hashes(langs: list[str]) -> np.ndarray:
    import xxhash
    known = {x: xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


class Pieces:
    """Words of texts in order, and which of them follow their neighbour in the same piece."""

    def __init__(self):
        self.cutter = Cutter(b"\n \t", _FOLD)

    def of(self, langs: list[str], texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray]:
        """(words, word key with the language in it, True where a word directly follows another)."""
        words = self.cutter.cut(texts)
        breaks = np.flatnonzero(np.frombuffer(words.buffer, np.uint8) == _BREAK)
        follows = np.zeros(len(words.starts), bool)
        follows[1:] = np.searchsorted(breaks, words.starts[1:]) == np.searchsorted(breaks, words.ends[:-1])
        return words, pair(lang_hashes(langs)[words.owner], words.hashes), follows


class Bits:
    """A set of 64-bit keys as ``size`` bits (a power of two)."""

    def __init__(self, size: int):
        self.size, self.bits = size, np.zeros(size // 8, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64(self.size - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def add_all(self, keys: DataFrame) -> "Bits":
        """Sets the bits of ``keys(key long)``; made in segments by the tasks, so that at
        most ``size`` bits reach the driver."""
        segment = 1 << 16
        spot = F.col("key").bitwiseAND(F.lit(self.size - 1))

        def make(key: tuple, rows: pa.Table) -> pa.Table:
            part = np.zeros(segment // 8, np.uint8)
            at = rows.column("at").to_numpy()
            np.bitwise_or.at(part, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
            return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()),
                             "bits": pa.array([part.tobytes()], pa.binary())})
        spots = keys.select(F.floor(spot / segment).cast("long").alias("segment"), (spot % segment).alias("at")).distinct()
        for r in spots.groupBy("segment").applyInArrow(make, "segment long, bits binary").toLocalIterator():
            start = r["segment"] * segment // 8
            self.bits[start:start + segment // 8] |= np.frombuffer(r["bits"], np.uint8)
        return self


def _by_lang(words: Words, keys: np.ndarray, langs: list[str], m: np.ndarray | int, at: np.ndarray, counts: Counter) -> None:
    """Adds the phrases of ``m`` words at the words ``at`` (their ``keys`` beside them) to ``counts``."""
    _, first, times = np.unique(keys, return_index=True, return_counts=True)
    spots = at[first]
    ends = words.ends[spots + m - 1]
    for own, a, b, c in zip(words.owner[spots].tolist(), words.starts[spots].tolist(), ends.tolist(), times.tolist()):
        counts[langs[own], words.buffer[a:b], m] += c


def _emit(counts: Counter, names: list[str]) -> pa.RecordBatch:
    langs, phrases, lengths = zip(*counts) if counts else ((), (), ())
    out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                                      pa.array(lengths, pa.int32()), pa.array(list(counts.values()), pa.int64())], names)
    counts.clear()
    return out


def count_words(rows: DataFrame, held: int = 400_000) -> DataFrame:
    """(lang, word, c) of ``rows(lang, text)``, summed in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = Pieces(), Counter()
        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang").to_pylist()
                words, keys, _ = pieces.of(langs, part.column("text").to_pylist())
                _by_lang(words, keys, langs, 1, np.arange(len(keys)), counts)
                if len(counts) > held:
                    yield _emit(counts, ["lang", "word", "m", "c"])
        yield _emit(counts, ["lang", "word", "m", "c"])
    return rows.mapInArrow(run, "lang string, word string, m int, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))


def word_keys(words: DataFrame) -> DataFrame:
    """``key`` of (lang, word), as the scans make it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(b"\n", bytes(range(256)))
        for b in batches:
            hashes = cutter.cut(b.column("word").to_pylist()).hashes
            yield pa.RecordBatch.from_arrays([pa.array(pair(lang_hashes(b.column("lang").to_pylist()), hashes).view(np.int64))], ["key"])
    return words.select("lang", "word").mapInArrow(run, "key long")


class Frontier:
    """What a scan knows: words that are frequent, in the frontier before (``old``) or
    since this round (``new``), and frequent phrases of two and three words counted so far."""

    def __init__(self, size: int):
        self.frequent, self.old, self.new, self.two, self.three = (Bits(size) for _ in range(5))

    def grown(self, keys: np.ndarray, follows: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, phrase keys) of the phrases to count in this round: all words
        frequent, an end new in the frontier and none old, and their part of two or
        three words at each end in the frontier frequent itself."""
        n = len(keys)
        word = self.frequent.has(keys)
        old = word & self.old.has(keys)
        live = old | (word & self.new.has(keys))
        run = word.copy()
        phrase = keys
        found: dict[int, np.ndarray] = {}
        for m in range(2, longest + 1):
            if n < m:
                return
            run = run[:-1] & word[m - 1:] & follows[m - 1:]
            phrase = pair(phrase[:-1], keys[m - 1:])
            first, last = slice(0, n - m + 1), slice(m - 1, n)
            at = np.flatnonzero(run & (live[first] | live[last]) & ~old[first] & ~old[last])
            if m > 2:
                known, inner = found[min(m - 1, 3)], min(m - 1, 3)
                at = at[(~live[at] | known[at]) & (~live[at + m - 1] | known[at + m - inner])]
            if m < 4 and longest > m:
                found[m] = (self.two if m == 2 else self.three).has(phrase)
            if m < 4 and longest == LONGEST:
                at = at[found[m][at]]
            yield m, at, phrase[at]


def _hashed(rows: DataFrame, shared, m: int) -> DataFrame:
    """(key, c) of the phrases of ``m`` words to count in this round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, tally, frontier = Pieces(), Tally(), shared.value

        def out(got):
            for keys, counts, _ in got:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "c"])
        for batch in batches:
            for part in slices(batch):
                _, keys, follows = pieces.of(part.column("lang").to_pylist(), part.column("text").to_pylist())
                for length, _, phrase in frontier.grown(keys, follows, m):
                    if length == m:
                        yield from out(tally.add(phrase, phrase))
        yield from out(tally.rest())
    return rows.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _spelled(rows: DataFrame, shared, held: int = 400_000) -> DataFrame:
    """(lang, phrase, m, a) of all phrases to count in this round, as text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, frontier, counts = Pieces(), shared.value, Counter()
        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang").to_pylist()
                words, keys, follows = pieces.of(langs, part.column("text").to_pylist())
                for m, at, phrase in frontier.grown(keys, follows, LONGEST):
                    _by_lang(words, phrase, langs, m, at, counts)
                if len(counts) > held:
                    yield _emit(counts, ["lang", "phrase", "m", "a"])
        yield _emit(counts, ["lang", "phrase", "m", "a"])
    # words of a phrase may stand apart by several blanks: one each from here on
    return (rows.mapInArrow(run, "lang string, phrase string, m int, a long")
            .withColumn("phrase", F.regexp_replace("phrase", "[ \t]+", " ")).groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a")))


def _big(c: Column) -> Column:
    return c.cast("decimal(16,0)")


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)), the products exact to 38 digits."""
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (_big(a) * _big(n)), _big(l) * _big(r))


def _join_words(first: Column, count: Column) -> Column:
    return F.array_join(F.slice("w", first, count), " ")


def score_phrases(phrases: DataFrame, words: DataFrame, reach: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates with both ends in the frontier
    that no longer candidate contains at the same count.  A longer one has a part of one
    more word with that count too, so only those are looked up."""
    split = phrases.withColumn("w", F.split("phrase", " "))
    counts = phrases.select("lang", "phrase", "a").unionByName(words.select("lang", F.col("word").alias("phrase"), F.col("c").alias("a")))
    ends = words.join(reach, "lang").where(F.col("bucket") <= F.col("hi")).select("lang", F.col("word").alias("end"))
    inside = (split.join(ends.withColumnRenamed("end", "e1"), (split["lang"] == ends["lang"]) & (F.element_at("w", 1) == F.col("e1")), "left_semi"))
    last = ends.withColumnRenamed("end", "e2")
    inside = inside.join(last, (inside["lang"] == last["lang"]) & (F.element_at("w", -1) == F.col("e2")), "left_semi")
    cuts = (inside.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
            .select("lang", "phrase", "a", "k", _join_words(F.lit(1), F.col("k")).alias("left"),
                    _join_words(F.col("k") + 1, F.col("m") - F.col("k")).alias("right")))
    cuts = (cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
            .join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
            .join(reach.select("lang", "n"), "lang"))
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    scored = (cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
              .select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r"))
    longer = (split.where(F.col("m") > 2).select("lang", F.col("a").alias("more"), F.explode(F.array(
        _join_words(F.lit(1), F.col("m") - 1), _join_words(F.lit(2), F.col("m") - 1))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("more").alias("more")))
    return scored.join(longer, ["lang", "phrase"], "left").where(F.col("more").isNull() | (F.col("more") < F.col("a"))).drop("more")


def mine_phrases(docs: DataFrame, min_count: int = 100, top: int = 2000, bits: int = 1 << 26) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of
    ``docs(text, lang)``, of 2 to 5 words and ``min_count`` occurrences.

    Null text is empty, a null lang is ``und``.  Words are cut at blanks inside pieces;
    repeated rows count as often as they stand there.  Ties in score go to the commoner
    phrase, then to the one that is less in bytes.  No rows, or nothing frequent: no rows.
    Broadcast are five bit tables of 64 bits for each frequent word, but of ``bits`` bits at most,
    whatever the input (fuller tables let more phrases through to be counted)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    # the frequent words, and all others of a language as one sum
    counted = cut_lineage(count_words(rows).groupBy("lang", F.when(F.col("c") >= min_count, F.col("word")).alias("word"))
                          .agg(F.sum("c").alias("c")))
    totals = counted.groupBy("lang").agg(F.sum("c").alias("n"))
    words = counted.where(F.col("word").isNotNull()).withColumn("bucket", F.floor(4 * F.log2(F.col("c") / F.lit(float(min_count)))).cast("int"))
    before = W.partitionBy("lang").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # one row per language and quarter octave of counts
    steps = cut_lineage(words.groupBy("lang", "bucket").agg(F.count("*").alias("words"), F.sum("c").alias("mass"), F.min("c").alias("least"))
                        .withColumn("words_before", F.coalesce(F.sum("words").over(before), F.lit(0)))
                        .withColumn("mass_before", F.coalesce(F.sum("mass").over(before), F.lit(0))).join(totals, "lang"))
    bits = min(bits, 1 << max(16, (64 * words.count()).bit_length()))
    frontier = Frontier(bits)
    frontier.frequent.add_all(word_keys(words))
    reach = steps.select("lang", "n").distinct().withColumn("hi", F.lit(-1)).withColumn("settled", F.lit(False))
    phrases, best = None, None
    for share in SHARES:
        inside = (F.col("words_before") < 2 * top) | (F.col("mass_before") < share * F.col("n"))
        goal = steps.groupBy("lang").agg(F.max(F.when(inside, F.col("bucket"))).alias("goal"), F.min(F.when(~inside, F.col("least"))).alias("next"))
        reach = cut_lineage(reach.select("lang", "n", "hi", "settled").join(goal, "lang").select(
            "lang", "n", "settled", F.col("hi").alias("was"), "next", F.when(F.col("settled"), F.col("hi")).otherwise(F.col("goal")).alias("hi")))
        added = words.join(reach, "lang").where((F.col("bucket") > F.col("was")) & (F.col("bucket") <= F.col("hi")))
        frontier.new = Bits(bits).add_all(word_keys(added))
        if frontier.new.bits.any():
            for m, found in ((2, frontier.two), (3, frontier.three)):
                shared = spark.sparkContext.broadcast(frontier)
                found.add_all(_hashed(rows, shared, m).where(F.col("c") >= min_count).select("key"))
                shared.unpersist()
            spelled = cut_lineage(_spelled(rows, spark.sparkContext.broadcast(frontier)).where(F.col("a") >= min_count))
            phrases = spelled if phrases is None else phrases.unionByName(spelled)
            frontier.old.bits |= frontier.new.bits
        if phrases is None:
            break
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = cut_lineage(score_phrases(phrases, words, reach).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
        # the bound of the commonest-first words outside; a tie with it could still change the list
        lowest = best.groupBy("lang").agg(F.count("*").alias("there"), F.min("score").alias("lowest"))
        bound = _score(F.lit(1), F.col("n"), F.lit(1), F.col("next"))
        reach = cut_lineage(reach.join(lowest, "lang", "left").withColumn("settled", F.col("settled") | F.col("next").isNull() | F.coalesce(
            (F.col("there") >= top) & (F.col("lowest") > bound), F.lit(False))).select("lang", "n", "hi", "settled"))
        if reach.where(~F.col("settled")).isEmpty():
            break
    if best is None:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) AS phrase FROM p, (SELECT unnest(range(1, 6)) AS m)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 100),
cut AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.m, cut.a, x.a AS l, y.a AS r, t.n, (1000 * cut.a * t.n) // (x.a * y.a) AS score, k
      FROM cut JOIN t USING (lang)
      JOIN f x ON x.lang = cut.lang AND x.m = k AND x.phrase = array_to_string(cut.w[1:k], ' ')
      JOIN f y ON y.lang = cut.lang AND y.m = cut.m - k AND y.phrase = array_to_string(cut.w[k + 1:], ' ')
      QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, a, unnest(flatten([[array_to_string(w[i:i + j - 1], ' ') for i in range(1, m - j + 2)] for j in range(2, m)])) AS phrase FROM c),
held AS (SELECT lang, phrase, max(a) AS more FROM inner_parts GROUP BY ALL),
r AS (SELECT s.* FROM s LEFT JOIN held USING (lang, phrase) WHERE held.more IS NULL OR 100 * held.more < 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM r QUALIFY rank <= 2000
"""


@register("op12_phrase_mining", SQL)
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language over all documents."""
    return mine_phrases(table(spark, sf_dir, "documents").select("text", "lang"))
