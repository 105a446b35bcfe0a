"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within distance ``d`` agree on at least one of ``m`` bit groups up
to that group's threshold, whenever the thresholds plus one sum to ``d + 1``.
Correlated bits are put into one group; the number of groups and the unequal
thresholds come from a dynamic programme over estimated candidate counts, so
the plan moves to wider groups as the corpus grows.  Each fingerprint is filed
under its own group values and probes every value within the threshold; what
meets in a bucket is verified on the whole fingerprint.

A bucket of n fingerprints emits at most n - 1 links (a spanning forest of its
links), which loses no connection.  Buckets with very many fingerprints are
split into chunks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import fresh, table
from hearth.llm.components import components
from hearth.llm.registry import register
from hearth.session import cut_lineage

SEED = 42
BROADCAST_ROWS = 200_000  # narrow rows that may be broadcast; more are joined by shuffle
PIECE = 65536  # shingles whose bits are unpacked at a time


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash over word shingles, repeats included: A-Z lower-cased,
    words joined by a space, XXH64 with seed 42; a bit is 1 if it is set in
    over half of the hashes.  Fewer words: the whole sequence; none: 0."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    k = min(shingle, len(words))
    begin, end = (stop - size + 1)[:len(words) - k + 1].tolist(), stop[k - 1:].tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begin), PIECE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(begin[at:at + PIECE], end[at:at + PIECE])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash long, fp long) of each row of ``docs(doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


# ------------------------------------------------------------------ the plan

def _bit_matrix(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 counts of bits set together) over all of ``fps(fp)``; one
    matrix per task is summed by cell, 4096 numbers reach the driver."""
    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = _bit_matrix(b.column("fp").to_numpy()).astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)),
                                              pa.array(np.append(total.ravel(), n).astype(np.int64))], ["cell", "n"])
    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def order_bits(n: int, together: np.ndarray) -> list[int]:
    """All 64 bits in a chain in which each is the one most correlated with the last few."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, -1)
    chain = [int(np.unravel_index(corr.argmax(), corr.shape)[0])]
    rest = set(range(64)) - set(chain)
    while rest:
        nxt = max(sorted(rest), key=lambda b: corr[b, chain[-8:]].sum())
        chain.append(nxt)
        rest.remove(nxt)
    return chain


def choose_plan(n: int, together: np.ndarray, sample: np.ndarray, distance: int,
                probe_cost: float = 1.0, verify_cost: float = 0.02) -> list[tuple[int, int]]:
    """[(bit mask, threshold)] of the groups in use.

    For each number of groups, a dynamic programme hands out the thresholds
    (-1: group unused) that make the estimated cost least; candidate counts are
    taken from the pairs of ``sample``, but no lower than independent bits with
    the corpus' frequencies would give."""
    chain, p = order_bits(n, together), np.diag(together) / max(n, 1)
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(2, distance + 2):
        cost = []
        groups = [chain[i * 64 // m:(i + 1) * 64 // m] for i in range(m)]
        masks = [sum(1 << b for b in g) for g in groups]
        for bits, mask in zip(groups, masks):
            near = np.zeros(distance + 1)
            if len(sample) > 1:
                part = sample & np.uint64(mask)
                for i in range(0, len(part), 256):
                    seen = np.bincount(np.bitwise_count(part[i:i + 256, None] ^ part[None, :]).ravel(), minlength=65)
                    near += seen[:distance + 1]
                near[0] -= len(part)
                near /= len(part) * (len(part) - 1)
            apart = np.zeros(distance + 2)
            apart[0] = 1.0
            for b in bits:
                differ = 2 * p[b] * (1 - p[b])
                apart[1:] = apart[1:] * (1 - differ) + apart[:-1] * differ
                apart[0] *= 1 - differ
            chance = np.maximum(np.cumsum(near), np.cumsum(apart[:distance + 1]))
            probes = np.cumsum([comb(len(bits), t) for t in range(distance + 1)])
            cost.append([0.0] + [float(n * probes[t] * probe_cost + 0.5 * n * n * chance[t] * verify_cost)
                                 for t in range(distance + 1)])
        # table[s]: least cost of the groups so far with thresholds + 1 summing to s
        table_ = {0: (0.0, [])}
        for c in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (v, picks) in table_.items():
                for t1, x in enumerate(c):
                    if s + t1 <= distance + 1 and (s + t1 not in new or v + x < new[s + t1][0]):
                        new[s + t1] = (v + x, [*picks, t1 - 1])
            table_ = new
        value, picks = table_[distance + 1]
        if best is None or value < best[0]:
            best = (value, [(mask, t) for mask, t in zip(masks, picks) if t >= 0])
    return best[1]


# ------------------------------------------------------------ probe and verify

def _forest(index: np.ndarray, probe: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between ``index`` and ``index`` or ``probe`` fingerprints of one
    bucket: all of them if few, else a spanning forest found breadth first."""
    both = np.unique(np.concatenate([index, probe])) if len(probe) else index
    if len(index) * len(both) <= 65536:
        a, b = np.nonzero(np.bitwise_count(index[:, None] ^ both[None, :]) <= distance)
        keep = index[a] != both[b]
        if keep.sum() < 2 * len(both):
            return list(zip(index[a[keep]].tolist(), both[b[keep]].tolist()))
    inner = np.isin(both, index)
    left = np.ones(len(both), bool)
    out = []
    for first in range(len(both)):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo:
            u = todo.pop()
            rest = np.flatnonzero(left if inner[u] else left & inner)
            hit = rest[np.bitwise_count(both[rest] ^ both[u]) <= distance]
            left[hit] = False
            out += [(int(both[u]), int(both[v])) for v in hit]
            todo += hit.tolist()
    return out


def _buckets(fps: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """(part, value, fp, own): each fingerprint under its own group values and
    as a probe under the values its thresholds reach."""
    flips = []
    for mask, threshold in plan:
        bits = [b for b in range(64) if mask >> b & 1]
        flips.append(np.array([sum(1 << b for b in c) for t in range(1, threshold + 1) for c in combinations(bits, t)],
                              dtype=np.uint64))

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for part, ((mask, _), flip) in enumerate(zip(plan, flips)):
                own = fp & np.uint64(mask)
                for piece in [None, *(flip[i:i + 64] for i in range(0, len(flip), 64))]:
                    value = own if piece is None else (own[:, None] ^ piece[None, :]).ravel()
                    of = fp if piece is None else np.repeat(fp, len(piece))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), part, np.int32)), pa.array(value.view(np.int64)),
                         pa.array(of.view(np.int64)), pa.array(np.full(len(value), piece is None))],
                        ["part", "value", "fp", "own"])
    return fps.select("fp").mapInArrow(run, "part int, value long, fp long, own boolean")


def near_links(fps: DataFrame, distance: int = 4, bucket_rows: int = 20000, sample_rows: int = 4096) -> DataFrame:
    """``(u, v)`` links between the distinct fingerprints ``fps(fp)`` whose
    connected components are those of all pairs at most ``distance`` bits apart.

    ``sample_rows`` bounds the fingerprints from which candidate counts are
    estimated (this only steers cost); ``bucket_rows`` bounds what meets in
    one task at a time."""
    n, together = bit_counts(fps)
    sample = fps.orderBy(F.xxhash64(F.lit(3), "fp")).limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plan = choose_plan(n, together, sample, distance)
    rows = _buckets(fps, plan)

    # split buckets that are too large for one task
    crowded = (rows.groupBy("part", "value").agg(F.count("*").alias("rows"))
               .where(F.col("rows") > bucket_rows)
               .select("part", "value", F.ceil(F.col("rows") / bucket_rows).cast("int").alias("chunks")))
    rows = (rows.join(crowded, ["part", "value"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select(F.xxhash64("part", "value", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "fp", "own"))

    def verify(batches):
        key = np.empty(0, np.int64)
        fp, own = np.empty(0, np.uint64), np.empty(0, bool)

        def links(upto: int):
            """Links of the whole buckets in the first ``upto`` rows."""
            start = np.flatnonzero(np.append(True, key[1:upto] != key[:upto - 1])) if upto else np.empty(0, np.int64)
            stop = np.append(start[1:], upto)
            owned = np.add.reduceat(own[:upto].astype(np.int64), start) if upto else start
            found = []
            for a, b in zip(start[(owned > 0) & (stop - start > 1)], stop[(owned > 0) & (stop - start > 1)]):
                mark = own[a:b]
                found += _forest(fp[a:b][mark], fp[a:b][~mark], distance)
            return found

        def batch_of(found):
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for b in batches:
            key = np.concatenate([key, b.column("bucket").to_numpy()])
            fp = np.concatenate([fp, b.column("fp").to_numpy().view(np.uint64)])
            own = np.concatenate([own, b.column("own").to_numpy(zero_copy_only=False)])
            if len(key) and key[0] != key[-1]:
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1  # the last bucket may go on in the next batch
                yield batch_of(links(cut))
                key, fp, own = key[cut:], fp[cut:], own[cut:]
        yield batch_of(links(len(key)))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verify, "u long, v long")


def _small(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and marked for broadcast if it has few rows.  Beyond
    that it is a side of a plain join, whose hot keys Spark can split, as the
    aggregation that made it is done."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) for each row of ``docs(doc_id, text)``: the
    smallest doc_id that can be reached over links of at most ``distance`` bits.

    ``root`` is the component's smallest fingerprint.
    Texts that are null, empty or white space have fingerprint 0 and are linked
    like any other.  Rows with a null doc_id get the smallest doc_id of their
    component, or null if it has none.  Repeated rows repeat; no rows give none."""
    own = cut_lineage(fingerprints(docs, shingle))
    each = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    stars = components(near_links(each, distance))
    # a fingerprint without links is its own root
    rooted = (each.join(stars, each["fp"] == stars["node"], "left")
              .select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    heads = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("rows"))
    # only fingerprints with company need the join; of all others the document is its own component
    company = _small(rooted.join(_small(heads.where(F.col("rows") > 1)), "root").select("fp", "root", "component_id"))
    return own.join(company, "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("component_id", "doc_id").alias("component_id"),
                                                  F.coalesce(F.col("root"), F.col("fp")).alias("root"))


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row of ``docs`` (all columns) of each component: the one with the
    smallest doc_id (null last), of several texts under that id the one with
    the smallest hash, of repeated rows any."""
    found = cut_lineage(near_duplicates(docs, shingle, distance))
    groups = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    heads = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")).alias("head"), F.sum("n").alias("rows"))
    # only components of several rows lose any
    judged = groups.join(_small(heads.where(F.col("rows") > 1)), "root").select(
        "doc_id", "text_hash", "n", (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("stays"))
    judged = _small(judged.where(~F.col("stays") | (F.col("n") > 1)))
    mark = fresh(docs, "text_hash")
    told = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).alias("d")

    def match(other: DataFrame, how: str) -> DataFrame:
        j = other.alias("j")
        return told.join(j, F.col("d.doc_id").cast("long").eqNullSafe(F.col("j.doc_id")) & (F.col(f"d.{mark}") == F.col("j.text_hash")), how)
    repeated = match(judged.where("stays"), "left_semi").dropDuplicates(["doc_id", mark])
    return match(judged, "left_anti").unionByName(repeated).drop(mark)


@register("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: 4-word shingles, 4 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
