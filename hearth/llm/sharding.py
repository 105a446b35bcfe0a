"""Sharding by sampled splitters.

1. per-key byte totals (map-side combined) give a size-weighted sample of keys;
2. quantiles of the sample are the range boundaries; a key as heavy as a whole
   range gets a range of its own;
3. exact byte totals of the ranges are taken over all rows, and overfull ranges
   are subdivided (on the key, or inside one heavy key on the tie column);
4. rows are ordered inside their range; range offsets turn the local running
   bytes into a global position, and the position decides the shard.

The driver only ever holds one number per range (``shards * ranges_per_shard``
of them, a parameter), never anything that grows with the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearth.llm.common import fresh, table, unit
from hearth.llm.registry import register
from hearth.session import cut_lineage

ROW_OVERHEAD = 16


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed row overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)


def _boundaries(keys: DataFrame, total: int, ranges: int, samples: int, seed: int) -> np.ndarray:
    """Sorted first keys of the ranges (without the first range's)."""
    share = F.col("bytes") * F.lit(samples / total)
    sample = keys.where(unit(F.lit(seed), F.col("k")) < share).select("k", F.greatest(share, F.lit(1.0)).alias("w"))
    order = W.orderBy("k")
    cells = (sample.withColumn("upto", F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)))
             .withColumn("all", F.sum("w").over(W.partitionBy(F.lit(0))))
             .withColumn("cell", F.floor((F.col("upto") - F.col("w")) * ranges / F.col("all")))
             .withColumn("heavy", F.col("w") * ranges >= F.col("all")))
    found = cells.groupBy("cell").agg(F.min("k").alias("k"), F.collect_set(F.when(F.col("heavy"), F.col("k"))).alias("h"))
    cuts: set[int] = set()
    for r in found.collect():  # at most one row per range
        cuts.add(r["k"])
        for h in r["h"]:
            cuts.update((h, h + 1) if h < 2 ** 63 - 1 else (h,))
    return np.array(sorted(cuts)[0:], dtype=np.int64)


def _group_of(cuts: np.ndarray, first: np.ndarray, parts: np.ndarray, low: np.ndarray, high: np.ndarray,
              by_tie: np.ndarray):
    """Column function (k, t) -> number of the (sub)range, increasing in (k, t)."""
    @F.pandas_udf("int")
    def group(k: pd.Series, t: pd.Series) -> pd.Series:
        r = np.searchsorted(cuts, k.to_numpy(np.int64), side="right")
        x = np.where(by_tie[r], t.to_numpy(np.int64).astype(np.float64), k.to_numpy(np.int64).astype(np.float64))
        width = np.maximum(high[r] - low[r], 1.0)
        sub = np.clip(np.floor((x - low[r]) / width * parts[r]), 0, parts[r] - 1)
        return pd.Series((first[r] + sub).astype(np.int32))
    return group


def shard_by_size(docs: DataFrame, key: Column, tie: Column, size: Column, shards: int,
                  ranges_per_shard: int = 8, samples_per_range: int = 32, seed: int = 7) -> DataFrame:
    """``docs`` plus ``size`` long, ``shard`` int (0 .. shards-1) and ``slot``
    long (gapless from 0 in each shard).

    ``key``/``tie`` are long columns: rows are laid out in (key, tie) order and
    cut into ``shards`` pieces of near-equal ``size`` (a shard differs from the
    mean by less than the row that straddles its edge).  Rows of one key stay
    next to each other, in one shard unless the law of sizes splits them.
    Null keys or ties count as 0, sizes below 1 as 1.  Equal rows are
    interchangeable.  No rows: no rows.  Columns of ``docs`` named like an
    output column are replaced.
    """
    spark = docs.sparkSession
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("size", "shard", "slot")])
    row = fresh(base, "row")
    wide = base.select(F.struct(*[base[c] for c in base.columns]).alias(row) if base.columns else F.lit(0).alias(row),
                       F.coalesce(key, F.lit(0)).cast("long").alias("k"),
                       F.coalesce(tie, F.lit(0)).cast("long").alias("t"),
                       F.greatest(F.coalesce(size, F.lit(1)).cast("long"), F.lit(1)).alias("size"))
    narrow = cut_lineage(wide.select("k", "t", "size"))

    totals = narrow.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, ranges = totals["b"] or 0, shards * ranges_per_shard
    if not total:
        return wide.select(f"{row}.*", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cuts = _boundaries(narrow.groupBy("k").agg(F.sum("size").alias("bytes")), total, ranges,
                       ranges * samples_per_range, seed)

    # exact totals of the ranges; overfull ones are subdivided
    n = len(cuts) + 1
    plain = _group_of(cuts, np.arange(n), np.ones(n), np.zeros(n), np.ones(n), np.zeros(n, bool))
    stats = (narrow.groupBy(plain("k", "t").alias("g"))
             .agg(F.sum("size").alias("b"), F.min("k").alias("k0"), F.max("k").alias("k1"),
                  F.min("t").alias("t0"), F.max("t").alias("t1")).collect())
    parts, low, high = np.ones(n), np.zeros(n), np.ones(n)
    by_tie = np.zeros(n, bool)
    for s in stats:
        g = s["g"]
        by_tie[g] = s["k0"] == s["k1"]
        low[g], high[g] = (float(s["t0"]), float(s["t1"])) if by_tie[g] else (float(s["k0"]), float(s["k1"]))
        parts[g] = max(1, -(-s["b"] * ranges // total))
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    group = _group_of(cuts, first, parts, low, high, by_tie)

    sums = {s["g"]: s["b"] for s in narrow.groupBy(group("k", "t").alias("g")).agg(F.sum("size").alias("b")).collect()}
    begin, upto = [], 0
    for g in sorted(sums):
        begin.append((g, upto))
        upto += sums[g]
    offsets = F.broadcast(spark.createDataFrame(begin, "g int, begin long"))  # one row per (sub)range

    def placed(rows: DataFrame) -> DataFrame:
        order = W.partitionBy("g").orderBy("k", "t", "size")
        return (rows.withColumn("g", group("k", "t"))
                .withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
                .withColumn("rn", F.row_number().over(order))
                .join(offsets, "g")
                .withColumn("shard", F.least(F.lit(shards - 1), F.floor(
                    (F.col("begin") + F.col("upto") - F.col("size")).cast("decimal(38,0)") * shards / total)).cast("int")))

    counts = {(r["g"], r["shard"]): r["n"] for r in placed(narrow).groupBy("g", "shard").agg(F.count("*").alias("n")).collect()}
    seen: dict[int, int] = {}
    start, inside, last = [], 0, None
    for g, s in sorted(counts):
        inside = 0 if g != last else inside
        start.append((g, s, seen.get(s, 0) - inside - 1))
        seen[s] = seen.get(s, 0) + counts[g, s]
        inside, last = inside + counts[g, s], g
    starts = F.broadcast(spark.createDataFrame(start, "g int, shard int, start long"))  # ranges + shards rows at most
    return (placed(wide).join(starts, ["g", "shard"])
            .select(f"{row}.*", "size", "shard", (F.col("start") + F.col("rn")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int = 40, **params) -> DataFrame:
    """``docs`` in shards of near-equal bytes; equal texts are neighbours (the
    key is the text's hash, the tie breaker doc_id's)."""
    return shard_by_size(docs, F.xxhash64("text"), F.xxhash64("doc_id"), text_size(F.col("text")), shards, **params)


@register("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the ``bytes`` law.  A null text has
    size 16 and the crc32 of the empty text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                         F.xxhash64("text").alias("key"), text_size(F.col("text")).alias("bytes"))
    out = shard_by_size(digest, F.col("key"), F.xxhash64("doc_id"), F.col("bytes"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
