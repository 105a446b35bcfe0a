"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.session import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _tidy(e: DataFrame) -> DataFrame:
    return cut_lineage(e.where(F.col("u") != F.col("v")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` of longs, any order, repeats allowed -> ``(node, root)`` for
    every node that is not the smallest of its component; ``root`` is the
    smallest.  Rounds are logarithmic in practice; each is checkpointed."""
    e = _tidy(edges.select("u", "v"))
    before = _mark(e)
    while before[0]:
        e = _tidy(_small_star(_tidy(_large_star(e))))
        now = _mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
