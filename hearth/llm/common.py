"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: a word is a run of characters outside ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
# the same white space as a Java character class
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the value as text, modulo ``m`` (null stays null)."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(m))


def held_out(col: Column, m: int, r: int) -> Column:
    return F.coalesce(crc_mod(col, m) == r, F.lit(False))


def unit(*cols: Column) -> Column:
    """A reproducible uniform value in [0, 1) from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0 ** -53)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def labelled_sample(labels: DataFrame, column: str, m: int, r: int, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` labelled rows ``(doc_id, y)`` that are not held out
    (crc32 of doc_id mod ``m`` is not ``r``), drawn by a hash of doc_id.  A
    doc_id with several labels takes the larger; null labels are left out."""
    ok = labels.select("doc_id", F.col(column).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), m, r))
    one = ok.groupBy("doc_id").agg(F.max("y").alias("y"))
    return one.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)
