from zlib import crc32

from helpers import SF, docs, read
from pyspark.sql import functions as F

from hearth.llm.sharding import op7_sharding, shard_by_size, shard_documents


def gapless(pdf, shards):
    return all(sorted(g["slot"]) == list(range(len(g))) for _, g in pdf.groupby("shard")) and pdf.shard.between(0, shards - 1).all()


def test_query_law(spark):
    d = read("documents").set_index("doc_id")
    got = op7_sharding(spark, SF).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(d.index) and gapless(got, 40) and set(got.law) == {"bytes"}
    text = d.text[got.index]
    assert (got["size"] == [len(t.encode()) + 16 for t in text]).all() and (got.text_crc32 == [crc32(t.encode()) for t in text]).all()
    sums = got.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert (sums - sums.mean()).abs().max() <= got["size"].max()
    again = op7_sharding(spark, SF).toPandas().set_index("doc_id")
    assert (again.shard == got.shard[again.index]).all() and (again.slot == got.slot[again.index]).all()


def test_hot_text_is_subdivided_and_others_stay_together(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(
        F.concat(F.lit("text "), (F.col("id") % 100).cast("string"))).alias("text"))
    got = shard_documents(rows, 10).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert gapless(got, 10) and len(sums) == 10 and sums.max() - sums.min() <= 2 * got["size"].max()
    spread = got[got.text != "the same text"].groupby("text").shard.nunique()
    assert (spread > 1).sum() <= 10  # only a text on the edge of two shards is parted


def test_edges(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (2, ""), (3, "x" * 100_000)]
    df = docs(spark, rows).withColumn("size", F.lit(1)).withColumn("k", F.lit(2)).withColumn("row", F.lit(3)).withColumn("g", F.lit(4))
    got = shard_documents(df, 3).toPandas()
    assert len(got) == 5 and gapless(got, 3) and sorted(got["size"]) == [16, 16, 17, 17, 100_016] and set(got["row"]) == {3}
    assert shard_documents(docs(spark, []), 3).count() == 0
    assert shard_by_size(docs(spark, rows), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"), 2).count() == 5
