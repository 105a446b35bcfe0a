"""Kept tables are as finely cut as their rows ask for, and kept anew once dropped."""

import pytest
from pyspark.sql import functions as F

from hearth.sources import tables as tb


@pytest.fixture
def sf_dir(spark, tmp_path):
    o = spark.range(300)
    o.select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
             F.lit("1-URGENT").alias("o_orderpriority"), (F.col("id") * 1.5).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    o.where("id % 3 > 0").select(F.col("id").alias("l_orderkey"), F.lit("R").alias("l_returnflag"), F.lit(2.0).alias("l_extendedprice"),
                                 F.lit(1.0).alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.lit("O").alias("l_linestatus")
                                 ).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_households_are_kept_in_few_partitions(spark, sf_dir):
    h = tb.households(spark, sf_dir)
    assert h.count() == 300 and h.where("has_lines = 1").count() == 200
    assert h.rdd.getNumPartitions() <= tb.parts_for(spark, 300) < 64
    assert tb.parts_for(spark, 100 * tb.ROWS_PER_PART) >= 100


def test_households_dropped_from_the_cache_are_kept_anew(spark, sf_dir):
    assert tb.households(spark, sf_dir).storageLevel.useMemory
    spark.catalog.clearCache()
    assert tb.households(spark, sf_dir).storageLevel.useMemory


@pytest.mark.parametrize("levels", [["o", "ö", "Ω", "P"], [f"s{i}" for i in range(tb.CODED_LEVELS + 1)], [None]])
def test_least_line_status_of_any_levels(spark, sf_dir, tmp_path, levels):
    rows = [(k, "R" if j and k % 5 else "N", float(j), 1.0, 0.1, levels[(k * 7 + j) % len(levels)]) for k in range(100) for j in range(3)]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_extendedprice double, l_quantity double, l_discount double, "
                                "l_linestatus string").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    h = tb.households(spark, sf_dir)
    got = {r["hid"]: r["ret_status"] for r in h.collect()}
    for k in range(100):
        assert got[k] == min((r[5] for r in rows if r[0] == k and r[1] == "R" and r[5]), key=str.encode, default=None)
    assert got[200] is None and len(got) == 300


def test_lines_are_hashed_not_sorted(spark, sf_dir):
    assert "SortAggregate" not in tb.households(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
