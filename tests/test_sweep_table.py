"""The k table of a labelling has every index of C9, equal to the single operators, and its SQL too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hearth.operators import kselect as ks


def test_table_has_all_indices(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(np.arange(300) % 4 * 5, 1.0), rng.normal(0, 1, 300)))]
    df = spark.createDataFrame(rows, "hid long, x double, y double").cache()

    def rule(k):
        return (F.col("hid") % k).cast("int") if k != 3 else F.when(F.col("x") > 8, 2).when(F.col("x") > 3, 1)  # null: a label as well

    got = {r["k"]: r for r in ks.k_sweep_table(df, ["x", "y"], [1, 2, 3, 4], rule, sample_size=200).collect()}
    assert got[1]["silhouette"] is None and got[1]["davies_bouldin"] is None
    for k in (2, 3, 4):
        lab = df.withColumn("cluster", F.coalesce(rule(k), F.lit(0)))
        assert got[k]["calinski_harabasz"] == pytest.approx(ks.calinski_harabasz(lab, ["x", "y"]).first()["calinski_harabasz"])
        assert got[k]["davies_bouldin"] == pytest.approx(ks.davies_bouldin(lab, ["x", "y"]).first()["davies_bouldin"])
        assert got[k]["silhouette"] == pytest.approx(ks.silhouette(lab, ["x", "y"], sample_size=200).first()["silhouette"])
        assert got[k]["cost_improvement"] == pytest.approx((got[k - 1]["cost"] - got[k]["cost"]) / got[k - 1]["cost"])
        assert got[k - 1]["cost_improvement_to_next"] == pytest.approx(got[k]["cost_improvement"])
    assert got[1]["cost_improvement"] is None and got[4]["cost_improvement_to_next"] is None


def test_registered_table(spark):
    got = entry.queries()["k_sweep_metrics"](spark, "/root/testdata/sf0.001").orderBy("k").collect()
    assert [r["k"] for r in got] == list(range(2, 16))
    for c in ("silhouette", "davies_bouldin", "calinski_harabasz", "cost"):
        assert all(r[c] is not None for r in got)
        assert c in entry.oracle_sql()["k_sweep_metrics"]
