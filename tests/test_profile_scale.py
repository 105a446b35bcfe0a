"""The profile and its quantiles: a fixed number of passes, and the same figures on odd values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.functions import stats as st
from hearth.operators import profile as pf


def _jobs(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_passes_do_not_grow_with_groups_or_probabilities(spark):
    one = spark.range(4000).select(F.lit(0).alias("g"), (F.col("id") * 0.37).alias("x"))
    many = one.select(F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("g"), F.col("x"))
    few = _jobs(spark, "few", lambda: st.quantiles(one, ["g"], "x", [0.5], max_exact=50).collect())
    assert _jobs(spark, "many", lambda: st.quantiles(many, ["g"], "x", [0.1, 0.25, 0.5, 0.75], max_exact=50).collect()) <= few + 2


def test_a_profile_is_made_once(spark):
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    assert "Range" not in pf.field_profile(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("wrong", ["min", "max"])
def test_quantiles_are_exact_whatever_the_sketch_says(spark, monkeypatch, wrong):
    x = np.concatenate([np.random.default_rng(1).normal(0, 5, 700), np.repeat(1.5, 300)])
    rows = [(None, float(v)) for v in x] + [("b", float(v) * 2) for v in x] + [("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    agg = getattr(F, wrong)
    monkeypatch.setattr(st.F, "percentile_approx", lambda col, marks, accuracy: F.array(*[agg(col) for _ in marks]))
    got = {r["g"]: r for r in st.quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 1.0], max_exact=100).collect()}
    for g, data in ((None, x), ("b", x * 2), ("c", np.array([4.0]))):
        assert np.allclose([got[g].q00, got[g].q25, got[g].q50, got[g].q100], np.percentile(data, [0, 25, 50, 100]), rtol=0, atol=1e-9)


def test_profile_of_odd_values(spark):
    rows = [(0.0, True, "x", None, 1), (-0.0, False, "", None, 1), (float("nan"), None, " ", None, 1), (None, True, None, None, 1), (0.0, True, "x", None, None)]
    df = spark.createDataFrame(rows, "d double, b boolean, s string, e string, n int")
    got = {r["field_name"]: r for r in pf.field_profile(df).collect()}
    assert [got[c]["n_unique"] for c in "dbsen"] == [3, 2, 3, 0, 1]   # 0.0, -0.0 and NaN are three texts
    assert [got[c]["n_missing"] for c in "dbsen"] == [1, 1, 1, 5, 1]
    assert got["d"]["dominant_ratio"] == 0.5 and got["e"]["dominant_ratio"] is None
    assert got["e"]["field_type"] == "constant" and got["e"]["entropy_ln"] is None
    assert got["b"]["mean"] == 0.75 and got["d"]["q50"] == 0.0 and math.isnan(got["d"]["mean"])
    assert got["s"]["entropy_ln"] == pytest.approx(1.5 * math.log(2), abs=1e-9)
    assert pf.field_profile(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("few", [0, 64])
def test_quantiles_of_plain_values_need_no_sketch_and_outliers_stay_exact(spark, monkeypatch, few):
    sketched = []
    plain = st.F.percentile_approx
    monkeypatch.setattr(st.F, "percentile_approx", lambda *a: sketched.append(1) or plain(*a))
    monkeypatch.setattr(st, "FEW_GROUPS", few)
    x = np.random.default_rng(2).normal(0, 5, 3000)
    data = {"plain": x, "steps": np.floor(x), "one": np.full(500, 2.5)}
    odd = {"far": np.append(x, 1e300), "inf": np.append(x, [np.inf, -np.inf]), "tiny": np.append(x * 1e-12, -1.0)}
    probs = [0.25, 0.5, 0.9]
    for part, sketches in ((data, 0), (odd, 1)):
        df = spark.createDataFrame([(g, float(v)) for g, vs in part.items() for v in vs], "g string, x double")
        got = {r["g"]: r for r in st.quantiles(df, ["g"], "x", probs, max_exact=100).collect()}
        for g, vs in part.items():
            assert np.allclose([got[g].q25, got[g].q50, got[g].q90], np.percentile(vs, [25, 50, 90]), rtol=1e-12, atol=0)
        assert len(sketched) == sketches
