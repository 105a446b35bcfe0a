"""No cap or size switch changes results; counts of the refinement loop hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.functions import responses as rp
from hearth.functions import stats as st
from hearth.operators import kprototypes as kp
from hearth.operators import quota as qt
from hearth.operators import refine as rf


@pytest.mark.parametrize("caps, want", [([(0, 0)], 3000), ([(0, 2500)], 2500), ([], 50), ([(0, 10), (1, 0)], 10)])
def test_capped_cluster_sample_follows_the_cap(spark, caps, want):
    need = spark.range(3000).select(F.col("id").alias("hid"), F.lit(0).alias("cluster"))
    got = rf.capped_cluster_sample(need, spark.createDataFrame(caps, "cluster int, cap long"), 1)
    rows = got.select("sampled_down").collect()
    assert len(rows) == want and {r[0] for r in rows} == {want < 3000}


def test_top_n_takes_large_quotas(spark):
    fields = spark.range(150).select(F.col("id").alias("seq"), F.lit("c").alias("category"), F.col("id").cast("double").alias("composite_score"))
    assert qt.top_n_per_group(fields, spark.createDataFrame([("c", 100)], "category string, quota long")).count() == 100
    assert qt.top_n_per_group(fields, spark.createDataFrame([], "category string, quota long")).count() == 0


@pytest.mark.parametrize("tail", [[], [float("inf")], [float("-inf"), float("inf"), float("nan"), None]])
def test_quantiles_beyond_the_switch_end_and_match(spark, tail):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.exp(rng.normal(0, 8, 1500)), np.repeat(7.0, 400)]).tolist() + tail
    df = spark.createDataFrame([("a", v) for v in x] + [("b", 1.0), ("b", 2.0)], "g string, x double")
    got = {r["g"]: r for r in st.quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 0.9], max_exact=50, buckets=8).collect()}
    kept = np.sort([v for v in x if v is not None and v == v])
    for p, name in ((0.0, "q00"), (0.25, "q25"), (0.5, "q50"), (0.9, "q90")):
        at = p * (len(kept) - 1)
        low, high = kept[int(at)], kept[min(int(at) + 1, len(kept) - 1)]
        want = low if low == high or at == int(at) else low + (at - int(at)) * (high - low)
        assert got["a"][name] == pytest.approx(want, rel=1e-9)
    assert got["b"]["q50"] == 1.5


def test_fit_cost_is_that_of_its_centres_for_any_round_limit(spark):
    f = spark.range(400).select(F.col("id").alias("hid"), ((F.col("id") * 37) % 101).cast("double").alias("x"),
                                (F.col("id") % 5).cast("string").alias("c"))
    for rounds in (1, 2, 50):
        res = kp.fit(f, ["x"], ["c"], 4, n_init=3, max_iter=rounds)
        cost = kp.clustering_cost(kp.assign(f, ["x"], ["c"], res.centroids)).first()["cost"]
        assert res.cost == pytest.approx(cost, rel=1e-9)


def test_random_starts_are_distinct_rows(spark):
    f = spark.range(500).select(F.col("id").alias("hid"), (F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 4).cast("string").alias("b"))
    for seed in range(5):
        c = kp.random_init(f, [], ["a", "b"], 8, seed)
        assert len({tuple(x) for x in c.cat}) == 8
    assert kp.random_init(f, [], ["a"], 5, 0).k == 5


@pytest.mark.parametrize("text, want", [('{ oops {"a":1}', '{"a":1}'), ('see {x] then {"a":1}', '{"a":1}'), ('{"a": "x" [ }', '{"a": "x" [ }'),
                                        ('{"u: {}', '{}'), ('{"a": "\\\\"} {"b": 1}', '{"a": "\\\\"}')])
def test_balanced_object(text, want):
    assert rp.balanced_json_py(text) == want


def test_first_opener_decides_for_objects_or_arrays():
    assert rp.balanced_json_py('{ oops [1]', allow_array=True) is None
    assert rp.balanced_json_py('x [1, "]", 2] {"a": 1}', allow_array=True) == '[1, "]", 2]'


def test_persona_counts_are_standing_assignments(spark):
    from hearth.plans.refine_loop import fit_table_scorer, run_refinement
    h = spark.range(600).select(F.col("id").alias("hid"), (F.col("id") % 3).cast("int").alias("cluster"),
                                ((F.col("id") * 7) % 50).cast("double").alias("x"), (F.col("id") % 4).cast("string").alias("c"))
    res = run_refinement(h, ["x"], ["c"], fit_table_scorer(lambda hid, p: ((hid * 7919 + p * 31) % 1000) / 1000.0), max_iterations=2, n_init=2, max_iter=10)
    first = {r["persona_id"]: r["num_assigned"] for r in res.persona_state.collect()}
    assert all(n >= 0 for n in first.values())
    validated = {r["p"]: r["n"] for r in res.state.where(F.col("status") == rf.VALIDATED).groupBy(F.col("last_valid_persona").alias("p")).agg(F.count("*").alias("n")).collect()}
    assert all(first.get(p, 0) >= n for p, n in validated.items()) and sum(first.values()) >= sum(validated.values())
    assert [r["iteration"] for r in res.history] == list(range(1, len(res.history) + 1))
