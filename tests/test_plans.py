"""Plan-shape guards: no cartesian / nested-loop joins anywhere; per-group
top-n and samples are limited map-side before their shuffle."""

from hearth.plans.registry import QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"
# iterative jobs run their fits while building the plan; their joins are the same operators checked here
SKIP = {"refine_loop", "cluster_pipeline", "k_sweep_fit", "recluster_outliers", "k_sweep_kmodes",
        "kprototypes_fit", "kmodes_fit"}


def _plan(spark, key):
    return QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins(spark):
    bad = []
    for key in QUERIES:
        if key in SKIP:
            continue
        plan = _plan(spark, key)
        bad += [(key, t) for t in ("CartesianProduct", "BroadcastNestedLoopJoin") if t in plan]
    assert not bad


def test_partial_group_limits(spark):
    for key in ("per_cluster_sample", "top_n_per_group", "capped_cluster_sample"):
        plan = _plan(spark, key)
        assert "WindowGroupLimit" in plan and "Partial" in plan, key
