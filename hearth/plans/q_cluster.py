"""Registered queries: cluster sizes, small-cluster filter, cluster profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.operators import cluster_stats as cs
from hearth.oracle import sql_mode, with_views
from hearth.plans.registry import register
from hearth.sources.tables import (HOUSEHOLD_CATEGORICAL, HOUSEHOLD_CONTINUOUS,
                                   households_labeled)

_C8_SQL = """
c8_sz AS (SELECT cluster, count(*) AS n FROM households_labeled GROUP BY cluster),
c8_thr AS (SELECT greatest(5, round_even(0.01 * sum(n), 0)) AS t FROM c8_sz),
c8 AS (SELECT h.*, CAST(CASE WHEN s.n < (SELECT t FROM c8_thr) THEN -1 ELSE h.cluster END AS INTEGER) AS label
       FROM households_labeled h JOIN c8_sz s USING (cluster))"""


def _c8(body: str) -> str:
    sql = with_views("SELECT 1", "households_labeled")
    return sql.replace("\nSELECT 1", "," + _C8_SQL + "\n" + body)


@register("cluster_sizes", with_views("""
SELECT cluster, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percentage
FROM households_labeled GROUP BY cluster""", "households_labeled"))
def q_cluster_sizes(spark, sf_dir):
    return cs.cluster_sizes(households_labeled(spark, sf_dir))


@register("filter_small_clusters", _c8("SELECT hid, label AS cluster FROM c8"))
def q_filter_small_clusters(spark, sf_dir):
    return cs.filter_small_clusters(households_labeled(spark, sf_dir)).select("hid", "cluster")


def _profile_sql() -> str:
    sel = ["c.label AS cluster_id", "count(*) AS n_samples",
           "count(*) * 100.0::DOUBLE / (SELECT count(*) FROM c8) AS percentage"]
    for f in HOUSEHOLD_CONTINUOUS:
        sel += [f"avg(c.{f}) AS {f}_mean", f"stddev_samp(c.{f}) AS {f}_std"]
    sel += [f"any_value(m_{f}.{f}_mode) AS {f}_mode" for f in HOUSEHOLD_CATEGORICAL]
    joins = "".join(
        f" LEFT JOIN ({sql_mode('c8', ['label'], f, f + '_mode')}) m_{f} ON m_{f}.label = c.label"
        for f in HOUSEHOLD_CATEGORICAL)
    return _c8(f"SELECT {', '.join(sel)} FROM c8 c{joins} WHERE c.label <> -1 GROUP BY c.label")


@register("cluster_profiles", _profile_sql())
def q_cluster_profiles(spark, sf_dir):
    labeled = cs.filter_small_clusters(households_labeled(spark, sf_dir))
    return cs.cluster_profiles(labeled, HOUSEHOLD_CONTINUOUS, HOUSEHOLD_CATEGORICAL)


@register("cluster_balance", _c8("""
SELECT count(*) AS k, min(n) * 1.0::DOUBLE / sum(n) AS min_share,
       count(*) FILTER (WHERE n < greatest(10.0, 0.01 * t)) * 1.0::DOUBLE / count(*) AS small_share,
       max(n) * 1.0::DOUBLE / min(n) AS imbalance
FROM (SELECT label, count(*) AS n FROM c8 WHERE label <> -1 GROUP BY label),
     (SELECT count(*) FILTER (WHERE label <> -1) AS t FROM c8)"""))
def q_cluster_balance(spark, sf_dir):
    labeled = cs.filter_small_clusters(households_labeled(spark, sf_dir))
    sizes = cs.cluster_sizes(labeled).where(F.col("cluster") != cs.NOISE)
    return cs.cluster_balance(sizes)
