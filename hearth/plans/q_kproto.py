"""Registered queries: assignment, centroid update, cost (exact, fixed centres)
and the seeded fits (property-checked, rows only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.functions.stats import collect_bounded
from hearth.operators import impute as imp
from hearth.operators import kprototypes as kp
from hearth.plans.q_profile import IMP, _rules
from hearth.plans.registry import register
from hearth.plans.sqlgen import build
from hearth.sources.tables import HOUSEHOLD_CATEGORICAL, HOUSEHOLD_CONTINUOUS, households

NUM = list(HOUSEHOLD_CONTINUOUS)
CAT = list(HOUSEHOLD_CATEGORICAL)
K_FIXED = 4


def features(spark, sf_dir, num=NUM, cat=CAT):
    """Imputed, z-scored household features as flat columns."""
    h = households(spark, sf_dir)
    filled = imp.impute(h, HOUSEHOLD_CONTINUOUS, HOUSEHOLD_CATEGORICAL, _rules(h), keep=["hid"])
    z = imp.zscore(filled, HOUSEHOLD_CONTINUOUS, keep=["hid"] + HOUSEHOLD_CATEGORICAL)
    return z.select("hid", *num, *cat)


def fixed_centroids(feats) -> kp.Centroids:
    """The K_FIXED households with the smallest md5(hid) (same rows in any engine)."""
    rows = collect_bounded(feats.orderBy(F.md5(F.col("hid").cast("string"))).limit(K_FIXED),
                           K_FIXED, "centroids")
    return kp.centroids_from_rows(rows, NUM, CAT)


_ZS = ("zs", "SELECT " + ", ".join(
    f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) < 2.220446049250313e-15 "
    f"THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in HOUSEHOLD_CONTINUOUS) + " FROM imp")
_FEAT = ("feat", "SELECT hid, " + ", ".join(f"({c} - a_{c}) / s_{c} AS {c}" for c in NUM) + ", "
         + ", ".join(CAT) + " FROM imp, zs")
_CENT = ("cent", f"""SELECT CAST(row_number() OVER (ORDER BY md5(CAST(hid AS VARCHAR))) - 1 AS INTEGER) AS cid, *
                    FROM feat QUALIFY row_number() OVER (ORDER BY md5(CAST(hid AS VARCHAR))) <= {K_FIXED}""")
_DIST = ("dist", "SELECT f.hid, c.cid, " + " + ".join(f"pow(f.{n} - c.{n}, 2)" for n in NUM)
         + " + 0.5 * (" + " + ".join(f"CAST(f.{a} IS DISTINCT FROM c.{a} AS DOUBLE)" for a in CAT)
         + ") AS dist FROM feat f, cent c")
_ASSIGN = ("asg", """SELECT hid, cid AS cluster, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY hid ORDER BY dist, cid) AS rn FROM dist) WHERE rn = 1""")
_C = IMP + [_ZS, _FEAT, _CENT, _DIST, _ASSIGN]


@register("assemble_features", build(IMP + [_ZS, _FEAT], "SELECT hid, " + ", ".join(f"{c} AS num_{i}" for i, c in enumerate(NUM))
                                     + ", " + ", ".join(f"{c} AS cat_{i}" for i, c in enumerate(CAT)) + " FROM feat"))
def q_assemble(spark, sf_dir):
    """I8 over the imputed, z-scored households; the two arrays laid out by position."""
    a = imp.assemble_features(features(spark, sf_dir), NUM, CAT)
    return a.select("hid", *[F.col("num")[i].alias(f"num_{i}") for i in range(len(NUM))], *[F.col("cat")[i].alias(f"cat_{i}") for i in range(len(CAT))])


@register("assign_mixed", build(_C, "SELECT hid, cluster, dist FROM asg"))
def q_assign_mixed(spark, sf_dir):
    f = features(spark, sf_dir)
    return kp.assign(f, NUM, CAT, fixed_centroids(f))


def _mode_sql(col: str) -> str:
    return (f"(SELECT {col} FROM (SELECT a2.cluster AS cl, f2.{col}, count(*) AS n FROM asg a2 JOIN feat f2 USING (hid) "
            f"GROUP BY ALL) WHERE cl = a.cluster ORDER BY n DESC, {col} LIMIT 1)")


@register("update_centroids", build(_C, "SELECT a.cluster, count(*) AS n, " + ", ".join(
    f"avg(f.{c}) AS n{i}" for i, c in enumerate(NUM)) + ", " + ", ".join(
    f"any_value({_mode_sql(c)}) AS c{i}" for i, c in enumerate(CAT))
    + " FROM asg a JOIN feat f USING (hid) GROUP BY a.cluster"))
def q_update_centroids(spark, sf_dir):
    f = features(spark, sf_dir)
    a = kp.assign(f, NUM, CAT, fixed_centroids(f))
    return kp.update_centroids(a.join(f, "hid"), NUM, CAT)


@register("clustering_cost", build(_C, "SELECT sum(dist) AS cost, count(*) AS n FROM asg"))
def q_clustering_cost(spark, sf_dir):
    f = features(spark, sf_dir)
    return kp.clustering_cost(kp.assign(f, NUM, CAT, fixed_centroids(f)))


def _fit_labels(spark, sf_dir, num, cat, k, n_init):
    f = features(spark, sf_dir, num, cat)
    res = kp.fit(f, num, cat, k, n_init=n_init)
    return kp.assign(f, num, cat, res.centroids)


@register("kprototypes_fit")
def q_kprototypes_fit(spark, sf_dir):
    return _fit_labels(spark, sf_dir, NUM, CAT, 4, 10)


@register("kmodes_fit")
def q_kmodes_fit(spark, sf_dir):
    return _fit_labels(spark, sf_dir, [], CAT, 4, 5)


@register("cao_init")
def q_cao_init(spark, sf_dir):
    f = features(spark, sf_dir)
    c = kp.cao_init(f, NUM, CAT, 4)
    # the chosen centres, as the households they came from (joined back on values)
    rows = [(j, *c.num[j], *c.cat[j]) for j in range(c.k)]
    cdf = spark.createDataFrame(rows, "cid int, " + ", ".join(f"{n} double" for n in NUM) + ", "
                                + ", ".join(f"{a} string" for a in CAT))
    return f.join(F.broadcast(cdf), NUM + CAT).select("cid", "hid", *NUM, *CAT)
