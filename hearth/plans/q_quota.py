"""Registered queries: candidate parsing, dedupe, quota allocation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.operators import quota as qo
from hearth.oracle import with_views
from hearth.plans.registry import register
from hearth.sources.tables import candidates, codebook

PRIORITY_SQL = ("CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in qo.PRIORITY.items())
                + f" ELSE {qo.DEFAULT_PRIORITY} END")
HOLDOUT_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dataset, '{v}' AS var_id"
                                 for d, ids in qo.HOLDOUT.items() for v in ids)
T = qo.FIELD_TARGET

CTES = [
    ("f8", "SELECT * FROM candidates WHERE importance_score IS NOT NULL"),
    ("w1a", """SELECT * EXCLUDE (data_type), TRY_CAST(trim(importance_score) AS DOUBLE) AS importance,
                TRY_CAST(regexp_replace(usable_percentage, '[^0-9.]', '', 'g') AS DOUBLE) AS usable,
                CASE WHEN lower(trim(coalesce(category, ''))) = 'identifier' THEN 'identifier'
                     WHEN lower(trim(coalesce(data_type, ''))) = 'identifier' THEN 'categorical'
                     ELSE data_type END AS data_type
               FROM f8 WHERE var_id IS NOT NULL AND trim(var_id) <> ''
                 AND (importance_score IS NULL OR TRY_CAST(trim(importance_score) AS DOUBLE) IS NOT NULL)"""),
    ("w1b", """SELECT *, coalesce(importance, 5.0) * 10 * 0.7 + coalesce(usable, 100.0) * 0.3 AS composite_score
               FROM w1a"""),
    ("w1", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY var_id ORDER BY seq) AS _rn FROM w1b)
              WHERE _rn = 1"""),
    ("stats", """SELECT category, count(*) AS count, avg(coalesce(usable, 0.0)) AS avg_quality,
                 avg(coalesce(importance, 0.0)) AS avg_importance, min(seq) AS first_seen FROM w1 GROUP BY category"""),
    ("al", f"""SELECT *, CASE WHEN category = 'identifier' THEN 1.0
                              ELSE priority * ln(count + 1.0) * (avg_importance / 5) END AS alloc_score
               FROM (SELECT *, {PRIORITY_SQL} AS priority FROM stats)"""),
    ("alloc", f"""SELECT *, CAST(CASE WHEN category = 'identifier' THEN 1
                   ELSE greatest(least(CAST(floor(({T} - 1) * alloc_score / sum(alloc_score) OVER ()) AS BIGINT), count), 1)
                   END AS BIGINT) AS quota0 FROM al"""),
    ("a2", f"SELECT *, CAST({T} - sum(quota0) OVER () AS BIGINT) AS diff FROM alloc"),
    ("slots", """SELECT category, priority, first_seen, diff, unnest(generate_series(1, room)) AS round FROM (
                 SELECT *, CASE WHEN category <> 'identifier' AND diff > 0 THEN least(count - quota0, diff)
                                WHEN category <> 'identifier' AND diff < 0 THEN least(quota0, -diff) ELSE 0 END AS room
                 FROM a2) WHERE room > 0"""),
    ("taken", """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round,
                   CASE WHEN diff > 0 THEN -priority ELSE priority END, first_seen) AS _r FROM slots)
                 WHERE _r <= abs(diff)"""),
    ("quotas", """SELECT a2.* EXCLUDE (diff), quota0 + coalesce(d.delta, 0) AS quota FROM a2 LEFT JOIN
                  (SELECT category, CAST(count(*) * sign(any_value(diff)) AS BIGINT) AS delta FROM taken GROUP BY category) d
                  USING (category)"""),
    ("chosen", """SELECT * FROM (SELECT w1.*, row_number() OVER (PARTITION BY category ORDER BY composite_score DESC, seq)
                  AS rank FROM w1) JOIN (SELECT category, quota FROM quotas) USING (category) WHERE rank <= quota"""),
]


def q(body: str) -> str:
    return with_views(body, "candidates", "codebook", extra=CTES)


# all but the long texts
CARRIED = ["seq", "dataset", "var_name", "short_label", "category", "data_type", "importance", "usable", "composite_score"]


def _fields(spark, sf_dir, *more):
    return qo.dedupe_first(qo.drop_unscored(candidates(spark, sf_dir)), columns=[*CARRIED, *more])


def _quotas(spark, sf_dir):
    f = _fields(spark, sf_dir)
    return qo.quota_remainder(qo.quota_allocation(qo.category_stats(f)))


def _chosen(spark, sf_dir, *more):
    f = _fields(spark, sf_dir, *more)
    return qo.top_n_per_group(f, qo.quota_remainder(qo.quota_allocation(qo.category_stats(f))))


@register("parse_percent", q("""SELECT seq, TRY_CAST(regexp_replace(usable_percentage, '[^0-9.]', '', 'g') AS DOUBLE)
    AS usable FROM candidates"""))
def q_parse_percent(spark, sf_dir):
    return candidates(spark, sf_dir).select("seq", qo.parse_percent(F.col("usable_percentage")).alias("usable"))


@register("parse_score", q("""SELECT seq, TRY_CAST(trim(importance_score) AS DOUBLE) AS importance FROM candidates
    WHERE TRY_CAST(trim(importance_score) AS DOUBLE) IS NOT NULL"""))
def q_parse_score(spark, sf_dir):
    s = qo.parse_score(F.col("importance_score"))
    return candidates(spark, sf_dir).select("seq", s.alias("importance")).where(F.col("importance").isNotNull())


@register("normalize_data_type", q("SELECT seq, data_type FROM w1a"))
def q_normalize_data_type(spark, sf_dir):
    c = qo.drop_unscored(candidates(spark, sf_dir)).where(F.trim("var_id") != "")
    c = c.where(qo.parse_score(F.col("importance_score")).isNotNull())
    return c.select("seq", qo.normalize_data_type(F.col("category"), F.col("data_type")).alias("data_type"))


@register("drop_unscored_candidates", q("SELECT seq, var_id FROM f8"))
def q_drop_unscored(spark, sf_dir):
    return qo.drop_unscored(candidates(spark, sf_dir)).select("seq", "var_id")


@register("exclude_holdout_fields", q(f"""
SELECT seq, var_id FROM candidates c WHERE NOT EXISTS (
  SELECT 1 FROM ({HOLDOUT_SQL} UNION ALL SELECT DISTINCT 'psid', var_id FROM candidates WHERE toxic = 1) h
  WHERE h.dataset = c.dataset AND h.var_id = c.var_id)"""))
def q_exclude_holdout(spark, sf_dir):
    c = candidates(spark, sf_dir)
    held = qo.holdout_table(spark).unionByName(
        c.where(F.col("toxic") == 1).select(F.lit("psid").alias("dataset"), "var_id").distinct())
    # the toxic-derived part grows with the data, so it is a shuffle join
    return c.join(held, ["dataset", "var_id"], "left_anti").select("seq", "var_id")


@register("composite_score", q("SELECT seq, composite_score FROM w1b"))
def q_composite(spark, sf_dir):
    c = qo.drop_unscored(candidates(spark, sf_dir)).where(F.trim("var_id") != "")
    imp = qo.parse_score(F.col("importance_score"))
    c = c.where(imp.isNotNull())
    return c.select("seq", qo.composite_score(imp, qo.parse_percent(F.col("usable_percentage"))).alias("composite_score"))


@register("dedupe_first", q("SELECT var_id, seq, composite_score, data_type FROM w1"))
def q_dedupe(spark, sf_dir):
    return _fields(spark, sf_dir).select("var_id", "seq", "composite_score", "data_type")


@register("category_stats", q("SELECT category, count, avg_quality, avg_importance FROM stats"))
def q_category_stats(spark, sf_dir):
    return qo.category_stats(_fields(spark, sf_dir)).drop("first_seen")


@register("quota_allocation", q("SELECT category, priority, alloc_score, quota0 FROM alloc"))
def q_quota_allocation(spark, sf_dir):
    return qo.quota_allocation(qo.category_stats(_fields(spark, sf_dir))).select(
        "category", "priority", "alloc_score", "quota0")


@register("quota_remainder", q("SELECT category, quota0, quota FROM quotas"))
def q_quota_remainder(spark, sf_dir):
    return _quotas(spark, sf_dir).select("category", "quota0", "quota")


@register("top_n_per_group", q("SELECT category, var_id, seq, rank FROM chosen"))
def q_top_n(spark, sf_dir):
    return _chosen(spark, sf_dir).select("category", "var_id", "seq", F.col("rank").cast("long").alias("rank"))


@register("quota_report", q("""SELECT category, quota AS allocated, count AS available,
    CASE WHEN count > 0 THEN CAST(quota AS DOUBLE) / count * 100.0 ELSE 0.0 END AS utilization,
    greatest(count - quota, 0) AS filtered FROM quotas"""))
def q_quota_report(spark, sf_dir):
    return qo.quota_report(_quotas(spark, sf_dir))


@register("final_category_summary", q("""SELECT category, count(*) AS n, avg(coalesce(usable, 0.0)) AS avg_quality,
    avg(coalesce(importance, 0.0)) AS avg_importance FROM chosen GROUP BY category"""))
def q_final_summary(spark, sf_dir):
    return qo.final_category_summary(_chosen(spark, sf_dir))


@register("category_digest", q("""SELECT category, count(*) AS n,
    string_agg(CASE WHEN rank <= 10 THEN printf('- %s: %s (usable: %.1f%%)', var_id, coalesce(var_name, ''),
               coalesce(usable, 0.0)) END, chr(10) ORDER BY rank) AS listing,
    greatest(count(*) - 10, 0) AS n_more FROM chosen GROUP BY category"""))
def q_category_digest(spark, sf_dir):
    return qo.category_digest(_chosen(spark, sf_dir))


@register("align_with_codebook", q("""SELECT c.var_id, c.seq,
    coalesce(nullif(cb.label, ''), c.var_name) AS var_name,
    coalesce(nullif(cb.description, ''), c.description) AS description
    FROM chosen c LEFT JOIN codebook cb ON trim(c.var_id) = trim(cb.var_id)"""))
def q_align(spark, sf_dir):
    return qo.align_with_codebook(_chosen(spark, sf_dir, "description"), codebook(spark, sf_dir)).select(
        "var_id", "seq", "var_name", "description")
