"""Registered queries: name/metadata field rules (F2-F4), selection validation
(W8), sample distributions (A17), unique rows (A22), histograms (A23) and the
composed clustering job (C14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.operators import clean as cl
from hearth.operators import profile as pf
from hearth.oracle import with_views
from hearth.plans.registry import register
from hearth.sources.tables import HOUSEHOLD_CONTINUOUS, candidates, households, labeled

PATTERNS = pf.DEFAULT_EXCLUDED_PATTERNS + [r"v1"]
FORCE = ["v10"]
_NAME_SQL = "CASE WHEN seq % 5 = 0 THEN short_label || '_id' ELSE var_id END"
_FIELDS = [("fields", f"""SELECT seq, {_NAME_SQL} AS name, category, data_type FROM candidates""")]


def _fields(spark, sf_dir):
    c = candidates(spark, sf_dir)
    name = F.when(F.col("seq") % 5 == 0, F.concat(F.col("short_label"), F.lit("_id"))).otherwise(F.col("var_id"))
    return c.select("seq", name.alias("name"), "category", "data_type")


def _pat_sql(col: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '^(?:{p}).*', 'i')" for p in PATTERNS) + ")"


@register("exclude_by_pattern", with_views(f"""
SELECT seq, name, name IN ({', '.join(repr(f) for f in FORCE)}) OR NOT {_pat_sql('name')} AS kept FROM fields""",
    "candidates", extra=_FIELDS))
def q_f2(spark, sf_dir):
    f = _fields(spark, sf_dir)
    kept = F.col("name").isin(FORCE) | ~cl.excluded_by_pattern_col(F.col("name"), PATTERNS)
    return f.select("seq", "name", kept.alias("kept"))


_ID_SQL = ("(CASE WHEN name IS NULL OR trim(name) = '' THEN false ELSE "
           "lower(trim(coalesce(category, ''))) = 'identifier' OR lower(trim(coalesce(data_type, ''))) = 'identifier' "
           "OR regexp_matches(name, '(?:^|[_\\\\-])(id|identifier)(?:$|[_\\\\-])', 'i') END)")


@register("is_identifier_field", with_views(f"SELECT seq, name, {_ID_SQL} AS is_identifier FROM fields",
                                            "candidates", extra=_FIELDS))
def q_f3(spark, sf_dir):
    f = _fields(spark, sf_dir)
    return f.select("seq", "name", cl.is_identifier_col(F.col("name"), F.col("category"), F.col("data_type"))
                    .alias("is_identifier"))


@register("drop_identifier_fields", with_views(f"""
SELECT name, min(seq) AS seq FROM (SELECT *, {_ID_SQL} AS is_identifier FROM fields)
WHERE name IN ({', '.join(repr(f) for f in FORCE)}) OR NOT is_identifier GROUP BY name""", "candidates", extra=_FIELDS))
def q_f4(spark, sf_dir):
    f = _fields(spark, sf_dir)
    f = f.withColumn("is_identifier", cl.is_identifier_col(F.col("name"), F.col("category"), F.col("data_type")))
    return cl.drop_identifier_rows(f, force_include=FORCE)


# ---------------------------------------------------------------- A17, A22, A23, W8, C14

from hearth.operators import cluster_stats as cs  # noqa: E402
from hearth.operators import refine as rf  # noqa: E402
from hearth.plans.q_profile import _SEL, _selection  # noqa: E402
from hearth.plans.sqlgen import build  # noqa: E402


@register("sample_distributions", with_views("""
SELECT cluster, field, value, count(*) AS n FROM (
  SELECT cluster, 'status' AS field, status AS value FROM s50 UNION ALL SELECT cluster, 'priority', priority FROM s50)
GROUP BY ALL""", "labeled", extra=[("s50", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster
    ORDER BY md5('42:' || CAST(hid AS VARCHAR)), hid) AS r FROM labeled WHERE cluster <> -1) WHERE r <= 50""")]))
def q_a17(spark, sf_dir):
    s = rf.per_cluster_sample(labeled(spark, sf_dir).where(F.col("cluster") != -1), 50, 42)
    return cs.sample_distributions(s, ["age_group", "marital_status", "education_level", "family_type",
                                       "status", "priority"])


@register("unique_row_count", with_views("""
SELECT count(*) AS n_unique FROM (SELECT DISTINCT round(total, 6), round(qty_avg, 6), trim(status), trim(priority), n_lines
                                  FROM households)""", "households"))
def q_a22(spark, sf_dir):
    return cs.unique_row_count(households(spark, sf_dir), ["total", "qty_avg", "status", "priority", "n_lines"])


@register("histogram_by_cluster", with_views("""
WITH_PLACEHOLDER""", "labeled"))
def q_a23(spark, sf_dir):
    lab = labeled(spark, sf_dir).where(F.col("cluster") != -1)
    return cs.histogram_by_cluster(lab, HOUSEHOLD_CONTINUOUS)


def _hist_sql() -> str:
    long = " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM labeled WHERE cluster <> -1"
                              for c in HOUSEHOLD_CONTINUOUS)
    return with_views("""
SELECT g.cluster, g.feature, g.bin,
       CASE WHEN hi - lo = 0 THEN lo - 0.5 + g.bin / 20.0 ELSE lo + (hi - lo) * g.bin / 20.0 END AS left_edge,
       coalesce(c.n, 0) AS n
FROM (SELECT r.*, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM rng r) g
LEFT JOIN (SELECT l.cluster, l.feature, CAST(CASE WHEN hi - lo = 0 THEN 10 ELSE least(floor((x - lo) / (hi - lo) * 20), 19) END AS INTEGER) AS bin,
                  count(*) AS n FROM hl l JOIN rng USING (cluster, feature) GROUP BY ALL) c USING (cluster, feature, bin)""",
                      "labeled", extra=[("hl", f"SELECT * FROM ({long}) WHERE x IS NOT NULL AND NOT isnan(x)"),
                                        ("rng", "SELECT cluster, feature, min(x) AS lo, max(x) AS hi FROM hl GROUP BY ALL")])


from hearth.plans.registry import ORACLE  # noqa: E402

ORACLE["histogram_by_cluster"] = _hist_sql()

_W8 = _SEL + [("entries", """
  SELECT CAST(sel_ord AS BIGINT) AS sel_ord, field_name, type AS req_type FROM sel
  UNION ALL SELECT CAST(sel_ord + 100 AS BIGINT), field_name, NULL FROM sel
  UNION ALL SELECT 1000, 'no_such_column', 'continuous' FROM (SELECT 1)
  UNION ALL SELECT 1000000000, 'n_lines', NULL FROM (SELECT 1)"""),
              ("known", """SELECT e.*, p.field_type FROM entries e JOIN p_prof p USING (field_name)"""),
              ("typed", """SELECT sel_ord, field_name, CASE WHEN lower(req_type) IN ('continuous', 'categorical') THEN lower(req_type)
                           WHEN field_type = 'continuous' THEN 'continuous' ELSE 'categorical' END AS type FROM known"""),
              ("firsts", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY sel_ord) AS r FROM typed)
                            WHERE r = 1""")]


@register("validate_selection", build(_W8, """
SELECT pos, field_name, type FROM (SELECT row_number() OVER (ORDER BY sel_ord) AS pos, field_name, type FROM firsts)
WHERE pos <= 50"""))
def q_w8(spark, sf_dir):
    sel = _selection(spark, sf_dir)
    prof = pf.field_profile(households(spark, sf_dir))
    entries = (sel.select(F.col("sel_ord").cast("long").alias("sel_ord"), "field_name", "type")
               .unionByName(sel.select((F.col("sel_ord") + 100).cast("long").alias("sel_ord"), "field_name",
                                       F.lit(None).cast("string").alias("type")))
               .unionByName(sel.limit(1).select(F.lit(1000).cast("long").alias("sel_ord"),
                                                F.lit("no_such_column").alias("field_name"),
                                                F.lit("continuous").alias("type"))))
    return pf.validate_selection(entries, prof, force_include=["n_lines"]).select(
        F.col("pos").cast("long").alias("pos"), "field_name", "type")


@register("cluster_pipeline")
def q_c14(spark, sf_dir):
    from hearth.plans.cluster_job import run_cluster_job
    h = households(spark, sf_dir)
    res = run_cluster_job(h, id_col="hid", excluded_patterns=pf.DEFAULT_EXCLUDED_PATTERNS + [r"o_"])
    return res.profiles
