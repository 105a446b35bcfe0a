"""Registered queries: category detection, prompt guides, stalled iterations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.functions import persona_guides as pg
from hearth.functions import persona_text as pt
from hearth.operators import quota as qo
from hearth.operators import refine as rf
from hearth.oracle import with_views
from hearth.plans.q_quota import CTES
from hearth.plans.registry import register
from hearth.sources.tables import candidates


def _sql(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({names})"


# categories by document source; every second source speaks of more than its languages do
_GROUPS = """SELECT short_label AS grp, CASE WHEN length(short_label) % 2 = 0 THEN 'psid' ELSE 'ces' END AS dataset,
    CASE WHEN seq % 7 = 0 AND short_label LIKE '%1' THEN 'housing_behavior' WHEN short_label LIKE '%5' THEN 'other' ELSE category END AS category
    FROM candidates"""


def _groups(spark, sf_dir):
    g = F.col("short_label")
    return candidates(spark, sf_dir).select(
        g.alias("grp"), F.when(F.length(g) % 2 == 0, "psid").otherwise("ces").alias("dataset"),
        F.when((F.col("seq") % 7 == 0) & g.like("%1"), "housing_behavior").when(g.like("%5"), "other").otherwise(F.col("category")).alias("category"))


@register("decision_sections", with_views(f"""
SELECT DISTINCT grp, pos, section FROM g JOIN {_values(pg.section_rows(), 'category, section, pos')} USING (category)
UNION ALL SELECT DISTINCT grp, 100, '{pg.GENERAL_SECTION}' FROM g WHERE grp NOT IN (
  SELECT grp FROM g JOIN {_values(pg.section_rows(), 'category, section, pos')} USING (category) WHERE section <> '{pg.BIAS_SECTION}')""",
                                       "candidates", extra=[("g", _GROUPS)]))
def q_decision_sections(spark, sf_dir):
    return pg.decision_sections(_groups(spark, sf_dir))


# the text dimension: what the documents of a category's candidates say first, by category and by dataset
_LINES = f"""SELECT 'behaviour' AS kind, NULL AS for_dataset, category, pos, line FROM {_values(enumerate(pg.BEHAVIOUR_CATEGORIES), 'pos, category')}
    JOIN said USING (category)
    UNION ALL SELECT 'behaviour', NULL, NULL, 0, min(line) FROM said
    UNION ALL SELECT 'context', for_dataset, category, pos, for_dataset || ': ' || line
    FROM {_values([(d, c, i) for d, cats in pg.CONTEXT_CATEGORIES.items() for i, c in enumerate(cats)], 'for_dataset, category, pos')} JOIN said USING (category)"""


def _lines(spark, sf_dir):
    said = _groups(spark, sf_dir).groupBy("category").agg(F.concat(F.lit("seen in "), F.min("grp"), F.lit(" to "), F.max("grp")).alias("line"))
    known = pg.default_lines(spark).drop("line")
    line = F.when(F.col("kind") == "context", F.concat("for_dataset", F.lit(": "), "line")).otherwise(F.col("line"))
    named = known.join(said, "category").select("kind", "for_dataset", "category", "pos", line.alias("line"))
    general = said.agg(F.min("line").alias("line")).select(F.lit("behaviour").alias("kind"), F.lit(None).cast("string").alias("for_dataset"),
                                                           F.lit(None).cast("string").alias("category"), F.lit(0).alias("pos"), "line")
    return named.unionByName(general)


@register("guidance_lines", with_views("""
SELECT e.grp, coalesce(b.t, (SELECT '* ' || line FROM l WHERE category IS NULL)) AS behaviour, coalesce(c.t, '') AS context
FROM (SELECT DISTINCT grp FROM g) e
LEFT JOIN (SELECT grp, string_agg('* ' || line, chr(10) ORDER BY pos) AS t FROM (SELECT DISTINCT grp, pos, line FROM g JOIN l USING (category)
           WHERE kind = 'behaviour') GROUP BY grp) b USING (grp)
LEFT JOIN (SELECT grp, string_agg('* ' || line, chr(10) ORDER BY pos) AS t FROM (SELECT DISTINCT grp, pos, line FROM g JOIN l USING (category)
           WHERE kind = 'context' AND for_dataset = dataset) GROUP BY grp) c USING (grp)""", "candidates", extra=[
    ("g", _GROUPS), ("said", "SELECT category, 'seen in ' || min(grp) || ' to ' || max(grp) AS line FROM g GROUP BY category"), ("l", _LINES)]))
def q_guidance_lines(spark, sf_dir):
    return pg.guidance_lines(_groups(spark, sf_dir), _lines(spark, sf_dir))


_FIELDS = """SELECT var_id || CASE seq % 4 WHEN 0 THEN '_mean' WHEN 1 THEN '_std' WHEN 2 THEN '_mode' ELSE '' END AS field FROM candidates
    UNION ALL SELECT 'avg_' || event_type || '_share' FROM events"""


@register("detect_categories", with_views(f"""
SELECT DISTINCT m.category FROM (SELECT regexp_replace(field, '_(mean|median|mode)$', '') AS var_id FROM f) b JOIN w1 m USING (var_id)
WHERE m.category IS NOT NULL AND m.category <> ''
UNION SELECT k.category FROM f JOIN {_values([(c, t) for c, ts in pt.CATEGORY_KEYWORDS.items() for t in ts], 'category, token')}
AS k(category, token) ON contains(lower(f.field), k.token)""".replace("AS t(category, token)\nAS k", "AS k"),
                                          "candidates", extra=[*CTES[:4], ("f", _FIELDS)]))
def q_detect_categories(spark, sf_dir):
    c = candidates(spark, sf_dir)
    tail = F.element_at(F.array(F.lit("_mean"), F.lit("_std"), F.lit("_mode"), F.lit("")), (F.col("seq") % 4 + 1).cast("int"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("avg_"), "event_type", F.lit("_share")).alias("field"))
    fields = c.select(F.concat("var_id", tail).alias("field")).unionByName(events).distinct()
    meta = qo.dedupe_first(qo.drop_unscored(c), columns=["category"])
    return pt.detect_categories(fields, meta)


@register("field_dictionary", with_views("""
SELECT string_agg(line, chr(10) ORDER BY ord) AS dictionary FROM (
  SELECT seq AS ord, '- ' || var_id || CASE WHEN cat <> '' THEN ' [' || cat || ']' ELSE '' END
         || CASE WHEN short <> '' THEN ': ' || short WHEN des <> '' THEN ': ' || des ELSE '' END
         || CASE WHEN short <> '' AND des <> '' AND lower(short) <> lower(des) THEN ' — ' || des ELSE '' END AS line
  FROM (SELECT seq, var_id, trim(coalesce(category, '')) AS cat, trim(coalesce(short_label, '')) AS short,
               trim(coalesce(nullif(trim(description), ''), var_name, '')) AS des FROM w1)
  WHERE des <> '' OR cat <> '' ORDER BY seq LIMIT 25)""", "candidates", extra=CTES[:4]))
def q_field_dictionary(spark, sf_dir):
    meta = qo.dedupe_first(qo.drop_unscored(candidates(spark, sf_dir)), columns=["seq", "category", "short_label", "description", "var_name"])
    return pt.field_dictionary(meta.select(F.col("var_id").alias("field"), F.col("seq").alias("ord")), meta.drop("seq"))


# a history of 40 iterations: idle and unchanged in the last four of every eight
_HISTORY = """SELECT i AS iteration, CASE WHEN i % 8 < 4 THEN n ELSE 0 END AS iter_validated, 0 AS iter_outliers, 0 AS iter_moved,
    10 AS n_validated, 2 AS n_problem, 1 AS n_pending, CASE WHEN i >= 30 THEN i ELSE 5 END AS n_personas, 0.5 AS coverage, 0.25 AS problem_rate,
    0 AS n_new_personas FROM (SELECT o_orderkey % 40 AS i, count(*) AS n FROM orders GROUP BY 1)"""


@register("stall_detection", f"""WITH h AS ({_HISTORY})
SELECT iteration, iter_validated = 0 AND coalesce(lag(iter_validated, 1) OVER w = 0 AND lag(iter_validated, 2) OVER w = 0
       AND lag(n_personas, 1) OVER w = n_personas AND lag(n_personas, 2) OVER w = n_personas, false) AS stalled
FROM h WINDOW w AS (ORDER BY iteration)""")
def q_stall_detection(spark, sf_dir):
    i = (F.col("o_orderkey") % 40).alias("iteration")
    h = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(i).agg(F.count("*").alias("n"))
    n = F.col("iteration")
    h = h.select("iteration", F.when(n % 8 < 4, F.col("n")).otherwise(0).alias("iter_validated"), F.lit(0).alias("iter_outliers"), F.lit(0).alias("iter_moved"),
                 F.lit(10).alias("n_validated"), F.lit(2).alias("n_problem"), F.lit(1).alias("n_pending"), F.when(n >= 30, n).otherwise(5).alias("n_personas"),
                 F.lit(0.5).alias("coverage"), F.lit(0.25).alias("problem_rate"), F.lit(0).alias("n_new_personas"))
    return rf.stall_detection(h).select("iteration", "stalled")
