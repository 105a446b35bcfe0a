"""Registered queries: profiling, cleaning, structural missingness, imputation, k."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.functions.stats import collect_bounded
from hearth.operators import impute as imp
from hearth.operators import kselect as ks
from hearth.operators import profile as pf
from hearth.plans.registry import register
from hearth.plans.sqlgen import HOUSEHOLD_SCHEMA, build, impute_ctes, profile_ctes, rules_ctes, token_sql
from hearth.sources.tables import HOUSEHOLD_CATEGORICAL, HOUSEHOLD_CONTINUOUS, households, table

H = "households"
PROF = profile_ctes(H, HOUSEHOLD_SCHEMA)
TARGETS = [(c, True) for c in HOUSEHOLD_CONTINUOUS] + [(c, False) for c in HOUSEHOLD_CATEGORICAL]
RULES = rules_ctes(H, HOUSEHOLD_SCHEMA, TARGETS)
IMP = RULES + impute_ctes(H, HOUSEHOLD_CONTINUOUS, HOUSEHOLD_CATEGORICAL)
PROFILE_COLS = ["field_name", "field_type", "completeness", "n_unique", "variance_score",
                "quality_score", "is_numeric", "dominant_ratio"]
EXCLUDED = pf.DEFAULT_EXCLUDED_PATTERNS + [r"^o_"]


def _profile(spark, sf_dir):
    return pf.field_profile(households(spark, sf_dir))


@register("field_profile", build(PROF, f"SELECT {', '.join(PROFILE_COLS)} FROM p_prof"))
def q_field_profile(spark, sf_dir):
    return _profile(spark, sf_dir).select(*PROFILE_COLS)


@register("dispersion_score", build(PROF, """
SELECT field_name, mean, std, q25, q50, q75, variance_score FROM p_prof WHERE field_type = 'continuous'"""))
def q_dispersion(spark, sf_dir):
    return _profile(spark, sf_dir).where(F.col("field_type") == "continuous").select(
        "field_name", "mean", "std", "q25", "q50", "q75", "variance_score")


@register("entropy_score", build(PROF, """
SELECT field_name, field_type, entropy_ln, variance_score FROM p_prof
WHERE field_type IN ('categorical', 'binary', 'constant', 'high_cardinality')"""))
def q_entropy(spark, sf_dir):
    return _profile(spark, sf_dir).where(F.col("field_type") != "continuous").select(
        "field_name", "field_type", "entropy_ln", "variance_score")


@register("dominant_ratio", build(PROF, "SELECT field_name, n_missing, dominant_ratio FROM p_prof"))
def q_dominant(spark, sf_dir):
    return _profile(spark, sf_dir).select("field_name", "n_missing", "dominant_ratio")


def _excl_sql(col: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '^(?:{p.lstrip('^')})', 'i')" for p in EXCLUDED) + ")"


_CLEAN = PROF + [("dec", f"""
SELECT field_name, ord, 1.0 - completeness AS null_rate, dominant_ratio AS top_share,
  CASE WHEN 1.0 - completeness > 0.5 THEN 'missing'
       WHEN {_excl_sql('field_name')} THEN NULL
       WHEN dominant_ratio IS NULL OR dominant_ratio >= 0.95 THEN 'constant' END AS reason
FROM p_prof""")]


def _decisions(spark, sf_dir):
    return pf.cleaning_decisions(_profile(spark, sf_dir), EXCLUDED)


@register("drop_high_missing", build(_CLEAN, "SELECT field_name, null_rate, coalesce(reason = 'missing', false) AS dropped FROM dec"))
def q_drop_high_missing(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return d.select("field_name", "null_rate", F.coalesce(F.col("reason") == "missing", F.lit(False)).alias("dropped"))


@register("drop_near_constant", build(_CLEAN, """
SELECT field_name, top_share, coalesce(reason = 'constant', false) AS dropped FROM dec
WHERE reason IS NULL OR reason <> 'missing'"""))
def q_drop_near_constant(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return d.where(F.col("reason").isNull() | (F.col("reason") != "missing")).select(
        "field_name", "top_share", F.coalesce(F.col("reason") == "constant", F.lit(False)).alias("dropped"))


@register("cleaning_report", build(_CLEAN, "SELECT field_name, reason FROM dec WHERE reason IS NOT NULL"))
def q_cleaning_report(spark, sf_dir):
    return _decisions(spark, sf_dir).where(F.col("reason").isNotNull()).select("field_name", "reason")


@register("gate_candidates", build(RULES, "SELECT field_name FROM gates"))
def q_gate_candidates(spark, sf_dir):
    return pf.gate_candidates(_profile(spark, sf_dir)).select("field_name")


def _gates(spark, sf_dir, h):
    prof = pf.field_profile(h)
    return [r.field_name for r in collect_bounded(pf.gate_candidates(prof).orderBy("ord"), 100_000, "gates")]


def _rates(spark, sf_dir):
    h = households(spark, sf_dir)
    return imp.gate_missing_rates(h, _gates(spark, sf_dir, h), dict(TARGETS))


@register("gate_missing_rates", build(RULES, """
SELECT gate, level, size, target, n_miss, rate FROM rates"""))
def q_gate_missing_rates(spark, sf_dir):
    return _rates(spark, sf_dir).select("gate", "level", "size", "target", "n_miss", "rate")


@register("structural_rules", build(RULES, """
SELECT target, gate_col, array_to_string(gate_values, ',') AS gate_values, explained, max_rate, min_rate, score
FROM rules"""))
def q_structural_rules(spark, sf_dir):
    h = households(spark, sf_dir)
    n = h.count()
    rules = imp.structural_rules(imp.gate_missing_rates(h, _gates(spark, sf_dir, h), dict(TARGETS)),
                                 imp.min_group_size(n))
    return rules.select("target", "gate_col", F.array_join("gate_values", ",").alias("gate_values"),
                        "explained", "max_rate", "min_rate", "score")


def _rules(h):
    n = h.count()
    gates = [r.field_name for r in collect_bounded(pf.gate_candidates(pf.field_profile(h)).orderBy("ord"),
                                                   100_000, "gates")]
    return imp.find_rules(h, HOUSEHOLD_CONTINUOUS, HOUSEHOLD_CATEGORICAL, gates, n)


@register("fill_structural_numeric", build(IMP, "SELECT hid, " + ", ".join(HOUSEHOLD_CONTINUOUS) + " FROM s3"))
def q_fill_structural(spark, sf_dir):
    h = households(spark, sf_dir)
    return imp.impute(h, HOUSEHOLD_CONTINUOUS, [], _rules(h), keep=["hid"], real=False)


@register("fill_real_numeric", build(IMP, "SELECT hid, " + ", ".join(HOUSEHOLD_CONTINUOUS) + " FROM imp"))
def q_fill_real(spark, sf_dir):
    h = households(spark, sf_dir)
    return imp.impute(h, HOUSEHOLD_CONTINUOUS, [], _rules(h), keep=["hid"])


@register("fill_categorical", build(IMP, "SELECT hid, " + ", ".join(HOUSEHOLD_CATEGORICAL) + " FROM imp"))
def q_fill_categorical(spark, sf_dir):
    h = households(spark, sf_dir)
    return imp.impute(h, [], HOUSEHOLD_CATEGORICAL, _rules(h), keep=["hid"])


def _report_sql() -> str:
    parts = []
    for t, num in TARGETS:
        miss = f"h.{t} IS NULL" if num else f"(h.{t} IS NULL OR trim(CAST(h.{t} AS VARCHAR)) = '')"
        parts.append(f"""SELECT '{t}' AS field, (SELECT gate_col FROM rules WHERE target = '{t}') AS gate_col,
            count(*) FILTER (WHERE {miss} AND coalesce(g.in_gate, false)) AS n_structural,
            count(*) FILTER (WHERE {miss} AND NOT coalesce(g.in_gate, false)) AS n_real
            FROM households h LEFT JOIN ingate g ON g._id = h.hid AND g.target = '{t}'""")
    return " UNION ALL ".join(parts)


@register("imputation_report", build(IMP, _report_sql()))
def q_imputation_report(spark, sf_dir):
    h = households(spark, sf_dir)
    return imp.imputation_report(h, HOUSEHOLD_CONTINUOUS, HOUSEHOLD_CATEGORICAL, _rules(h))


@register("zscore", build(IMP + [("zs", "SELECT " + ", ".join(
    f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) < 2.220446049250313e-15 "
    f"THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in HOUSEHOLD_CONTINUOUS) + " FROM imp")],
    "SELECT hid, " + ", ".join(f"({c} - a_{c}) / s_{c} AS {c}" for c in HOUSEHOLD_CONTINUOUS) + " FROM imp, zs"))
def q_zscore(spark, sf_dir):
    h = households(spark, sf_dir)
    filled = imp.impute(h, HOUSEHOLD_CONTINUOUS, [], _rules(h), keep=["hid"])
    return imp.zscore(filled, HOUSEHOLD_CONTINUOUS, keep=["hid"])


# ------------------------------------------------------------------ F10-F12 on free text

@register("missing_token_predicate", f"""
SELECT conv_id, turn, {token_sql('text')} AS token_hit FROM conversations""")
def q_missing_token(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", imp.token_hit(F.col("text")).alias("token_hit"))


@register("blank_as_missing", build([], """
SELECT hid, (ret_status IS NULL OR trim(CAST(ret_status AS VARCHAR)) = '') AS ret_status_missing,
       (priority IS NULL OR trim(CAST(priority AS VARCHAR)) = '') AS priority_missing
FROM households"""))
def q_blank(spark, sf_dir):
    h = households(spark, sf_dir)
    return h.select("hid", imp.is_blank(F.col("ret_status")).alias("ret_status_missing"),
                    imp.is_blank(F.col("priority")).alias("priority_missing"))


@register("placeholder_filter", build(IMP, """
SELECT t, v, count(*) AS n FROM (
  SELECT 'ret_status' AS t, ret_status AS v FROM imp UNION ALL SELECT 'status', status FROM imp)
WHERE NOT (v IS NULL OR trim(v) = '' OR lower(trim(v)) IN ('missing', 'inapplicable', '<na>', 'nan'))
GROUP BY t, v"""))
def q_placeholder(spark, sf_dir):
    h = households(spark, sf_dir)
    filled = imp.impute(h, [], ["ret_status", "status"], _rules(h), keep=["hid"])
    long = filled.select(F.explode(F.array(
        F.struct(F.lit("ret_status").alias("t"), F.col("ret_status").alias("v")),
        F.struct(F.lit("status").alias("t"), F.col("status").alias("v")))).alias("c")).select("c.*")
    return long.where(~imp.is_placeholder(F.col("v"))).groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ choosing k

def _strip_sql(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"


def _a13_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS field, {i} AS ord, {_strip_sql(c)} AS v FROM households"
                              for i, c in enumerate(HOUSEHOLD_CATEGORICAL))
    return f"""
SELECT field, ord, n_unique, n_valid, entropy, norm_entropy, eff_levels,
       norm_entropy * log2(n_unique + 1.0) AS score,
       (n_unique BETWEEN 2 AND 25 AND n_valid >= 10 AND norm_entropy > 0.5) AS key
FROM (SELECT *, CASE WHEN n_unique > 1 AND log2(n_unique) > 0 THEN entropy / log2(n_unique) ELSE 0.0 END AS norm_entropy,
             CASE WHEN entropy > 0 THEN least(pow(2.0, entropy), CAST(n_unique AS DOUBLE)) ELSE CAST(n_unique AS DOUBLE) END AS eff_levels
      FROM (SELECT field, ord, count(*) AS n_unique, CAST(sum(cnt) AS BIGINT) AS n_valid,
                   -sum(p * log2(p + 1e-10)) AS entropy
            FROM (SELECT *, CAST(cnt AS DOUBLE) / sum(cnt) OVER (PARTITION BY field) AS p
                  FROM (SELECT field, ord, v, count(*) AS cnt FROM ({long})
                        WHERE v IS NOT NULL AND v <> '' AND lower(v) NOT IN ('missing', 'inapplicable', '<na>', 'nan')
                        GROUP BY ALL))
            GROUP BY field, ord))"""


def _a14_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS field, {i} AS ord, TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS x "
                              f"FROM households" for i, c in enumerate(HOUSEHOLD_CONTINUOUS))
    return f"""
SELECT field, ord, n, CASE WHEN abs(mean) > 1e-6 THEN std / abs(mean) ELSE std END AS cv,
       coalesce(q75 - q25 > 0 AND ((q50 - q25) / (q75 - q25) < 0.3 OR (q75 - q50) / (q75 - q25) < 0.3), false) AS skewed
FROM (SELECT field, ord, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.25) AS q25,
             quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75
      FROM ({long}) WHERE x IS NOT NULL GROUP BY field, ord) WHERE n >= 10"""


@register("k_evidence_categorical", build([], _a13_sql()))
def q_a13(spark, sf_dir):
    return ks.k_evidence_categorical(households(spark, sf_dir), HOUSEHOLD_CATEGORICAL)


@register("k_evidence_continuous", build([], _a14_sql()))
def q_a14(spark, sf_dir):
    return ks.k_evidence_continuous(households(spark, sf_dir), HOUSEHOLD_CONTINUOUS)


def _k_sql() -> str:
    return build([("a13", _a13_sql()), ("a14", _a14_sql()),
                  ("top", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS r FROM a13 WHERE key) WHERE r <= 3"),
                  ("parts", """SELECT (SELECT count(*) FROM households) AS n,
                       (SELECT avg(CASE WHEN eff_levels <> 0 THEN least(eff_levels, 10.0) END) FROM top) AS cat_mean,
                       (SELECT avg(cv) FROM a14) AS avg_cv,
                       (SELECT avg(CASE WHEN cv > 1.0 THEN 1.0 ELSE 0.0 END) FROM a14) AS high_ratio,
                       (SELECT count(*) FILTER (WHERE skewed) FROM a14) AS n_skewed"""),
                  ("kk", """SELECT n, greatest(2, least(CAST(round_even(log2(greatest(2, n)) / 2.0, 0) AS INTEGER), 15)) AS base_k,
                       cat_mean, avg_cv, high_ratio, n_skewed FROM parts"""),
                  ("k2", """SELECT n, base_k,
                       CASE WHEN cat_mean IS NULL THEN base_k ELSE greatest(2, least(CAST(round_even(cat_mean, 0) AS INTEGER), 15)) END AS cat_k,
                       CASE WHEN avg_cv IS NULL THEN 0 WHEN avg_cv > 1.5 OR high_ratio > 0.5 THEN 2
                            WHEN avg_cv > 0.8 OR high_ratio > 0.25 THEN 1 ELSE 0 END AS cont_adj,
                       CAST(least(n_skewed, 2) AS INTEGER) AS skew_adj FROM kk""")],
                 "SELECT n, base_k, cat_k, cont_adj, skew_adj, greatest(2, least(greatest(base_k, cat_k, base_k + cont_adj + skew_adj), 15)) AS k FROM k2")


@register("estimate_k", _k_sql())
def q_estimate_k(spark, sf_dir):
    return ks.estimate_k(households(spark, sf_dir), HOUSEHOLD_CONTINUOUS, HOUSEHOLD_CATEGORICAL)


# ------------------------------------------------------------------ selection

_ELIG = ("field_type IN ('continuous', 'categorical', 'binary') AND completeness >= 0.7 "
         "AND NOT (field_type IN ('categorical', 'binary') AND n_unique > 20)")
_BOUNDS = PROF + [("el", f"SELECT * FROM p_prof WHERE {_ELIG}"),
                  ("bagg", """SELECT count(*) AS n_el, count(*) FILTER (WHERE quality_score >= 6.5) AS n_good,
                              (SELECT count(*) FROM households) AS n FROM el"""),
                  ("b1", """SELECT n_good >= 6 AS use_good, CASE WHEN n_good >= 6 THEN n_good ELSE n_el END AS pool,
                              least(1.0, 0.7 + 0.3 * log10(greatest(10, greatest(1, n))) / 2) AS factor FROM bagg"""),
                  ("b2", """SELECT use_good, pool, CAST(least(greatest(greatest(8.0, round_even(pool * 0.3, 0)),
                              round_even(round_even(pool * 0.6, 0) * factor, 0)), 50.0, CAST(pool AS DOUBLE)) AS INTEGER) AS target
                              FROM b1"""),
                  ("bounds", """SELECT target, CAST(least(greatest(6.0, round_even(target * 0.8, 0)), CAST(target AS DOUBLE),
                              CAST(pool AS DOUBLE)) AS INTEGER) AS min_fields, CAST(pool AS INTEGER) AS pool_size, use_good
                              FROM b2""")]


@register("selection_bounds", build(_BOUNDS, "SELECT * FROM bounds"))
def q_selection_bounds(spark, sf_dir):
    h = households(spark, sf_dir)
    return pf.selection_bounds(pf.field_profile(h), h.count())


_SEL = _BOUNDS + [("sel", """
SELECT sel_ord, field_name, type FROM (
  SELECT row_number() OVER (ORDER BY quality_score DESC, field_name) AS sel_ord, field_name,
         CASE WHEN field_type = 'continuous' THEN 'continuous' ELSE 'categorical' END AS type
  FROM el WHERE NOT (SELECT use_good FROM bounds) OR quality_score >= 6.5)
WHERE sel_ord <= (SELECT target FROM bounds)""")]


def _selection(spark, sf_dir):
    h = households(spark, sf_dir)
    prof = pf.field_profile(h)
    return pf.rank_select(prof, pf.selection_bounds(prof, h.count()))


@register("rank_select", build(_SEL, "SELECT sel_ord, field_name, type FROM sel"))
def q_rank_select(spark, sf_dir):
    return _selection(spark, sf_dir).select(F.col("sel_ord").cast("long").alias("sel_ord"), "field_name", "type")


@register("selection_statistics", build(_SEL, """
SELECT count(*) AS total, count(*) FILTER (WHERE type = 'continuous') AS n_continuous,
       count(*) FILTER (WHERE type = 'categorical') AS n_categorical FROM sel"""))
def q_selection_statistics(spark, sf_dir):
    return pf.selection_statistics(_selection(spark, sf_dir))


@register("field_summary_topk", build(PROF, """
SELECT field_type, field_name, quality_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY field_type ORDER BY quality_score DESC, ord) AS rank FROM p_prof)
WHERE rank <= 3"""))
def q_field_summary_topk(spark, sf_dir):
    return pf.field_summary_topk(_profile(spark, sf_dir), k=3).select(
        "field_type", "field_name", "quality_score", F.col("rank").cast("long").alias("rank"))
