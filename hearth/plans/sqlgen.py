"""Helpers that generate the DuckDB side of wide-table queries from column lists."""

from __future__ import annotations

# households view: (column, numeric?) in table order
HOUSEHOLD_SCHEMA = [("hid", True), ("o_custkey", True), ("status", False), ("priority", False),
                    ("total", True), ("n_lines", True), ("has_lines", True), ("has_return", True),
                    ("ret_avg", True), ("qty_avg", True), ("disc_avg", True), ("ret_status", False)]

TOKENS_SQL = ["refus", "don''t know", "dont know", "dk", "unknown", "not ascertained"]


def long_sql(src: str, schema: list[tuple[str, bool]]) -> str:
    parts = []
    for i, (c, num) in enumerate(schema):
        x = f"CAST({c} AS DOUBLE)" if num else "NULL::DOUBLE"
        parts.append(f"SELECT '{c}' AS field, {i} AS ord, {str(num).lower()} AS is_num, "
                     f"CAST({c} AS VARCHAR) AS v, {x} AS x FROM {src}")
    return " UNION ALL ".join(parts)


def profile_ctes(src: str, schema: list[tuple[str, bool]], prefix: str = "p") -> list[tuple[str, str]]:
    """CTEs ending in ``{prefix}_prof`` (A1 over ``src``)."""
    lg, vc, sm, en, mo, pr = (f"{prefix}_{s}" for s in ("long", "vc", "summ", "ent", "mom", "prof"))
    return [
        (lg, long_sql(src, schema)),
        (vc, f"SELECT field, ord, is_num, v, count(*) AS cnt FROM {lg} GROUP BY ALL"),
        (sm, f"""SELECT field, ord, is_num, CAST(sum(cnt) AS BIGINT) AS n_total,
                 CAST(coalesce(sum(cnt) FILTER (WHERE v IS NOT NULL), 0) AS BIGINT) AS n_nonnull,
                 count(v) AS n_unique, max(cnt) FILTER (WHERE v IS NOT NULL) AS top_cnt
                 FROM {vc} GROUP BY ALL"""),
        (en, f"""SELECT a.field, -sum((CAST(cnt AS DOUBLE) / n_nonnull) * ln(CAST(cnt AS DOUBLE) / n_nonnull + 1e-10))
                 AS entropy_ln FROM {vc} a JOIN {sm} b USING (field) WHERE v IS NOT NULL GROUP BY a.field"""),
        (mo, f"""SELECT field, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.25) AS q25,
                 quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75
                 FROM {lg} WHERE is_num AND x IS NOT NULL GROUP BY field"""),
        (pr, f"""SELECT field AS field_name, ord, field_type,
                 CASE WHEN n_total > 0 THEN CAST(n_nonnull AS DOUBLE) / n_total ELSE 0.0 END AS completeness,
                 n_unique, variance_score,
                 (CASE WHEN n_total > 0 THEN CAST(n_nonnull AS DOUBLE) / n_total ELSE 0.0 END) * 5.0
                   + variance_score / 10.0 * 3.0
                   + (CASE WHEN field_type IN ('continuous', 'categorical', 'binary') THEN 2.0 ELSE 0.0 END) AS quality_score,
                 is_num AS is_numeric, CAST(top_cnt AS DOUBLE) / n_nonnull AS dominant_ratio,
                 n_total - n_nonnull AS n_missing, mean, std, q25, q50, q75, entropy_ln
                 FROM (SELECT s.*, e.entropy_ln, m.mean, m.std, m.q25, m.q50, m.q75,
                   CASE WHEN n_unique <= 1 THEN 'constant' WHEN n_unique = 2 THEN 'binary'
                        WHEN is_num AND n_unique > 20 THEN 'continuous'
                        WHEN n_unique <= 20 THEN 'categorical' ELSE 'high_cardinality' END AS field_type,
                   CASE WHEN n_unique <= 1 THEN 0.0 WHEN n_unique = 2 THEN 5.0
                        WHEN is_num AND n_unique > 20 THEN coalesce(least(10.0,
                             greatest(m.std, greatest(0.0, m.q75 - m.q25))
                             / greatest(abs(m.mean), abs(m.q50), 1e-9) * 5.0), 0.0)
                        WHEN n_unique <= 20 THEN least(10.0, e.entropy_ln * 3.0) ELSE 3.0 END AS variance_score
                   FROM {sm} s LEFT JOIN {en} e USING (field) LEFT JOIN {mo} m USING (field))"""),
    ]


def token_sql(expr: str) -> str:
    t = f"lower(trim(CAST({expr} AS VARCHAR)))"
    return "(" + " OR ".join(f"contains({t}, '{tok}')" for tok in TOKENS_SQL) + ")"


def rules_ctes(src: str, schema: list[tuple[str, bool]], targets: list[tuple[str, bool]],
               id_col: str = "hid") -> list[tuple[str, str]]:
    """CTEs for I1 + A12 + I2 over ``src``: ``p_prof``, ``gates``, ``gl``, ``rates``, ``rules``."""
    flags = []
    for t, num in targets:
        cond = f"{t} IS NULL" if num else f"({t} IS NULL OR trim(CAST({t} AS VARCHAR)) = '')"
        flags.append(f"CAST({cond} AS INTEGER) AS m_{t}")
    gl = " UNION ALL ".join(
        f"SELECT {id_col} AS _id, '{c}' AS gate, {i} AS gate_ord, coalesce(CAST({c} AS VARCHAR), '<NA>') AS level, "
        + ", ".join(flags) + f" FROM {src}" for i, (c, _) in enumerate(schema))
    ga = ("SELECT gate, gate_ord, level, count(*) AS size, "
          + ", ".join(f"sum(m_{t}) AS m_{t}" for t, _ in targets)
          + " FROM gl WHERE gate IN (SELECT field_name FROM gates) GROUP BY ALL")
    tl = " UNION ALL ".join(
        f"SELECT gate, gate_ord, level, size, '{t}' AS target, {str(num).lower()} AS target_numeric, "
        f"CAST(m_{t} AS BIGINT) AS n_miss FROM ga" for t, num in targets)
    rates = f"SELECT *, CAST(n_miss AS DOUBLE) / size AS rate FROM ({tl})"
    r = f"""SELECT *, sum(n_miss) OVER (PARTITION BY target, gate) AS tot_miss,
            bool_or(level <> '<NA>' AND {token_sql('level')}) OVER (PARTITION BY target, gate) AS gate_token,
            CASE WHEN target_numeric THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS hi,
            CASE WHEN target_numeric THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS lo,
            CASE WHEN target_numeric THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS gap_min,
            CASE WHEN target_numeric THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS expl_min
            FROM rates WHERE gate <> target"""
    big = (f"SELECT * FROM r WHERE size >= (SELECT greatest(3, round_even(0.02 * count(*), 0)) FROM {src}) "
           "AND tot_miss > 0 AND NOT gate_token")
    g = """SELECT target, target_numeric, gate, gate_ord, count(*) AS n_groups, max(rate) AS max_rate,
           min(rate) AS min_rate, sum(CASE WHEN rate >= hi THEN n_miss ELSE 0 END) AS struct_miss,
           list_sort(coalesce(list(level) FILTER (WHERE rate >= hi), [])) AS gate_values,
           any_value(tot_miss) AS tot_miss, any_value(hi) AS hi, any_value(lo) AS lo,
           any_value(gap_min) AS gap_min, any_value(expl_min) AS expl_min
           FROM big GROUP BY target, target_numeric, gate, gate_ord"""
    ok = """SELECT *, CAST(struct_miss AS DOUBLE) / tot_miss AS explained FROM g
            WHERE n_groups >= 2 AND max_rate >= hi AND min_rate <= lo AND max_rate - min_rate >= gap_min
              AND len(gate_values) > 0 AND CAST(struct_miss AS DOUBLE) / tot_miss >= expl_min"""
    rules = """SELECT target, target_numeric, gate AS gate_col, gate_values, explained, max_rate, min_rate, score
               FROM (SELECT *, explained * 10.0 + (max_rate - min_rate) AS score,
                     row_number() OVER (PARTITION BY target ORDER BY explained * 10.0 + (max_rate - min_rate) DESC, gate_ord) AS rn
                     FROM ok) WHERE rn = 1"""
    gates = ("SELECT field_name, ord FROM p_prof WHERE n_unique BETWEEN 2 AND 12 "
             "AND 1.0 - completeness <= 0.35")
    return profile_ctes(src, schema) + [("gates", gates), ("gl", gl), ("ga", ga), ("rates", rates), ("r", r),
                                        ("big", big), ("g", g), ("ok", ok), ("rules", rules)]


def impute_ctes(src: str, continuous: list[str], categorical: list[str], id_col: str = "hid") -> list[tuple[str, str]]:
    """CTEs ``ingate`` (per id and target: row in the rule's structural levels),
    ``s3`` (after I3), ``meds`` and ``imp`` (after I3-I5).  Needs ``rules_ctes``."""
    ingate = """SELECT gl._id, rules.target, list_contains(rules.gate_values, gl.level) AS in_gate
                FROM gl JOIN rules ON gl.gate = rules.gate_col"""
    joins = "".join(f" LEFT JOIN ingate g_{t} ON g_{t}._id = h.{id_col} AND g_{t}.target = '{t}'"
                    for t in continuous + categorical)
    s3_cols = [f"h.{id_col} AS {id_col}"]
    for t in continuous:
        s3_cols.append(f"CASE WHEN h.{t} IS NULL AND coalesce(g_{t}.in_gate, false) THEN 0.0::DOUBLE "
                       f"ELSE CAST(h.{t} AS DOUBLE) END AS {t}")
        s3_cols.append(f"g_{t}.in_gate AS ig_{t}")
    for t in categorical:
        s3_cols.append(f"h.{t} AS {t}")
        s3_cols.append(f"g_{t}.in_gate AS ig_{t}")
    s3 = f"SELECT {', '.join(s3_cols)} FROM {src} h{joins}"
    med = " UNION ALL ".join(
        f"SELECT '{t}' AS t, median({t}) FILTER (WHERE ig_{t} IS NOT NULL AND NOT ig_{t}) AS m_app, "
        f"median({t}) AS m_all, bool_or(ig_{t} IS NOT NULL) AS has_rule FROM s3" for t in continuous)
    meds = f"SELECT t, coalesce(CASE WHEN has_rule THEN m_app END, m_all, 0.0) AS m FROM ({med})"
    imp_cols = [f"s3.{id_col}"]
    for t in continuous:
        imp_cols.append(f"coalesce(s3.{t}, (SELECT m FROM meds WHERE t = '{t}')) AS {t}")
    for t in categorical:
        blank = f"(s3.{t} IS NULL OR trim(CAST(s3.{t} AS VARCHAR)) = '')"
        imp_cols.append(f"CASE WHEN {blank} AND coalesce(ig_{t}, false) THEN 'Inapplicable' "
                        f"WHEN {blank} THEN 'Missing' ELSE CAST(s3.{t} AS VARCHAR) END AS {t}")
    imp = f"SELECT {', '.join(imp_cols)} FROM s3"
    return [("ingate", ingate), ("s3", s3), ("meds", meds), ("imp", imp)]


def build(ctes: list[tuple[str, str]], body: str, views: tuple[str, ...] = ("households",)) -> str:
    from hearth.oracle import with_views
    return with_views(body, *views, extra=ctes)
