"""Registered queries: sampling, nearest persona, noise, similar outliers,
triage, state, convergence and mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.operators import cluster_stats as cs
from hearth.operators import refine as rf
from hearth.oracle import sql_mode, with_views
from hearth.plans.registry import register
from hearth.sources.tables import (HOUSEHOLD_CATEGORICAL, HOUSEHOLD_CONTINUOUS, evaluated, fit_expr,
                                   household_state, labeled)

NUM, CAT = HOUSEHOLD_CONTINUOUS, HOUSEHOLD_CATEGORICAL


def fit_sql(h: str, p: str) -> str:
    return f"(({h} * 7919 + CAST({p} AS BIGINT) * 31) % 1000) / 1000.0"


def _prof_sql() -> str:
    sel = ["c.cluster AS cluster_id", "count(*) AS n_samples"]
    for f in NUM:
        sel += [f"avg(c.{f}) AS {f}_mean", f"stddev_samp(c.{f}) AS {f}_std"]
    sel += [f"any_value(m_{f}.{f}_mode) AS {f}_mode" for f in CAT]
    joins = "".join(f" LEFT JOIN ({sql_mode('labeled', ['cluster'], f, f + '_mode')}) m_{f} ON m_{f}.cluster = c.cluster"
                    for f in CAT)
    return f"SELECT {', '.join(sel)} FROM labeled c{joins} WHERE c.cluster <> -1 GROUP BY c.cluster"


def _dist_sql(h: str, p: str) -> str:
    terms = [f"pow((coalesce(TRY_CAST({h}.{f} AS DOUBLE), {p}.{f}_mean) - {p}.{f}_mean) / "
             f"(CASE WHEN {p}.{f}_std IS NULL OR {p}.{f}_std <= 0 THEN 1.0 ELSE {p}.{f}_std END), 2)" for f in NUM]
    mism = [f"CAST({h}.{f} IS NOT NULL AND {p}.{f}_mode IS NOT NULL AND trim(CAST({h}.{f} AS VARCHAR)) <> trim({p}.{f}_mode) AS INTEGER)"
            for f in CAT]
    return f"(sqrt({' + '.join(terms)}) + 0.5 * ({' + '.join(mism)}))"


BASE = [("prof", _prof_sql()),
        ("pairs", f"""SELECT h.hid, h.cluster AS cur, p.cluster_id AS persona_id, {_dist_sql('h', 'p')} AS distance
                      FROM labeled h, prof p WHERE h.cluster < 0 OR p.cluster_id <> h.cluster"""),
        ("nearest", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hid ORDER BY distance, persona_id) AS rank
                       FROM pairs) WHERE rank <= 2"""),
        ("sizes", "SELECT cluster, count(*) AS n FROM labeled WHERE cluster <> -1 GROUP BY cluster"),
        ("caps0", """SELECT *, count(*) OVER () AS k, CAST(sum(n) OVER () AS BIGINT) AS total FROM sizes"""),
        ("caps1", """SELECT *, greatest(1e-6, CASE WHEN total >= 1000 THEN 0.05 WHEN total >= 100 THEN 0.10 ELSE 0.20 END) AS eps,
                            0.05 / k AS a, CAST(greatest(1, n) AS DOUBLE) AS ni FROM caps0"""),
        ("caps2", """SELECT *, CASE WHEN a >= 0.025 THEN 1.96 WHEN a >= 0.005 THEN 2.576 WHEN a >= 0.001 THEN 3.0 ELSE 3.5 END AS z
                     FROM caps1"""),
        ("caps", """SELECT cluster, n, eps AS epsilon, CAST(CASE WHEN ni <= 3 THEN ni ELSE
                      least(least(greatest(3, ceil(least(greatest(n0 / (1.0 + (n0 - 1.0) / ni) + 10.0 * ln(greatest(1.0, ni)),
                                                           ni * greatest(0.01, least(0.20, 1.5 / sqrt(ni)))), ni * 0.20))), ni), 2000)
                      END AS BIGINT) AS cap
                    FROM (SELECT *, z * z / (4 * eps * eps) AS n0 FROM caps2)"""),
        ("members", "SELECT l.*, l.cluster AS persona_id FROM labeled l WHERE cluster <> -1"),
        ("need", """SELECT m.* FROM members m WHERE NOT EXISTS (
                     SELECT 1 FROM evaluated e WHERE e.hid = m.hid AND e.persona_id = m.persona_id)"""),
        ("sample", """SELECT s.* EXCLUDE (_r, cap, _need), coalesce(cap < _need, false) AS sampled_down FROM (
                     SELECT n.*, row_number() OVER (PARTITION BY n.cluster ORDER BY
                       md5(CAST((42 * 1000003 + 1 * 1009 + CAST(n.cluster AS BIGINT)) % 4294967295 AS VARCHAR) || ':' || CAST(hid AS VARCHAR)), hid) AS _r,
                       c.cap, count(*) OVER (PARTITION BY n.cluster) AS _need
                     FROM need n LEFT JOIN caps c USING (cluster)) s WHERE cap IS NULL OR cap <= 0 OR _r <= cap"""),
        ]


def q(body: str) -> str:
    return with_views(body, "labeled", "state", "evaluated", extra=BASE)


def _personas(spark, sf_dir, lab=None):
    lab = lab if lab is not None else labeled(spark, sf_dir)
    return rf.persona_stats_from_profiles(cs.cluster_profiles(lab, NUM, CAT))


def _members(spark, sf_dir):
    return labeled(spark, sf_dir).where(F.col("cluster") != -1).withColumn("persona_id", F.col("cluster"))


def _caps(spark, sf_dir):
    sizes = labeled(spark, sf_dir).where(F.col("cluster") != -1).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return rf.adaptive_sample_sizes(sizes)


def _sample(spark, sf_dir):
    need = rf.need_validation(_members(spark, sf_dir), evaluated(spark, sf_dir))
    return rf.capped_cluster_sample(need, _caps(spark, sf_dir), iteration=1)


@register("adaptive_sample_size", q("SELECT cluster, n, cap FROM caps"))
def q_caps(spark, sf_dir):
    return _caps(spark, sf_dir).select("cluster", "n", "cap")


@register("adaptive_epsilon", q("SELECT DISTINCT total, eps AS epsilon FROM caps1"))
def q_eps(spark, sf_dir):
    tot = labeled(spark, sf_dir).where(F.col("cluster") != -1).agg(F.count(F.lit(1)).alias("total"))
    return tot.select("total", rf.adaptive_epsilon(F.col("total")).alias("epsilon"))


@register("per_cluster_sample", q("""SELECT hid, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster
    ORDER BY md5('42:' || CAST(hid AS VARCHAR)), hid) AS r FROM labeled WHERE cluster <> -1) WHERE r <= 50"""))
def q_per_cluster_sample(spark, sf_dir):
    lab = labeled(spark, sf_dir).where(F.col("cluster") != -1)
    return rf.per_cluster_sample(lab, 50, 42).select("hid", "cluster")


@register("need_validation", q("SELECT hid, cluster FROM need"))
def q_need(spark, sf_dir):
    return rf.need_validation(_members(spark, sf_dir), evaluated(spark, sf_dir)).select("hid", "cluster")


@register("capped_cluster_sample", q("SELECT hid, cluster, sampled_down FROM sample"))
def q_capped(spark, sf_dir):
    return _sample(spark, sf_dir).select("hid", "cluster", "sampled_down")


@register("nearest_persona", q("SELECT hid, CAST(rank AS INTEGER) AS rank, persona_id, distance FROM nearest"))
def q_nearest(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    ps = _personas(spark, sf_dir, lab)
    top = rf.nearest_personas(lab, ps, 2, "cluster")
    return top.select("hid", F.posexplode("near").alias("pos", "p")).select(
        "hid", (F.col("pos") + 1).alias("rank"), F.col("p.persona_id").alias("persona_id"),
        F.col("p.distance").alias("distance"))


@register("reassign_noise", q("""SELECT l.hid, CASE WHEN l.cluster = -1 THEN coalesce(n.persona_id, l.cluster)
    ELSE l.cluster END AS cluster FROM labeled l LEFT JOIN nearest n ON n.hid = l.hid AND n.rank = 1"""))
def q_reassign_noise(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    ps = _personas(spark, sf_dir, lab)
    return rf.reassign_noise(lab, ps, {p.persona_id: p.persona_id for p in ps}).select("hid", "cluster")


_J6 = [("seeds", f"""SELECT s.* FROM sample s WHERE s.sampled_down AND {fit_sql('s.hid', 's.persona_id')} < 0.30"""),
       ("cstd", "SELECT cluster, " + ", ".join(
           f"CASE WHEN stddev_pop({f}) IS NULL OR NOT isfinite(stddev_pop({f})) OR stddev_pop({f}) <= 1e-12 THEN 1.0 "
           f"ELSE stddev_pop({f}) END AS s_{f}" for f in NUM) + " FROM labeled GROUP BY cluster"),
       ("cands", """SELECT m.* FROM members m JOIN state st USING (hid)
                    WHERE st.status NOT IN ('validated', 'pending', 'problem')
                      AND m.hid NOT IN (SELECT hid FROM sample)
                      AND NOT EXISTS (SELECT 1 FROM evaluated e WHERE e.hid = m.hid AND e.persona_id = m.persona_id)"""),
       ("pairs6", "SELECT s.hid AS seed_hid, c.hid, "
        + " + ".join(f"CAST(s.{f} IS NOT NULL AND c.{f} IS NOT NULL AS INTEGER)" for f in NUM) + " AS n_used, "
        + " + ".join(f"CASE WHEN s.{f} IS NOT NULL AND c.{f} IS NOT NULL THEN pow((s.{f} - c.{f}) / d.s_{f}, 2) ELSE 0 END"
                     for f in NUM) + " AS ssq, "
        + " + ".join(f"CAST(s.{f} IS NOT NULL AND c.{f} IS NOT NULL AS INTEGER)" for f in CAT) + " AS c_used, "
        + " + ".join(f"CAST(s.{f} IS NOT NULL AND c.{f} IS NOT NULL AND trim(s.{f}) <> trim(c.{f}) AS INTEGER)" for f in CAT)
        + " AS mism FROM seeds s JOIN cands c ON s.cluster = c.cluster JOIN cstd d ON d.cluster = s.cluster "
        "WHERE s.hid <> c.hid"),
       ("sim6", """SELECT seed_hid, hid, 1.0 / (1.0 + CASE WHEN n_used > 0 THEN sqrt(ssq / n_used) ELSE 0 END
                     + 0.5 * CASE WHEN c_used > 0 THEN CAST(mism AS DOUBLE) / c_used ELSE 0 END) AS similarity,
                   n_used + c_used AS fields_used FROM pairs6 WHERE n_used + c_used > 0""")]


@register("similar_outliers", with_views("""SELECT seed_hid, hid, similarity, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY seed_hid ORDER BY similarity DESC, hid) AS rank FROM sim6) WHERE rank <= 5""",
    "labeled", "state", "evaluated", extra=BASE + _J6))
def q_similar_outliers(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    sample = _sample(spark, sf_dir)
    seeds = sample.where(F.col("sampled_down") & (fit_expr(F.col("hid"), F.col("persona_id")) < rf.DIRECT_OUTLIER_FIT))
    st = household_state(spark, sf_dir)
    members = _members(spark, sf_dir)
    cands = (members.join(st.where(~F.col("status").isin(rf.VALIDATED, rf.PENDING, rf.PROBLEM)).select("hid"), "hid")
             .join(sample.select("hid"), "hid", "left_anti")
             .join(evaluated(spark, sf_dir), ["hid", "persona_id"], "left_anti"))
    out = rf.similar_outliers(lab, cands, seeds, NUM, CAT)
    return out.select("seed_hid", "hid", "similarity", "rank")


# ---------------------------------------------------------------- triage and state

_TRI = [("scored", f"""SELECT s.hid, s.cluster, s.persona_id, {fit_sql('s.hid', 's.persona_id')} AS fit,
                       {fit_sql('s.hid', 's.persona_id')} AS combined,
                       n1.persona_id AS alt1_id, {fit_sql('s.hid', 'n1.persona_id')} AS alt1_combined,
                       n2.persona_id AS alt2_id, {fit_sql('s.hid', 'n2.persona_id')} AS alt2_combined
                FROM sample s LEFT JOIN nearest n1 ON n1.hid = s.hid AND n1.rank = 1
                LEFT JOIN nearest n2 ON n2.hid = s.hid AND n2.rank = 2"""),
        ("tri", """SELECT *, CASE WHEN combined >= 0.6 THEN 'validated' WHEN fit < 0.30 THEN 'outlier'
                          WHEN b2 >= 0.6 AND p2 <> persona_id THEN 'moved' ELSE 'outlier' END AS outcome FROM (
                   SELECT *, CASE WHEN alt2_combined > b1 THEN alt2_combined ELSE b1 END AS b2,
                             CASE WHEN alt2_combined > b1 THEN alt2_id ELSE p1 END AS p2 FROM (
                   SELECT *, CASE WHEN alt1_combined > combined THEN alt1_combined ELSE combined END AS b1,
                             CASE WHEN alt1_combined > combined THEN alt1_id ELSE persona_id END AS p1 FROM scored))""")]


def _triaged(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    ps = _personas(spark, sf_dir, lab)
    s = _sample(spark, sf_dir)
    near = rf.nearest_personas(s, ps, 2, "cluster", keep=["cluster", "persona_id"])
    top = [F.get("near", F.lit(i))["persona_id"] for i in range(2)]
    fit = fit_expr(F.col("hid"), F.col("persona_id"))
    scored = near.select("hid", "cluster", "persona_id", fit.alias("fit"), fit.alias("combined"),
                         top[0].alias("alt1_id"), fit_expr(F.col("hid"), top[0]).alias("alt1_combined"),
                         top[1].alias("alt2_id"), fit_expr(F.col("hid"), top[1]).alias("alt2_combined"))
    return rf.triage(scored), ps


@register("triage", with_views("""SELECT hid, outcome, coalesce(CASE WHEN outcome = 'moved' THEN p2 END, -1) AS new_persona_id
    FROM tri""", "labeled", "state", "evaluated", extra=BASE + _TRI))
def q_triage(spark, sf_dir):
    t, _ = _triaged(spark, sf_dir)
    # nullable ids are reported as -1 (no move) so both engines emit plain integers
    return t.select("hid", "outcome", F.coalesce("new_persona_id", F.lit(-1)).alias("new_persona_id"))


@register("state_transitions", with_views("""
SELECT st.hid,
  CAST(CASE WHEN t.outcome = 'moved' THEN t.p2 ELSE st.cluster END AS INTEGER) AS cluster,
  CASE t.outcome WHEN 'validated' THEN 'validated' WHEN 'outlier' THEN 'problem' WHEN 'moved' THEN 'pending'
       ELSE st.status END AS status,
  coalesce(CAST(CASE WHEN t.outcome = 'validated' THEN t.cluster ELSE st.last_valid_cluster END AS INTEGER), -1) AS last_valid_cluster,
  coalesce(CAST(CASE WHEN t.outcome = 'validated' THEN t.persona_id ELSE st.last_valid_persona END AS INTEGER), -1) AS last_valid_persona
FROM state st LEFT JOIN tri t USING (hid)""", "labeled", "state", "evaluated", extra=BASE + _TRI))
def q_state_transitions(spark, sf_dir):
    t, ps = _triaged(spark, sf_dir)
    out = rf.state_transitions(household_state(spark, sf_dir), t, {p.persona_id: p.persona_id for p in ps})
    return out.select("hid", "cluster", "status", F.coalesce("last_valid_cluster", F.lit(-1)).alias("last_valid_cluster"),
                      F.coalesce("last_valid_persona", F.lit(-1)).alias("last_valid_persona"))


@register("convergence_metrics", q("""
SELECT count(*) AS n, count(*) FILTER (WHERE status IN ('validated', 'problem', 'pending')) * 1.0::DOUBLE / count(*) AS coverage,
       count(*) FILTER (WHERE status = 'validated') * 1.0::DOUBLE / count(*) AS validated_rate,
       count(*) FILTER (WHERE status IN ('problem', 'pending')) * 1.0::DOUBLE / count(*) AS problem_rate,
       count(*) FILTER (WHERE status = 'pending') * 1.0::DOUBLE / count(*) AS pending_rate,
       count(*) FILTER (WHERE status = 'pending') AS n_pending FROM state"""))
def q_convergence_metrics(spark, sf_dir):
    return rf.convergence_metrics(household_state(spark, sf_dir))


@register("convergence", q("""
SELECT problem_rate < 0.05 AND coverage >= 0.85 AND n_pending = 0 AS converged FROM (
SELECT count(*) FILTER (WHERE status IN ('validated', 'problem', 'pending')) * 1.0::DOUBLE / count(*) AS coverage,
       count(*) FILTER (WHERE status IN ('problem', 'pending')) * 1.0::DOUBLE / count(*) AS problem_rate,
       count(*) FILTER (WHERE status = 'pending') AS n_pending FROM state)"""))
def q_convergence(spark, sf_dir):
    return rf.converged(rf.convergence_metrics(household_state(spark, sf_dir))).select("converged")


_PSTATE = [("pstate", f"""SELECT cluster AS persona_id, avg({fit_sql('hid', 'cluster')}) AS fit_score, count(*) AS num_assigned
                         FROM state WHERE status = 'validated' AND cluster >= 0 GROUP BY cluster""")]


def _pstate(spark, sf_dir):
    st = household_state(spark, sf_dir).where((F.col("status") == rf.VALIDATED) & (F.col("cluster") >= 0))
    return st.groupBy(F.col("cluster").alias("persona_id")).agg(
        F.avg(fit_expr(F.col("hid"), F.col("cluster"))).alias("fit_score"), F.count(F.lit(1)).alias("num_assigned"))


@register("ucb_reward", with_views(f"""
SELECT persona_id, CASE WHEN num_assigned <= 0 THEN 'Infinity'::DOUBLE
       ELSE fit_score + 0.2 * sqrt(ln(CAST((SELECT count(*) FROM labeled) AS DOUBLE)) / num_assigned) END AS reward
FROM pstate""", "labeled", "state", extra=_PSTATE))
def q_ucb(spark, sf_dir):
    total = labeled(spark, sf_dir).count()
    p = _pstate(spark, sf_dir)
    return p.select("persona_id", rf.ucb_reward(F.col("fit_score"), F.lit(total), F.col("num_assigned")).alias("reward"))


@register("running_fit", with_views(f"""
SELECT p.persona_id, CASE WHEN p.num_assigned + coalesce(a.m, 0) > 0
         THEN (p.fit_score * p.num_assigned + coalesce(a.s, 0.0)) / (p.num_assigned + coalesce(a.m, 0))
         ELSE p.fit_score END AS fit_score, p.num_assigned + coalesce(a.m, 0) AS num_assigned
FROM pstate p LEFT JOIN (SELECT cluster AS persona_id, sum({fit_sql('hid', 'cluster')}) AS s, count(*) AS m
                         FROM state WHERE status = 'pending' AND cluster >= 0 GROUP BY cluster) a USING (persona_id)""",
    "labeled", "state", extra=_PSTATE))
def q_running_fit(spark, sf_dir):
    st = household_state(spark, sf_dir).where((F.col("status") == rf.PENDING) & (F.col("cluster") >= 0))
    new = st.select(F.col("cluster").alias("persona_id"), "hid", fit_expr(F.col("hid"), F.col("cluster")).alias("score"))
    return rf.running_fit(_pstate(spark, sf_dir), new)


@register("stage2_trigger", q("""
SELECT n_outliers, n_evaluated, n_outliers >= greatest(1, ceil(0.05 * n_evaluated)) AS triggered FROM
 (SELECT (SELECT count(*) FROM state WHERE status = 'problem') AS n_outliers,
         (SELECT count(DISTINCT hid) FROM evaluated) AS n_evaluated)"""))
def q_stage2(spark, sf_dir):
    st = household_state(spark, sf_dir)
    ev = evaluated(spark, sf_dir).select("hid").distinct().select(F.lit("e").alias("k"))
    u = st.where(F.col("status") == rf.PROBLEM).select(F.lit("o").alias("k")).unionByName(ev)
    a = u.agg(F.count(F.when(F.col("k") == "o", 1)).alias("n_outliers"),
              F.count(F.when(F.col("k") == "e", 1)).alias("n_evaluated"))
    return a.select("n_outliers", "n_evaluated", rf.stage2_trigger(F.col("n_outliers"), F.col("n_evaluated")).alias("triggered"))


@register("evaluated_union", q("SELECT DISTINCT hid FROM state WHERE status IN ('validated', 'problem', 'pending')"))
def q_u1(spark, sf_dir):
    st = household_state(spark, sf_dir)
    parts = [st.where(F.col("status") == s).select("hid") for s in (rf.VALIDATED, rf.PROBLEM, rf.PENDING)]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@register("outlier_union", with_views("""SELECT DISTINCT hid FROM (SELECT hid FROM tri WHERE outcome = 'outlier'
    UNION ALL SELECT hid FROM state WHERE status = 'problem')""", "labeled", "state", "evaluated", extra=BASE + _TRI))
def q_u2(spark, sf_dir):
    t, _ = _triaged(spark, sf_dir)
    st = household_state(spark, sf_dir)
    return t.where(F.col("outcome") == "outlier").select("hid").union(
        st.where(F.col("status") == rf.PROBLEM).select("hid")).distinct()


@register("set_difference", q("""SELECT hid FROM need WHERE hid NOT IN (SELECT hid FROM state WHERE status = 'validated')"""))
def q_u3(spark, sf_dir):
    need = rf.need_validation(_members(spark, sf_dir), evaluated(spark, sf_dir))
    val = household_state(spark, sf_dir).where(F.col("status") == rf.VALIDATED).select("hid")
    return need.select("hid").join(val, "hid", "left_anti")


@register("set_intersection", q("""SELECT m.hid, m.cluster FROM members m WHERE EXISTS (
    SELECT 1 FROM evaluated e WHERE e.hid = m.hid AND e.persona_id = m.persona_id)"""))
def q_u4(spark, sf_dir):
    return _members(spark, sf_dir).join(evaluated(spark, sf_dir), ["hid", "persona_id"], "left_semi").select("hid", "cluster")


@register("cap_outliers", with_views("""SELECT hid, is_current FROM (
    SELECT *, row_number() OVER (ORDER BY is_current DESC, md5('1:' || CAST(hid AS VARCHAR)), hid) AS r FROM (
      SELECT hid, bool_or(cur) AS is_current FROM (SELECT hid, true AS cur FROM tri WHERE outcome = 'outlier'
        UNION ALL SELECT hid, false FROM state WHERE status = 'problem') GROUP BY hid)) WHERE r <= 100""",
    "labeled", "state", "evaluated", extra=BASE + _TRI))
def q_cap_outliers(spark, sf_dir):
    t, _ = _triaged(spark, sf_dir)
    st = household_state(spark, sf_dir)
    u = t.where(F.col("outcome") == "outlier").select("hid", F.lit(True).alias("cur")).unionByName(
        st.where(F.col("status") == rf.PROBLEM).select("hid", F.lit(False).alias("cur")))
    o = u.groupBy("hid").agg(F.max("cur").alias("is_current"))
    return rf.cap_outliers(o, 100, 1).select("hid", "is_current")


_PERS = [("personas", """SELECT cluster_id AS persona_id, CASE WHEN cluster_id % 3 = 0 THEN NULL ELSE cluster_id END AS cluster_id,
                          CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS INTEGER) AS pos,
                          'Persona ' || CAST(cluster_id AS VARCHAR) AS persona_name FROM prof"""),
         ("cmap", "SELECT persona_id, CAST(coalesce(cluster_id, persona_id, pos) AS INTEGER) AS cluster FROM personas")]


def _persona_table(spark, sf_dir):
    prof = cs.cluster_profiles(labeled(spark, sf_dir), NUM, CAT)
    from pyspark.sql import Window
    return prof.select(F.col("cluster_id").alias("persona_id"),
                       F.when(F.col("cluster_id") % 3 == 0, F.lit(None)).otherwise(F.col("cluster_id")).alias("cluster_id"),
                       F.create_map(F.lit("cluster_id"), F.col("cluster_id").cast("string")).alias("statistics"),
                       (F.row_number().over(Window.orderBy("cluster_id")) - 1).alias("pos"),
                       F.concat(F.lit("Persona "), F.col("cluster_id").cast("string")).alias("persona_name"))


@register("cluster_persona_map", with_views("SELECT persona_id, cluster FROM cmap", "labeled", extra=BASE[:1] + _PERS))
def q_j9(spark, sf_dir):
    return rf.cluster_persona_map(_persona_table(spark, sf_dir))


@register("initial_mapping", with_views("""SELECT l.hid, l.cluster AS initial_cluster, coalesce(c.persona_id, -1) AS initial_persona
    FROM labeled l LEFT JOIN (SELECT cluster, min(persona_id) AS persona_id FROM cmap GROUP BY cluster) c USING (cluster)""",
    "labeled", extra=BASE[:1] + _PERS))
def q_j8(spark, sf_dir):
    cmap = rf.cluster_persona_map(_persona_table(spark, sf_dir))
    return rf.initial_mapping(labeled(spark, sf_dir), cmap)


@register("mapping_provenance", with_views(f"""
SELECT st.hid, m.persona_id, m.final_cluster, m.mapping_source, coalesce(p.persona_name, 'Unknown') AS persona_name,
       ps.fit_score AS persona_avg_fit FROM state st JOIN (
  SELECT hid, CAST(CASE WHEN status = 'validated' THEN cluster WHEN last_valid_persona IS NOT NULL THEN last_valid_persona
              ELSE initial_persona END AS INTEGER) AS persona_id,
         CAST(CASE WHEN status = 'validated' THEN cluster WHEN last_valid_persona IS NOT NULL THEN last_valid_cluster
              ELSE initial_cluster END AS INTEGER) AS final_cluster,
         CASE WHEN status = 'validated' THEN 'current_validated' WHEN last_valid_persona IS NOT NULL THEN 'last_validated'
              ELSE 'initial' END AS mapping_source FROM state) m USING (hid)
LEFT JOIN personas p ON p.persona_id = m.persona_id LEFT JOIN pstate ps ON ps.persona_id = m.persona_id""",
    "labeled", "state", extra=BASE[:1] + _PERS + _PSTATE))
def q_j7(spark, sf_dir):
    out = rf.mapping_provenance(household_state(spark, sf_dir), _persona_table(spark, sf_dir), _pstate(spark, sf_dir))
    return out.select("hid", "persona_id", "final_cluster", "mapping_source", "persona_name", "persona_avg_fit")


@register("cluster_persona_counts", with_views("""SELECT l.cluster, count(*) AS n, coalesce(any_value(p.persona_id), -1) AS persona_id,
    coalesce(any_value(p.persona_name), 'Unknown') AS persona_name FROM labeled l
    LEFT JOIN personas p ON p.persona_id = l.cluster GROUP BY l.cluster""", "labeled", extra=BASE[:1] + _PERS))
def q_a24(spark, sf_dir):
    p = _persona_table(spark, sf_dir).select(F.col("persona_id").alias("cluster_id"), "persona_id",
                                             F.col("persona_name").alias("name"))
    return cs.cluster_persona_counts(labeled(spark, sf_dir), p)


@register("refine_loop")
def q_refine_loop(spark, sf_dir):
    """R10 (property-checked): households_labeled through the bulk-synchronous loop until it converges or stalls."""
    from hearth.plans.refine_loop import fit_table_scorer, run_refinement
    res = run_refinement(labeled(spark, sf_dir), NUM, CAT, fit_table_scorer(fit_expr), max_iterations=None)
    return res.mapping


@register("tracker_snapshot", with_views(f"""
SELECT p.persona_id, p.fit_score, p.num_assigned,
       CASE WHEN p.num_assigned <= 0 THEN 'Infinity'::DOUBLE
            ELSE p.fit_score + 0.2 * sqrt(ln(CAST((SELECT count(*) FROM labeled) AS DOUBLE)) / p.num_assigned) END AS reward,
       coalesce(c.n, 0) AS n_households
FROM pstate p LEFT JOIN (SELECT cluster, count(*) AS n FROM state WHERE cluster >= 0 GROUP BY cluster) c
  ON c.cluster = p.persona_id""", "labeled", "state", extra=_PSTATE))
def q_r11(spark, sf_dir):
    total = labeled(spark, sf_dir).count()
    return rf.tracker_snapshot(_pstate(spark, sf_dir), household_state(spark, sf_dir), total)


@register("outlier_group_stats", q("""
SELECT count(*) AS n_samples, """ + ", ".join(f"avg(TRY_CAST(l.{c} AS DOUBLE)) AS {c}_mean" for c in NUM) + ", "
    + ", ".join(f"(SELECT v FROM (SELECT coalesce(CAST(l2.{c} AS VARCHAR), 'Missing') AS v, count(*) AS n FROM labeled l2 "
                f"JOIN state s2 USING (hid) WHERE s2.status = 'problem' GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS {c}_mode"
                for c in CAT) + """, 100.0::DOUBLE AS percentage
FROM labeled l JOIN state s USING (hid) WHERE s.status = 'problem'"""))
def q_a11(spark, sf_dir):
    probs = household_state(spark, sf_dir).where(F.col("status") == rf.PROBLEM).select("hid")
    return rf.outlier_group_stats(labeled(spark, sf_dir).join(probs, "hid"), NUM, CAT)


@register("new_persona_ids", q("""
SELECT local_cluster, n, CAST(7 + r AS INTEGER) AS persona_id, CAST(7 + r AS INTEGER) AS cluster_id FROM (
  SELECT *, row_number() OVER (ORDER BY n DESC, local_cluster) AS r FROM (
    SELECT CAST(CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3
                ELSE 4 END AS INTEGER) AS local_cluster, count(*) AS n
    FROM labeled l JOIN state s USING (hid) WHERE s.status = 'problem' GROUP BY 1))
WHERE r <= 5"""))
def q_w19(spark, sf_dir):
    probs = household_state(spark, sf_dir).where(F.col("status") == rf.PROBLEM).select("hid")
    sub = labeled(spark, sf_dir).join(probs, "hid")
    code = F.coalesce(F.create_map(*[x for k, v in {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3}.items()
                                     for x in (F.lit(k), F.lit(v))])[F.col("priority")], F.lit(4)).cast("int")
    sizes = sub.groupBy(code.alias("local_cluster")).agg(F.count(F.lit(1)).alias("n"))
    return rf.new_persona_ids(sizes, 7, 12 - 7)


@register("recluster_outliers")
def q_r6(spark, sf_dir):
    """R6 (property-checked): the fixture's problem households, capped (W17),
    re-clustered with C1-C8 under k <= min(max(2, min(10, n - 1)), max(2, slots))
    and given new persona ids by size (W19); sub-cluster noise stays flagged."""
    from hearth.plans.cluster_job import run_cluster_job
    st = household_state(spark, sf_dir)
    probs = st.where(F.col("status") == rf.PROBLEM).select("hid", F.lit(False).alias("is_current"))
    chosen = rf.cap_outliers(probs, 2000, 1).select("hid")
    subset = chosen.join(labeled(spark, sf_dir).drop("cluster"), "hid")
    n = subset.count()
    slots = 12 - 7
    kmax = min(max(2, min(10, n - 1)), max(2, slots))
    sel = [{"field_name": c, "type": "continuous"} for c in NUM] + [{"field_name": c, "type": "categorical"} for c in CAT]
    res = run_cluster_job(subset, selection=sel, excluded_patterns=[], max_k=kmax)
    lab = res.labels
    sizes = lab.where(F.col("cluster") != -1).groupBy(F.col("cluster").alias("local_cluster")).agg(
        F.count(F.lit(1)).alias("n"))
    ids = rf.new_persona_ids(sizes, 6, slots)
    return lab.join(F.broadcast(ids.select(F.col("local_cluster").alias("cluster"), "persona_id")), "cluster", "left") \
        .select("hid", F.col("cluster").alias("local_cluster"), F.coalesce("persona_id", F.lit(-1)).alias("new_persona_id"))
