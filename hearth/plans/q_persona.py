"""Registered queries: profile metric names, field references, value formats,
persona tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.functions import persona_text as pt
from hearth.operators import cluster_stats as cs
from hearth.oracle import sql_mode, with_views
from hearth.plans.registry import register
from hearth.sources.tables import HOUSEHOLD_CATEGORICAL, HOUSEHOLD_CONTINUOUS, candidates, households, labeled


def _profiles(spark, sf_dir):
    return cs.cluster_profiles(labeled(spark, sf_dir), HOUSEHOLD_CONTINUOUS, HOUSEHOLD_CATEGORICAL)


def _prof_sql() -> str:
    sel = ["c.cluster AS cluster_id", "count(*) AS n_samples",
           "count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labeled) AS percentage"]
    for f in HOUSEHOLD_CONTINUOUS:
        sel += [f"avg(c.{f}) AS {f}_mean", f"stddev_samp(c.{f}) AS {f}_std"]
    sel += [f"any_value(m_{f}.{f}_mode) AS {f}_mode" for f in HOUSEHOLD_CATEGORICAL]
    joins = "".join(f" LEFT JOIN ({sql_mode('labeled', ['cluster'], f, f + '_mode')}) m_{f} ON m_{f}.cluster = c.cluster"
                    for f in HOUSEHOLD_CATEGORICAL)
    return f"SELECT {', '.join(sel)} FROM labeled c{joins} WHERE c.cluster <> -1 GROUP BY c.cluster"


_PROF = [("prof", _prof_sql())]


def _metric_union() -> str:
    parts, order = [], {}
    for f in HOUSEHOLD_CONTINUOUS:
        order.setdefault(f, len(order))
        parts.append(f"SELECT cluster_id, '{f}' AS field, 'mean' AS metric, CAST({f}_mean AS VARCHAR) AS value, {order[f]} AS ord FROM prof")
        parts.append(f"SELECT cluster_id, '{f}', 'std', CAST({f}_std AS VARCHAR), {order[f]} FROM prof")
    for f in HOUSEHOLD_CATEGORICAL:
        order.setdefault(f, len(order))
        parts.append(f"SELECT cluster_id, '{f}', 'mode', CAST({f}_mode AS VARCHAR), {order[f]} FROM prof")
    return " UNION ALL ".join(parts)


@register("split_metric_name", with_views("SELECT cluster_id, field, metric, ord, value IS NULL AS is_null FROM ("
                                          + _metric_union() + ")", "labeled", extra=_PROF))
def q_t9(spark, sf_dir):
    # values are compared through their null flag: double-to-text differs between engines
    return pt.split_metric_names(_profiles(spark, sf_dir)).select(
        "cluster_id", "field", "metric", "ord", F.col("value").isNull().alias("is_null"))


@register("format_field_ref", with_views("""
SELECT seq, CASE WHEN trim(coalesce(category, '')) <> '' THEN '[' || trim(category) || '] ' ELSE '' END ||
  CASE WHEN lab <> '' THEN lab || ' (' || var_id || ')' ELSE var_id END AS ref FROM (
  SELECT *, CASE WHEN length(l0) > 80 THEN substr(l0, 1, 77) || '...' ELSE l0 END AS lab FROM (
    SELECT *, trim(regexp_replace(coalesce(nullif(trim(short_label), ''), trim(coalesce(description, ''))), '\\s+', ' ', 'g')) AS l0
    FROM candidates))""", "candidates"))
def q_t10(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return c.select("seq", pt.format_field_ref(F.col("var_id"), F.col("category"), F.col("short_label"),
                                               F.col("description")).alias("ref"))


def _fixed3_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.3f', {x}), '0+$', ''), '\\.$', '')"


@register("format_money_value", with_views(f"""
SELECT hid, '$' || format('{{:,.0f}}', total) AS total_txt,
       CASE WHEN qty_avg IS NULL OR isnan(qty_avg) THEN 'N/A'
            WHEN abs(qty_avg) >= 1000 AND qty_avg = floor(qty_avg) THEN format('{{:,.0f}}', qty_avg)
            WHEN {_fixed3_sql('qty_avg')} = '' THEN '0' ELSE {_fixed3_sql('qty_avg')} END AS qty_txt,
       CASE WHEN ret_status IS NULL OR trim(ret_status) = '' THEN 'N/A' ELSE trim(ret_status) END AS status_txt
FROM households""", "households"))
def q_t11(spark, sf_dir):
    h = households(spark, sf_dir)
    return h.select("hid", pt.format_money_value(F.col("total"), F.lit("income")).alias("total_txt"),
                    pt.format_money_value(F.col("qty_avg"), F.lit("consumption")).alias("qty_txt"),
                    pt.format_money_value(F.col("ret_status"), F.lit(None), is_text=True).alias("status_txt"))


@register("format_survey_value", with_views(f"""
SELECT hid, CAST(n_lines AS VARCHAR) AS n_lines_txt,
       CASE WHEN disc_avg IS NULL OR isnan(disc_avg) THEN NULL WHEN disc_avg = floor(disc_avg)
            THEN CAST(CAST(disc_avg AS BIGINT) AS VARCHAR) ELSE {_fixed3_sql('disc_avg')} END AS disc_txt
FROM households""", "households"))
def q_t12(spark, sf_dir):
    h = households(spark, sf_dir)
    return h.select("hid", pt.format_survey_value(F.col("n_lines"), integral=True).alias("n_lines_txt"),
                    pt.format_survey_value(F.col("disc_avg")).alias("disc_txt"))


@register("tag_persona", with_views("""
SELECT cluster_id, 'psid' AS dataset, 'psid_cluster_' || CAST(cluster_id AS VARCHAR) AS persona_id,
       'psid' AS source_dataset, n_samples AS source_n_samples FROM prof""", "labeled", extra=_PROF))
def q_t18(spark, sf_dir):
    t = pt.tag_persona(_profiles(spark, sf_dir), "psid")
    return t.select("cluster_id", "dataset", "persona_id", F.col("source.dataset").alias("source_dataset"),
                    F.col("source.n_samples").alias("source_n_samples"))


# ---------------------------------------------------------------- J2, J3, W18, C12, C13

from hearth.operators import refine as rf  # noqa: E402
from hearth.operators import quota as qo  # noqa: E402
from hearth.plans.q_quota import CTES as QCTES  # noqa: E402
from hearth.sources.tables import table  # noqa: E402


def _doc_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("var_id", F.concat(F.lit("v"), (F.col("doc_id") % 700).cast("string")))
    g = d.groupBy(F.col("source").alias("cluster_id"), F.col("var_id").alias("field")).agg(
        F.avg("n_chars").alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.select("cluster_id", "field", F.explode(F.array(
        F.struct(F.lit("mean").alias("metric"), F.format_string("%.1f", F.col("mean")).alias("value")),
        F.struct(F.lit("n").alias("metric"), F.col("n").cast("string").alias("value")))).alias("m")).select(
        "cluster_id", "field", "m.metric", "m.value")


@register("attach_field_metadata", with_views("""
SELECT s.cluster_id, s.field, coalesce(trim(w.category), '') AS category, coalesce(trim(w.short_label), '') AS short_label,
       coalesce(CASE WHEN length(d0) > 240 THEN substr(d0, 1, 237) || '...' ELSE d0 END, '') AS description,
       s.n AS n_metric
FROM (SELECT source AS cluster_id, 'v' || CAST(doc_id % 700 AS VARCHAR) AS field, count(*) AS n
      FROM documents GROUP BY ALL) s
LEFT JOIN (SELECT *, trim(regexp_replace(coalesce(nullif(trim(description), ''), trim(var_name), ''), '\\s+', ' ', 'g')) AS d0
           FROM w1) w ON w.var_id = s.field""", "candidates", "codebook", extra=QCTES))
def q_j2(spark, sf_dir):
    meta = qo.dedupe_first(qo.drop_unscored(candidates(spark, sf_dir)))
    out = rf.attach_field_metadata(_doc_stats(spark, sf_dir), meta)
    return out.select("cluster_id", "field", "category", "short_label", "description",
                      F.col("metrics")["n"].cast("long").alias("n_metric"))


@register("match_cluster_households", with_views("""
SELECT p.cluster_id, count(*) AS n FROM (SELECT DISTINCT cluster AS cluster_id FROM labeled WHERE cluster <> -1) p
JOIN labeled l ON TRY_CAST(CAST(l.cluster AS VARCHAR) AS DOUBLE) = TRY_CAST(CAST(p.cluster_id AS VARCHAR) AS DOUBLE)
GROUP BY p.cluster_id""", "labeled"))
def q_j3(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    m = rf.match_cluster_households(_profiles(spark, sf_dir), lab)
    return m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def _supp_meta(prof):
    """Field metadata derived from the column profile of households."""
    from pyspark.sql import Window
    return prof.select(
        "ord", F.col("field_name").alias("var_id"),
        F.when(F.col("field_type") == "categorical", "demographics").when(F.col("field_type") == "binary", "identifier")
        .otherwise("income").alias("category"),
        F.upper(F.col("field_name")).alias("label"),
        F.when(F.col("field_type") == "continuous", F.col("quality_score") * 10).otherwise(F.lit(0.0))
        .cast("string").alias("composite_score"),
        F.col("n_unique").cast("string").alias("importance_score"),
        (F.col("completeness") * 100).cast("string").alias("usable_percentage"))


def _w18_sql() -> str:
    from hearth.plans.sqlgen import HOUSEHOLD_SCHEMA, build, profile_ctes
    cols = [c for c, _ in HOUSEHOLD_SCHEMA if c not in ("hid", "o_custkey")]
    vals = " UNION ALL ".join(f"SELECT hid, '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM households" for c in cols)
    meta = """SELECT ord, field_name AS var_id,
        CASE WHEN field_type = 'categorical' THEN 'demographics' WHEN field_type = 'binary' THEN 'identifier' ELSE 'income' END AS cat,
        upper(field_name) AS label,
        CASE WHEN field_type = 'continuous' THEN quality_score * 10 ELSE 0.0 END AS comp,
        CAST(n_unique AS DOUBLE) * 10.0 + completeness * 100 / 10.0 AS alt FROM p_prof"""
    ranked = """SELECT var_id AS field, label, cat, row_number() OVER (ORDER BY cat = 'demographics' DESC,
                CASE WHEN comp > 0 THEN comp ELSE alt END DESC, ord) AS rank FROM meta
                WHERE lower(var_id) NOT IN ('total') AND cat <> 'identifier'"""
    body = """SELECT hid, CAST(pos AS INTEGER) AS pos, field, label, value FROM (
      SELECT *, row_number() OVER (PARTITION BY hid ORDER BY rank) AS pos FROM (
        SELECT v.hid, v.field, v.value, r.label, r.rank, r.cat,
               row_number() OVER (PARTITION BY v.hid, r.cat ORDER BY r.rank) AS c
        FROM vals v JOIN ranked r USING (field) WHERE v.value IS NOT NULL)
      WHERE c <= CASE WHEN cat = 'demographics' THEN 3 ELSE 2 END) WHERE pos <= 10"""
    return build(profile_ctes("households", HOUSEHOLD_SCHEMA) + [("vals", vals), ("meta", meta), ("ranked", ranked)], body)


@register("supplementary_fields", _w18_sql())
def q_w18(spark, sf_dir):
    from hearth.operators import profile as pf
    h = households(spark, sf_dir)
    meta = _supp_meta(pf.field_profile(h))
    long = h.select("hid", *[c for c in h.columns if c not in ("hid", "o_custkey")]).select(
        "hid", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                                   for c in h.columns if c not in ("hid", "o_custkey")])).alias("c")).select("hid", "c.*")
    return rf.supplementary_fields(long, meta, used=["total"]).select(
        "hid", F.col("pos").cast("int").alias("pos"), "field", "label", "value")


@register("k_sweep_kmodes")
def q_c12(spark, sf_dir):
    """Cost-only k-modes sweep (k = 2..15) and its elbow (property-checked)."""
    from hearth.operators import kselect as ks
    from hearth.plans.k_sweep import kmodes_sweep
    from hearth.plans.q_kproto import features
    cat = ["status", "priority", "ret_status"]
    kt = kmodes_sweep(features(spark, sf_dir, [], cat), cat)
    e = ks.elbow(kt).collect()[0]["elbow_k"]
    return kt.withColumn("elbow_k", F.lit(e))


@register("pca_2d")
def q_c13(spark, sf_dir):
    """Two principal components of the z-scored numerics (signs arbitrary)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from hearth.plans.q_kproto import features
    from hearth.sources.tables import HOUSEHOLD_CONTINUOUS
    num = list(HOUSEHOLD_CONTINUOUS)
    f = features(spark, sf_dir, num, [])
    v = VectorAssembler(inputCols=num, outputCol="x").transform(f)
    model = PCA(k=2, inputCol="x", outputCol="pc").fit(v)
    ev = [float(x) for x in model.explainedVariance]
    from pyspark.ml.functions import vector_to_array
    out = model.transform(v).select("hid", vector_to_array("pc").alias("a"))
    return out.select("hid", F.col("a")[0].alias("pc1"), F.col("a")[1].alias("pc2"),
                      F.lit(ev[0]).alias("explained_1"), F.lit(ev[1]).alias("explained_2"))


def _stats_long(prof):
    cells, ordmap = [], {}
    for c in prof.columns:
        for m in ("mean", "std", "median", "mode"):
            if c.endswith("_" + m):
                base = c[: -len(m) - 1]
                ordmap.setdefault(base, len(ordmap))
                num = F.col(c).cast("double") if m != "mode" else F.lit(None).cast("double")
                cells.append(F.struct(F.lit(base).alias("field"), F.lit(m).alias("metric"), num.alias("num"),
                                      F.col(c).cast("string").alias("txt"), F.lit(ordmap[base]).alias("ord")))
                break
    return prof.select("cluster_id", F.explode(F.array(*cells)).alias("s")).select("cluster_id", "s.*")


def _t23_sql() -> str:
    lines = []
    order = {}
    for f in HOUSEHOLD_CONTINUOUS:
        order.setdefault(f, len(order))
    for f in HOUSEHOLD_CATEGORICAL:
        order.setdefault(f, len(order))
    modes = " UNION ALL ".join(f"SELECT cluster_id, {order[f]} AS ord, '- {f}: mode=' || coalesce(CAST({f}_mode AS VARCHAR), 'N/A') AS line FROM prof"
                               for f in HOUSEHOLD_CATEGORICAL)
    def g(x):
        return f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 'N/A' ELSE printf('%.4g', {x}) END"
    nums = " UNION ALL ".join(f"SELECT cluster_id, {order[f]} AS ord, '- {f}: mean=' || {g(f + '_mean')} || ', std=' || {g(f + '_std')} AS line FROM prof"
                              for f in HOUSEHOLD_CONTINUOUS)
    return f"""
SELECT p.cluster_id, concat_ws(chr(10) || chr(10),
    'Cluster size: ' || CAST(p.n_samples AS VARCHAR) || chr(10) || 'Share: ' || printf('%.1f', p.percentage) || '%',
    'Modes of categorical fields:' || chr(10) || m.t, 'Numeric fields:' || chr(10) || n.t) AS profile_text
FROM prof p
LEFT JOIN (SELECT cluster_id, string_agg(line, chr(10) ORDER BY ord) AS t FROM (SELECT * FROM ({modes}) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY ord) <= 18) GROUP BY cluster_id) m USING (cluster_id)
LEFT JOIN (SELECT cluster_id, string_agg(line, chr(10) ORDER BY ord) AS t FROM (SELECT * FROM ({nums}) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY ord) <= 10) GROUP BY cluster_id) n USING (cluster_id)"""


@register("profile_text", with_views(_t23_sql(), "labeled", extra=_PROF))
def q_t23(spark, sf_dir):
    prof = _profiles(spark, sf_dir)
    return pt.profile_text(_stats_long(prof), prof.select("cluster_id", "n_samples", "percentage"))


@register("persona_prompt_table")
def q_t24(spark, sf_dir):
    """One prompt row per cluster: profile text (T23), the sample value
    distributions (A17 over a 50-household sample, W13) and the field
    dictionary (T22, metadata from the household column profile)."""
    from hearth.operators import profile as pf
    from hearth.operators import refine as rfo
    prof = _profiles(spark, sf_dir)
    text = pt.profile_text(_stats_long(prof), prof.select("cluster_id", "n_samples", "percentage"))
    samp = rfo.per_cluster_sample(labeled(spark, sf_dir).where(F.col("cluster") != -1), 50, 42)
    dist = cs.sample_distributions(samp, ["status", "priority"]).withColumnRenamed("cluster", "cluster_id")
    dist_txt = dist.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("field", "value", "n"))), lambda e: F.concat(F.lit("- "), e["field"], F.lit("="), e["value"], F.lit(": "),
                                                              e["n"].cast("string"))), "\n").alias("sample_text"))
    meta = pf.field_profile(households(spark, sf_dir)).select(
        F.col("field_name").alias("var_id"), F.col("field_type").alias("category"),
        F.upper("field_name").alias("short_label"), F.lit("").alias("description"), F.col("field_name").alias("var_name"))
    fields = _stats_long(prof).select("field", "ord").distinct()
    dic = pt.field_dictionary(fields, meta)
    j = text.join(dist_txt, "cluster_id", "left")
    d = dic.collect()[0]["dictionary"]  # one row (bounded by 25 lines)
    return j.select("cluster_id", F.concat_ws("\n\n", "profile_text",
                                              F.concat(F.lit("Sample households:\n"), F.col("sample_text")),
                                              F.concat(F.lit("Field dictionary:\n"), F.lit(d or ""))).alias("prompt"))


def _t15_sql() -> str:
    """The twin reads the four shapes with JSON functions; objects here nest one level."""
    import json

    from hearth.functions import responses as rp
    logic, biases = json.dumps(rp.FAILED_LOGIC), json.dumps(rp.FAILED_BIASES)
    extra = _PROF + [
        ("raw", """SELECT cluster_id, CASE cluster_id % 4 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
                   WHEN 2 THEN 'Here it is: ' || body || ' thanks' ELSE substr(body, 1, 30) END AS resp FROM (
                   SELECT cluster_id, '{"persona_name": "Group ' || cluster_id || '", "core_characteristics": "modal status ' || coalesce(status_mode, '?')
                   || '", "behavior_patterns": ["p1", "p2"], "decision_making_logic": "not an object", "note": ' || n_samples
                   || ', "behavioral_biases": {"loss_aversion":"seen ' || cluster_id || ' times"}}' AS body FROM prof)"""),
        ("got", r"""SELECT *, CASE WHEN json_valid(resp) THEN resp ELSE nullif(regexp_extract(resp, '\{([^{}]|\{[^{}]*\})*\}'), '') END AS j FROM raw""")]
    return with_views(f"""
SELECT cluster_id, 'psid_cluster_' || cluster_id AS persona_id, coalesce(j ->> '$.persona_name', 'Unnamed Group') AS persona_name,
       coalesce(j ->> '$.core_characteristics', substr(resp, 1, 200)) AS core_characteristics,
       CASE WHEN j IS NULL THEN 0 ELSE json_array_length(j, '$.behavior_patterns') END::INTEGER AS n_patterns,
       CASE WHEN j IS NULL THEN '{logic}' ELSE '{{}}' END AS decision_making_logic,
       CASE WHEN j IS NULL THEN '{biases}' ELSE CAST(j -> '$.behavioral_biases' AS VARCHAR) END AS behavioral_biases,
       coalesce(j ->> '$.note', '') AS note, CASE WHEN j IS NULL THEN 'behavioral_biases' ELSE 'behavioral_biases,note' END AS extra_keys,
       j IS NULL AS parse_error FROM got""", "labeled", extra=extra)


@register("parse_persona_response", _t15_sql())
def q_t15(spark, sf_dir):
    """Persona responses in four shapes built from each cluster profile (bare JSON,
    fenced, embedded in prose, truncated), with keys beyond the base record."""
    from hearth.functions import responses as rp
    prof = _profiles(spark, sf_dir)
    body = F.concat(F.lit('{"persona_name": "Group '), F.col("cluster_id").cast("string"),
                    F.lit('", "core_characteristics": "modal status '), F.coalesce(F.col("status_mode"), F.lit("?")),
                    F.lit('", "behavior_patterns": ["p1", "p2"], "decision_making_logic": "not an object", "note": '), F.col("n_samples").cast("string"),
                    F.lit(', "behavioral_biases": {"loss_aversion":"seen '), F.col("cluster_id").cast("string"), F.lit(' times"}}'))
    k = F.col("cluster_id") % 4
    resp = (F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(k == 2, F.concat(F.lit("Here it is: "), body, F.lit(" thanks"))).otherwise(F.substring(body, 1, 30)))
    parsed = prof.select("cluster_id", rp.parse_persona_response(resp).alias("p"))
    return pt.tag_persona(parsed.select("cluster_id", "p.*"), "psid").select(
        "cluster_id", "persona_id", "persona_name", "core_characteristics", F.size("behavior_patterns").alias("n_patterns"),
        "decision_making_logic", F.col("extra")["behavioral_biases"].alias("behavioral_biases"),
        F.coalesce(F.col("extra")["note"], F.lit("")).alias("note"), F.array_join(F.array_sort(F.map_keys("extra")), ",").alias("extra_keys"), "parse_error")


@register("fit_prompt_table")
def q_t25(spark, sf_dir):
    """T25 over the iteration-1 sample (W14) and each household's persona."""
    from hearth.operators import profile as pf
    from hearth.plans.q_refine import _sample
    prof = _profiles(spark, sf_dir)
    stats = _stats_long(prof).withColumnRenamed("cluster_id", "persona_id")
    s = _sample(spark, sf_dir).select("hid", "persona_id")
    h = households(spark, sf_dir)
    cols = [c for c in h.columns if c not in ("hid", "o_custkey")]
    vals = h.join(s.select("hid"), "hid").select("hid", F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])).alias("c")).select("hid", "c.*")
    sup = rf.supplementary_fields(vals, _supp_meta(pf.field_profile(h)), used=HOUSEHOLD_CONTINUOUS + HOUSEHOLD_CATEGORICAL)
    return pt.fit_prompt_table(s, vals, stats, sup)


@register("survey_prompt_table")
def q_t26(spark, sf_dir):
    """T26 for every labelled household with its persona."""
    lab = labeled(spark, sf_dir).where(F.col("cluster") != -1).withColumn("persona_id", F.col("cluster"))
    names = _profiles(spark, sf_dir).select(F.col("cluster_id").alias("persona_id"),
                                            F.concat(F.lit("Persona "), F.col("cluster_id").cast("string")).alias("persona_name"))
    concepts = {"order status": ["status"], "priority": ["priority", "ret_status"], "line count": ["n_lines"],
                "returns": ["has_return"]}
    return pt.survey_prompt_table(lab, concepts, names)
