"""DuckDB twins of the registered queries (the correctness gate).

Each entry is plain SQL over the driver tables.  Fixture views from
FIXTURES.md B are prepended as CTEs by ``with_views``.  SQL text for wide
tables is generated from column lists, never hand-copied per column.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}
VIEW_DEPS: dict[str, list[str]] = {}


def view(name: str, sql: str, deps: list[str] | None = None) -> None:
    VIEWS[name] = sql
    VIEW_DEPS[name] = deps or []


view("households", """
SELECT o.o_orderkey AS hid, o.o_custkey, o.o_orderstatus AS status, o.o_orderpriority AS priority,
       o.o_totalprice AS total, COUNT(l.l_orderkey) AS n_lines,
       CASE WHEN COUNT(l.l_orderkey) > 0 THEN 1 ELSE 0 END AS has_lines,
       MAX(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_return,
       AVG(CASE WHEN l.l_returnflag = 'R' THEN l.l_extendedprice END) AS ret_avg,
       AVG(l.l_quantity) AS qty_avg, AVG(l.l_discount) AS disc_avg,
       MIN(CASE WHEN l.l_returnflag = 'R' THEN l.l_linestatus END) AS ret_status
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY 1, 2, 3, 4, 5""")

view("households_labeled", """
SELECT *, CAST(CASE WHEN hid % 500 = 0 THEN 7 ELSE o_custkey % 7 END AS INTEGER) AS cluster
FROM households""", ["households"])


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in VIEW_DEPS[n]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs of the named fixture views (and ``extra``
    ``(name, sql)`` pairs, in order)."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _closure(list(names))]
    ctes += [f"{n} AS ({s})" for n, s in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sql_mode(src: str, keys: list[str], field: str, alias: str) -> str:
    """Most frequent non-null value per key, ties -> smallest value."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    return (f"SELECT {k + ', ' if keys else ''}{field} AS {alias} FROM ("
            f"SELECT {k + ', ' if keys else ''}{field}, row_number() OVER ({part} ORDER BY count(*) DESC, {field}) AS _rn "
            f"FROM {src} WHERE {field} IS NOT NULL GROUP BY {k + ', ' if keys else ''}{field}) WHERE _rn = 1")


view("candidates", """
SELECT d.doc_id AS seq, 'psid' AS dataset, 'v' || CAST(d.doc_id % 700 AS VARCHAR) AS var_id,
       'field_' || CAST(d.doc_id AS VARCHAR) AS var_name, d.text AS description, d.source AS short_label,
       CASE WHEN d.doc_id % 97 = 0 THEN 'identifier'
            ELSE CASE d.lang WHEN 'en' THEN 'demographics' WHEN 'fr' THEN 'income' WHEN 'de' THEN 'debt'
                 ELSE d.lang END END AS category,
       CASE WHEN d.doc_id % 89 = 0 THEN 'identifier' WHEN l.quality = 1 THEN 'continuous'
            ELSE 'categorical' END AS data_type,
       CAST(d.doc_id % 101 AS VARCHAR) || '%' AS usable_percentage,
       CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 50 = 0 THEN 'bad'
            ELSE CAST(1 + d.n_chars % 10 AS VARCHAR) END AS importance_score,
       CASE WHEN l.toxic = 1 THEN 'flagged' ELSE 'ok' END AS reasoning, coalesce(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

view("codebook", """
SELECT var_id, CASE WHEN max(doc_id) % 3 = 0 THEN '' ELSE arg_max(source || '-' || lang, doc_id) END AS label,
       arg_max(text, doc_id) AS description
FROM (SELECT *, 'v' || CAST(doc_id % 700 AS VARCHAR) AS var_id FROM documents) GROUP BY var_id""")

# responses: fit-score JSON in six shapes by event_id % 6 (bare, ```json fence,
# embedded in prose, truncated, bare fence, list root); scores span -0.2 .. 1.09
view("responses", """
SELECT event_id AS rid, event_type, resp FROM (
  SELECT event_id, event_type,
         '{"fit_score": ' || CAST((event_id * 37) % 130 - 20 AS VARCHAR) || 'e-2, "reasoning": "' || event_type
           || ' event"}' AS body,
         CAST((event_id * 37) % 130 - 20 AS VARCHAR) AS fit_txt
  FROM events) x,
LATERAL (SELECT CASE event_id % 6
    WHEN 0 THEN body
    WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
    WHEN 2 THEN 'Here is my assessment: ' || body || ' Hope this helps.'
    WHEN 3 THEN '{"fit_score": ' || fit_txt || 'e-2, "reasoning": "cut'
    WHEN 4 THEN '```' || chr(10) || body || chr(10) || '```'
    ELSE '[' || body || ']' END AS resp)""")

# answers: truth letter (event_id * q) % 6 and prediction (event_id * q + event_id % 3) % 6,
# 0 = missing, 1..5 = A..E; predictions decorated by event_id % 4 ("A", "A.", "a)", "(A)");
# every 7th event answers with a JSON list instead of an object
view("answers", "SELECT event_id AS hid, " + ", ".join(
    f"CASE (event_id * {q}) % 6 WHEN 0 THEN NULL ELSE chr(64 + CAST((event_id * {q}) % 6 AS INTEGER)) END AS q{q}_gt"
    for q in range(1, 11)) + """,
  CASE WHEN event_id % 7 = 0 THEN '["A", "B"]' ELSE '{' || """ + " || ', ' || ".join(
    f"""'"q{q}": ' || CASE (event_id * {q} + event_id % 3) % 6 WHEN 0 THEN 'null' ELSE '"' ||
        CASE event_id % 4 WHEN 0 THEN chr(64 + CAST((event_id * {q} + event_id % 3) % 6 AS INTEGER))
                          WHEN 1 THEN chr(64 + CAST((event_id * {q} + event_id % 3) % 6 AS INTEGER)) || '.'
                          WHEN 2 THEN lower(chr(64 + CAST((event_id * {q} + event_id % 3) % 6 AS INTEGER))) || ')'
                          ELSE '(' || chr(64 + CAST((event_id * {q} + event_id % 3) % 6 AS INTEGER)) || ')' END
        || '"' END""" for q in range(1, 11)) + """ || '}' END AS answers
FROM events""")

# text_blocks: every document is a variable; its lines are its code values
view("text_blocks", """
SELECT doc_id AS seq, source AS grp, 'd' || CAST(doc_id AS VARCHAR) AS var_id,
       source || ' ' || lang AS label, text AS description,
       list_transform(string_split(text, chr(10)), lambda x, i: {'value': CAST(i AS VARCHAR), 'text': x}) AS code_values,
       CAST(n_chars AS VARCHAR) || ' chars' AS availability
FROM documents""")

# labeled: households_labeled after the small-cluster rule (C8), noise = -1
view("labeled", """
SELECT h.* EXCLUDE (cluster), CAST(CASE WHEN s.n < t.t THEN -1 ELSE h.cluster END AS INTEGER) AS cluster
FROM households_labeled h JOIN (SELECT cluster, count(*) AS n FROM households_labeled GROUP BY cluster) s USING (cluster),
     (SELECT greatest(5, round_even(0.01 * count(*), 0)) AS t FROM households_labeled) t""", ["households_labeled"])

# state: status by hid % 5 (validated, problem, pending, unseen, unseen)
view("state", """
SELECT hid, cluster, CASE hid % 5 WHEN 0 THEN 'validated' WHEN 1 THEN 'problem' WHEN 2 THEN 'pending'
                     ELSE 'unseen' END AS status,
       cluster AS initial_cluster, cluster AS initial_persona,
       CASE WHEN hid % 5 = 0 THEN cluster END AS last_valid_cluster,
       CASE WHEN hid % 5 = 0 THEN cluster END AS last_valid_persona
FROM labeled""", ["labeled"])

# evaluated(hid, persona_id): validated / problem rows for their own persona, pending ones for the next persona
view("evaluated", """
SELECT hid, CASE WHEN hid % 5 = 2 THEN CAST((cluster + 1) % 7 AS INTEGER) ELSE cluster END AS persona_id
FROM labeled WHERE hid % 5 IN (0, 1, 2) AND cluster >= 0""", ["labeled"])
