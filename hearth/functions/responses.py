"""Parsing model responses held in a table.

All cascades are built-in expressions: ``regexp_extract`` for fences and
brace spans, ``try_parse_json`` (VARIANT) to test validity, ``variant_get``
for fields.  Only the brace-balanced scanner (T14) is a Pandas UDF, because
string- and escape-aware bracket matching is not a regular language.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = ["A", "B", "C", "D", "E"]
EMPTY_FIELDS = '{"fields": []}'
# Questionnaire questions whose "unknown" answer is D rather than C
UNKNOWN_D = {"psid": ["q3", "q5"], "shed": ["q2", "q5"]}
FIT_ONLY_DATASETS = ["acs", "ces", "sipp"]


def _valid(c: Column) -> Column:
    return (c != "") & F.try_parse_json(c).isNotNull()


def extract_json_response(text: Column) -> Column:
    """struct(json, source): whole text, else ```json fence, else any fence,
    else first '{' .. last '}', else '{"fields": []}'."""
    t = F.coalesce(text, F.lit(""))
    c_json = F.regexp_extract(t, r"(?s)```json\s*(.*?)\s*```", 1)
    c_any = F.regexp_extract(t, r"(?s)```\s*(.*?)\s*```", 1)
    c_brace = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return (F.when(_valid(t), F.struct(t.alias("json"), F.lit("whole").alias("source")))
            .when(_valid(c_json), F.struct(c_json.alias("json"), F.lit("json_fence").alias("source")))
            .when(_valid(c_any), F.struct(c_any.alias("json"), F.lit("fence").alias("source")))
            .when(_valid(c_brace), F.struct(c_brace.alias("json"), F.lit("braces").alias("source")))
            .otherwise(F.struct(F.lit(EMPTY_FIELDS).alias("json"), F.lit("default").alias("source"))))


def _ws_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_fenced(text: Column) -> Column:
    """Strip whitespace, a leading ```json or ```, and a trailing ```."""
    s = _ws_trim(F.coalesce(text, F.lit("")))
    s = F.when(s.startswith("```json"), F.substring(s, 8, 1 << 30)).otherwise(s)
    s = F.when(s.startswith("```"), F.substring(s, 4, 1 << 30)).otherwise(s)
    s = F.when(s.endswith("```"), F.substr(s, F.lit(1), F.length(s) - 3)).otherwise(s)
    return _ws_trim(s)


def parse_fit_response(text: Column) -> Column:
    """struct(fit_score, reasoning, parse_error).  Fences stripped; a JSON
    object is required; ``fit_score`` absent -> 0.5, not a number -> parse
    error (0.5); clamped to [0, 1]."""
    body = clean_fenced(text)
    v = F.try_parse_json(body)
    is_obj = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    sval = F.try_variant_get(v, "$.fit_score", "string")
    fit = F.try_variant_get(v, "$.fit_score", "double")
    error = ~F.coalesce(is_obj, F.lit(False)) | (sval.isNotNull() & fit.isNull())
    score = F.when(error | sval.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fit)))
    reasoning = F.when(error, F.concat(F.lit("Parse error: "), F.substring(F.coalesce(text, F.lit("")), 1, 100))) \
        .otherwise(F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("No reasoning provided")))
    return F.struct(score.alias("fit_score"), reasoning.alias("reasoning"), error.alias("parse_error"))


def questionnaire_score(truth: list[Column], predictions_json: Column, dataset: str) -> Column:
    """10 questions.  Truth missing / not A-E / the dataset's "unknown"
    letter counts as correct; otherwise the normalised prediction must match.
    No usable truth -> 1.0; predictions not a JSON object -> max(0.5, missing/10)."""
    ds = (dataset or "").strip().lower()
    preds = F.from_json(predictions_json, "map<string,string>")
    v = F.try_parse_json(predictions_json)
    is_obj = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    missing = F.lit(0)
    correct = F.lit(0)
    usable = F.lit(0)
    for i, t in enumerate(truth, start=1):
        q = f"q{i}"
        gt = F.upper(_ws_trim(t.cast("string")))
        unknown_letter = "D" if q in UNKNOWN_D.get(ds, []) else "C"
        is_unknown = gt == unknown_letter
        miss = t.isNull() | ~gt.isin(LETTERS) | F.coalesce(is_unknown, F.lit(False))
        miss = F.coalesce(miss, F.lit(True))
        pred = normalize_answer(preds[q])  # staged by questionnaire_scores()
        hit = (~miss) & (pred != "") & (pred == gt)
        missing = missing + miss.cast("int")
        usable = usable + (~miss).cast("int")
        correct = correct + F.coalesce(hit, F.lit(False)).cast("int")
    return (F.when(usable == 0, F.lit(1.0))
            .when(~F.coalesce(is_obj, F.lit(False)), F.greatest(F.lit(0.5), missing / 10.0))
            .otherwise((missing + correct) / 10.0))


def combined_score(fit: Column, questionnaire: Column, dataset: str) -> Column:
    """R2: fit only for acs / ces / sipp, else the mean of fit and questionnaire."""
    if (dataset or "").strip().lower() in FIT_ONLY_DATASETS:
        return fit
    return fit * 0.5 + questionnaire * 0.5


def normalize_answer(raw: Column) -> Column:
    """Upper-cased; a leading A-E wins, else the first standalone A-E token
    (non-alphanumerics split tokens), else ''.  The leading-letter test is a
    plain substring check; the token regexes only run for the other rows."""
    s = F.upper(F.btrim(raw.cast("string"), F.lit(" \t\n\r\x0b\x0c")))
    first = F.substring(s, 1, 1)
    cleaned = F.concat(F.lit(" "), F.regexp_replace(s, r"[^\p{L}\p{N}]", " "), F.lit(" "))
    tok = F.regexp_extract(cleaned, r" ([A-E])(?= )", 1)
    return (F.when(raw.isNull(), F.lit("")).when(first.isin(*LETTERS), first)
            .otherwise(F.coalesce(tok, F.lit(""))))


_SIGNS = re.compile(r'["\\{}]')


@dataclass
class _Reading:
    """One way to read the text from some opener on: inside a string or not, the escaped
    position, the depth, and the openers that wait to be closed, by depth."""
    inside: bool
    escaped: int
    depth: int
    waiting: dict[int, list[int]]

    def join(self, other: "_Reading") -> "_Reading":
        """Both readings agree from here on: one goes on with the openers of both."""
        keep, add = (self, other) if len(self.waiting) >= len(other.waiting) else (other, self)
        for depth, starts in add.waiting.items():
            keep.waiting.setdefault(depth - add.depth + keep.depth, []).extend(starts)
        return keep


def _first_closed(text: str) -> str | None:
    """The object of the first opener that is closed, in one pass.

    An opener counts strings from itself on, so one inside what an earlier opener takes
    for a string reads on differently.  At any place there are at most three readings
    (outside a string, inside, behind a backslash); those that come to agree are joined."""
    first = text.find("{")
    readings: list[_Reading] = []
    best: tuple[int, int] | None = None
    for m in _SIGNS.finditer(text, max(first, 0)) if first >= 0 else ():
        at, sign = m.start(), m[0]
        outside = [r for r in readings if not r.inside]
        if sign == "{":
            if not outside:
                outside = [_Reading(False, -1, 0, {})]
                readings += outside
            for r in outside:
                r.depth += 1
                r.waiting.setdefault(r.depth, []).append(at)
        elif sign == "}":
            for r in outside:
                for start in r.waiting.pop(r.depth, ()):
                    if start == first:
                        return text[start:at + 1]
                    best = min(best or (start, at + 1), (start, at + 1))
                r.depth -= 1
        else:
            for r in readings:
                if r.inside and r.escaped == at:
                    continue
                if sign == '"':
                    r.inside = not r.inside
                elif r.inside:
                    r.escaped = at + 1
        if len(readings) > 1:
            by_state: dict[tuple, _Reading] = {}
            for r in readings:
                state = (r.inside, r.inside and r.escaped == at + 1)
                by_state[state] = by_state[state].join(r) if state in by_state else r
            readings = list(by_state.values())
    return None if best is None else text[best[0]:best[1]]


# a JSON string (closed or running to the end of the text), or one structural character
_TOKENS = {pair: re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|' + pair, re.S) for pair in (r"[{}]", r"[\[\]]")}


def _balanced_from(text: str, start: int) -> str | None:
    """The balanced piece that opens at ``start``; only its own kind of bracket counts."""
    tokens = _TOKENS[r"[{}]" if text[start] == "{" else r"[\[\]]"].finditer(text, start)
    marks = [m for m in tokens if m[0][0] != '"']
    depths = accumulate(1 if m[0] in "{[" else -1 for m in marks)
    end = next((m.end() for m, depth in zip(marks, depths) if depth == 0), None)
    return None if end is None else text[start:end]


def balanced_json_py(text: str | None, allow_array: bool = False) -> str | None:
    """The first balanced object.  An opener that never closes is passed
    over for the next one.  With ``allow_array`` the first object or array
    decides alone.  Brackets inside JSON strings do not count.  Time grows
    with the length of the text, however many openers stay unclosed."""
    if not text:
        return None
    if allow_array:
        first = re.search(r"[{\[]", text)
        return _balanced_from(text, first.start()) if first else None
    return _first_closed(text)


def _scan_objects(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: balanced_json_py(t, False))


def _scan_objects_or_arrays(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: balanced_json_py(t, True))


def balanced_json(c: Column) -> Column:
    """T14 as an Arrow-batched Pandas UDF (created lazily, on the driver)."""
    return F.pandas_udf(_scan_objects, "string")(c)


def balanced_json_or_array(c: Column) -> Column:
    return F.pandas_udf(_scan_objects_or_arrays, "string")(c)


def questionnaire_scores(df, truth_cols: list[str], answers_col: str, dataset: str, out: str = "score"):
    """R1 as staged columns: the answer object is parsed once and every
    answer normalised once (instead of re-parsing per question)."""
    ds = (dataset or "").strip().lower()
    d = df.withColumn("_m", F.from_json(F.col(answers_col), "map<string,string>")) \
          .withColumn("_obj", F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(answers_col))).startswith("OBJECT"),
                                         F.lit(False)))
    for i, _ in enumerate(truth_cols, start=1):
        d = d.withColumn(f"_p{i}", normalize_answer(F.col("_m")[f"q{i}"]))
    missing, correct, usable = F.lit(0), F.lit(0), F.lit(0)
    for i, t in enumerate(truth_cols, start=1):
        q = f"q{i}"
        gt = F.upper(_ws_trim(F.col(t).cast("string")))
        unknown_letter = "D" if q in UNKNOWN_D.get(ds, []) else "C"
        miss = F.coalesce(F.col(t).isNull() | ~gt.isin(LETTERS) | (gt == unknown_letter), F.lit(True))
        hit = F.coalesce((~miss) & (F.col(f"_p{i}") != "") & (F.col(f"_p{i}") == gt), F.lit(False))
        missing, usable, correct = missing + miss.cast("int"), usable + (~miss).cast("int"), correct + hit.cast("int")
    score = (F.when(usable == 0, F.lit(1.0)).when(~F.col("_obj"), F.greatest(F.lit(0.5), missing / 10.0))
             .otherwise((missing + correct) / 10.0))
    return d.withColumn(out, score).drop("_m", "_obj", *[f"_p{i}" for i in range(1, len(truth_cols) + 1)])


PERSONA_LIST_KEYS = ["behavior_patterns", "pain_points", "opportunities"]
PERSONA_KEYS = ["persona_name", "core_characteristics", *PERSONA_LIST_KEYS, "decision_making_logic", "behavioral_drivers"]
# The empty record of a response that cannot be read
FAILED_LOGIC = {
    "financial_decisions": {"core_logic": "", "priorities": [], "key_constraints": [], "mental_models": []},
    "consumption_decisions": {"core_logic": "", "spending_drivers": [], "value_evaluation": "", "priorities": []},
    "investment_decisions": {"core_logic": "", "risk_approach": "", "time_horizon": "", "investment_drivers": []}}
FAILED_DRIVERS = {"core_constraints": [], "mental_models": [], "behavioral_triggers": []}
FAILED_BIASES = dict.fromkeys(["loss_aversion", "present_bias", "status_quo_bias", "overconfidence", "mental_accounting",
                               "ambiguity_aversion", "social_comparison"], "")


def parse_persona_response(text: Column, statistics: Column | None = None) -> Column:
    """struct(persona_name, core_characteristics, behavior_patterns,
    pain_points, opportunities, decision_making_logic, behavioral_drivers, extra,
    statistics, parse_error).  Whole text first, else the first balanced object/array
    (T14 scanner, correct escapes - D16); the root must be an object.  Base
    keys default to '' / []; decision_making_logic and behavioral_drivers are
    forced to objects (JSON text).  All other keys of the record (``behavioral_biases``
    and whatever the model adds) are kept in ``extra``, a map of key to JSON text; a key
    that comes back as ``statistics`` gives way to the given ``statistics``.  On failure:
    'Unnamed Group', the first 200 characters as core characteristics, the empty record,
    parse_error."""
    t = _ws_trim(F.coalesce(text, F.lit("")))
    v = F.coalesce(F.try_parse_json(t), F.try_parse_json(balanced_json_or_array(t)))
    is_obj = F.coalesce(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))

    def obj_json(key: str) -> Column:
        sub = F.try_variant_get(v, f"$.{key}", "variant")
        ok = sub.isNotNull() & F.schema_of_variant(sub).startswith("OBJECT")
        return F.when(ok, F.to_json(sub)).otherwise(F.lit("{}"))

    def str_list(key: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array().cast("array<string>"))

    every = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rest = F.transform_values(F.map_filter(every, lambda k, _: ~k.isin([*PERSONA_KEYS, "statistics"])),
                              lambda _, x: F.coalesce(F.to_json(x), F.lit("null")))
    stats = statistics if statistics is not None else F.lit(None).cast("string")
    ok = F.struct(
        F.coalesce(F.try_variant_get(v, "$.persona_name", "string"), F.lit("")).alias("persona_name"),
        F.coalesce(F.try_variant_get(v, "$.core_characteristics", "string"), F.lit("")).alias("core_characteristics"),
        *[str_list(k).alias(k) for k in PERSONA_LIST_KEYS],
        obj_json("decision_making_logic").alias("decision_making_logic"),
        obj_json("behavioral_drivers").alias("behavioral_drivers"),
        rest.alias("extra"), stats.alias("statistics"), F.lit(False).alias("parse_error"))
    bad = F.struct(
        F.lit("Unnamed Group").alias("persona_name"),
        F.substring(F.coalesce(text, F.lit("")), 1, 200).alias("core_characteristics"),
        *[F.array().cast("array<string>").alias(k) for k in PERSONA_LIST_KEYS],
        F.lit(json.dumps(FAILED_LOGIC)).alias("decision_making_logic"), F.lit(json.dumps(FAILED_DRIVERS)).alias("behavioral_drivers"),
        F.create_map(F.lit("behavioral_biases"), F.lit(json.dumps(FAILED_BIASES))).alias("extra"), stats.alias("statistics"),
        F.lit(True).alias("parse_error"))
    return F.when(is_obj, ok).otherwise(bad)
