"""Golden rows for the response parsers."""

import json

from pyspark.sql import functions as F

from hearth.functions import responses as rp

FIT_ROWS = [
    ('{"fit_score": 0.75, "reasoning": "ok"}', 0.75, "ok", False),
    ('```json\n{"fit_score": 0.8, "reasoning": "fenced"}\n```', 0.8, "fenced", False),
    ('```\n{"fit_score": 0.4}\n```', 0.4, "No reasoning provided", False),
    ('Sure: {"fit_score": 0.9}', 0.5, None, True),
    ('{"fit_score": 0.7, "reasoning": "cut', 0.5, None, True),
    ("", 0.5, None, True),
    ('[{"fit_score": 0.9}]', 0.5, None, True),
    ('{"fit_score": 1.7}', 1.0, "No reasoning provided", False),
    ('{"fit_score": -0.2}', 0.0, "No reasoning provided", False),
    ('{"reasoning": "no score"}', 0.5, "no score", False),
    ('{"fit_score": "abc"}', 0.5, None, True),
    ('{"fit_score": 0.6, "reasoning": "say \\"hi\\" {x}"}', 0.6, 'say "hi" {x}', False),
]


def test_parse_fit_response(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(FIT_ROWS)], "i int, t string")
    out = {r.i: r for r in df.select("i", rp.parse_fit_response(F.col("t")).alias("x")).select("i", "x.*").collect()}
    for i, (text, score, reason, err) in enumerate(FIT_ROWS):
        assert abs(out[i].fit_score - score) < 1e-12, (text, out[i])
        assert out[i].parse_error == err, text
        if reason is not None:
            assert out[i].reasoning == reason
        else:
            assert out[i].reasoning.startswith("Parse error: ")


def test_extract_json_response(spark):
    rows = [
        ('{"fields": [1]}', "whole"),
        ('text ```json\n{"a": 1}\n``` more', "json_fence"),
        ('text ```\n{"b": 2}\n```', "fence"),
        ('prose {"c": {"d": "}"}} tail', "braces"),
        ("nothing here", "default"),
        ('[1, 2]', "whole"),
    ]
    df = spark.createDataFrame(rows, "t string, want string")
    got = df.select("want", rp.extract_json_response(F.col("t")).alias("x")).collect()
    for r in got:
        assert r.x.source == r.want
        json.loads(r.x.json)


def test_balanced_json_scanner():
    f = rp.balanced_json_py
    assert f('x {"a": "}"} y') == '{"a": "}"}'
    assert f('{"a": "\\"}"} tail') == '{"a": "\\"}"}'
    assert f('pre {"a": {"b": 1}} {"c": 2}') == '{"a": {"b": 1}}'
    assert f('{"a": 1') is None
    assert f("") is None
    assert f('[1, {"a": 2}]') == '{"a": 2}'
    assert f('[1, {"a": 2}]', allow_array=True) == '[1, {"a": 2}]'


def test_balanced_json_udf(spark):
    df = spark.createDataFrame([('x {"a": "}"} y',), (None,)], "t string")
    got = [r.o for r in df.select(rp.balanced_json(F.col("t")).alias("o")).collect()]
    assert got == ['{"a": "}"}', None]


def test_normalize_answer(spark):
    rows = [("A", "A"), ("A.", "A"), ("b)", "B"), ("(C)", "C"), ("DON'T KNOW", "D"), (None, ""),
            ("  e  ", "E"), ("answer: b", "A"), ("my answer: b", "B"), ("xyz", ""), ("1 2 C", "C")]
    df = spark.createDataFrame(rows, "raw string, want string")
    for r in df.select("want", rp.normalize_answer(F.col("raw")).alias("got")).collect():
        assert r.got == r.want


def test_questionnaire_score(spark):
    truth = ["A", "B", "D", "A", "D", None, "C", "X", "E", "A"]
    good = json.dumps({f"q{i}": t for i, t in enumerate(["a)", "B", "A", "A.", "A", "A", "A", "A", "(E)", "B"], 1)})
    df = spark.createDataFrame([(1, *truth, good), (2, *truth, "[1]"), (3, *[None] * 10, good)],
                               "hid int, " + ", ".join(f"q{i}_gt string" for i in range(1, 11)) + ", ans string")
    out = {r.hid: r.score for r in rp.questionnaire_scores(df, [f"q{i}_gt" for i in range(1, 11)], "ans", "psid")
           .select("hid", "score").collect()}
    # psid: q3/q5 unknown letter D, others C.  missing: q3 (D), q5 (D), q6 (null), q7 (C), q8 (X) = 5
    # usable: q1 A=A ok, q2 B=B ok, q4 A=A ok, q9 E=E ok, q10 A!=B  -> 4 correct
    assert abs(out[1] - 0.9) < 1e-12
    assert abs(out[2] - 0.5) < 1e-12
    assert out[3] == 1.0


def test_parse_persona_response(spark):
    rows = [
        ('{"persona_name": "A", "behavior_patterns": ["x"], "decision_making_logic": [1]}', "A", False),
        ('Sure!\n```json\n{"persona_name": "B", "note": "say \\"}\\""}\n```', "B", False),
        ('prefix {"persona_name": "C"} suffix', "C", False),
        ('[{"persona_name": "D"}]', "Unnamed Group", True),
        ('{"persona_name": "E", "core', "Unnamed Group", True),
        ("", "Unnamed Group", True),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    out = {r.i: r for r in df.select("i", rp.parse_persona_response(F.col("t")).alias("p")).select("i", "p.*").collect()}
    for i, (text, name, err) in enumerate(rows):
        assert out[i].persona_name == name, text
        assert out[i].parse_error == err
    assert out[0].behavior_patterns == ["x"] and out[0].decision_making_logic == "{}"
    assert out[1].pain_points == [] and out[4].core_characteristics == rows[4][0][:200]
    assert out[1].extra == {"note": '"say \\"}\\""'} and out[2].extra == {} and set(out[4].extra) == {"behavioral_biases"}


def test_persona_record_keeps_open_keys_and_takes_the_given_statistics(spark):
    text = '{"persona_name": "A", "behavioral_biases": {"loss": [1, null]}, "mood": null, "n": 3.5, "statistics": {"made": "up"}, "behavioral_drivers": {"a": 1}}'
    df = spark.createDataFrame([(text, '{"n_samples": 7}')], "t string, s string")
    r = df.select(rp.parse_persona_response(F.col("t"), F.col("s")).alias("p")).first()["p"]
    assert r.extra == {"behavioral_biases": '{"loss":[1,null]}', "mood": "null", "n": "3.5"}
    assert r.statistics == '{"n_samples": 7}' and r.behavioral_drivers == '{"a":1}' and not r.parse_error


def test_balanced_json_reads_each_opener_from_itself_in_linear_time():
    import random
    import re
    import time
    from hearth.functions.responses import _balanced_from, balanced_json_py
    random.seed(1)
    for _ in range(20_000):
        text = "".join(random.choice('{}{}""\\a ') for _ in range(random.randint(1, 24)))
        each = (_balanced_from(text, m.start()) for m in re.finditer(r"\{", text))
        assert balanced_json_py(text) == next((x for x in each if x is not None), None), text
    began = time.time()
    assert balanced_json_py("{" * 100_000) is None and balanced_json_py('{"\\' * 100_000) is None
    assert time.time() - began < 10
