"""J4 for many personas: blocks and their bounds change nothing."""

import math

import numpy as np
from pyspark.sql import functions as F

from hearth.operators import refine as rf
from hearth.operators.refine import PersonaStats, PersonaTable, nearest_personas, reassign_noise


def brute(row, personas, current, k):
    out = []
    for i, p in enumerate(personas):
        if current >= 0 and p.persona_id == current:
            continue
        sq, numeric, mism, used = 0.0, False, 0, False
        for f, (m, s) in p.means.items():
            if m is None:
                continue
            numeric = True
            sd = s if s and s > 0 else 1.0
            sq += 0.0 if row.get(f) is None else ((row[f] - m) / sd) ** 2
        for f, mode in p.modes.items():
            if mode is not None and row.get(f) is not None:
                used, mism = True, mism + (row[f].strip() != mode.strip())
        if numeric or used:
            out.append((math.sqrt(sq) + 0.5 * mism, i, p.persona_id))
    return [(i, d) for d, _, i in sorted(out)[:k]]


def people(n, rng):
    return [PersonaStats(100 + i, {"x": (float(rng.integers(0, 40)), float(rng.integers(0, 3))), "y": (None if i % 17 == 0 else float(rng.normal()), 1.0),
                                   "gone": (1.0, 1.0)}, {"c": [None, "a", "b "][i % 3]}) for i in range(n)]


def test_many_personas_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rf, "PERSONA_BLOCK", 16)
    rng = np.random.default_rng(8)
    personas = people(300, rng)
    rows = [(i, 100 + i if i % 2 else -1, None if i % 5 == 0 else float(rng.integers(0, 40)), float(rng.normal()), ["a", "b", None][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "hid long, current long, x double, y double, c string")
    want = {r[0]: brute({"x": r[2], "y": r[3], "c": r[4]}, personas, r[1], 3) for r in rows}
    for shipped in (1 << 27, 100 * (16 * 2 + 64)):   # at once, and in three groups
        monkeypatch.setattr(rf, "PERSONA_BYTES", shipped)
        got = {r["hid"]: [(p["persona_id"], p["distance"]) for p in r["near"]] for r in nearest_personas(df, personas, 3, "current").collect()}
        for h, w in want.items():
            assert [i for i, _ in got[h]] == [i for i, _ in w] and np.allclose([d for _, d in got[h]], [d for _, d in w])


def test_ten_thousand_personas(spark):
    rng = np.random.default_rng(9)
    personas = people(10_000, rng)
    df = spark.range(2000).select(F.col("id").alias("hid"), (F.col("id") % 40).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit("a").alias("c"))
    got = nearest_personas(df, personas, 2).collect()
    assert len(got) == 2000 and all(len(r["near"]) == 2 and r["near"][0]["distance"] <= r["near"][1]["distance"] for r in got)
    assert [p["persona_id"] for p in got[7]["near"]] == [i for i, _ in brute({"x": 7.0, "y": 0.0, "c": "a"}, personas, -1, 2)]


def test_blocks_far_away_are_passed_over(monkeypatch):
    monkeypatch.setattr(rf, "PERSONA_BLOCK", 32)
    personas = [PersonaStats(i, {"x": (float(i), 1.0)}, {}) for i in range(3200)]
    table = PersonaTable(personas, ["x"], [])
    seen = []
    plain = table._distances
    table._distances = lambda block, *a: seen.append(len(block)) or plain(block, *a)
    ids, dist, _ = table.nearest(np.array([[5.2], [6.1]]), [], np.array([-1, -1]), 2)
    assert ids.tolist() == [[5, 6], [6, 7]] and np.allclose(dist, [[0.2, 0.8], [0.1, 0.9]]) and sum(seen) <= 64


def test_noise_without_candidate_stays(spark):
    df = spark.createDataFrame([(1, -1, 2.0), (2, 3, 5.0), (3, -1, None)], "hid long, cluster int, x double")
    got = {r["hid"]: r["cluster"] for r in reassign_noise(df, [PersonaStats(3, {"x": (0.0, 1.0)}, {}), PersonaStats(4, {"x": (2.0, 1.0)}, {})], {3: 3, 4: 9}).collect()}
    assert got == {1: 9, 2: 3, 3: 3}
    assert {r["cluster"] for r in reassign_noise(df, [], {}).collect()} == {-1, 3}
