"""Executors need not have the package on their path."""

import pickle

from pyspark.sql import functions as F

from hearth.operators import refine as rf


def test_broadcast_personas_need_no_package(spark, monkeypatch):
    sent = []
    real = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: (sent.append(value), real(sc, value))[1])
    personas = [rf.PersonaStats(i, {"x": (float(i), 1.0)}, {"c": str(i)}) for i in range(3)]
    df = spark.range(4).select(F.col("id").alias("hid"), F.col("id").cast("double").alias("x"), F.col("id").cast("string").alias("c"))
    near = {r["hid"]: r["near"][0]["persona_id"] for r in rf.nearest_personas(df, personas, 1).collect()}
    assert near == {0: 0, 1: 1, 2: 2, 3: 2}
    assert sent and all(b"hearth" not in pickle.dumps(v) for v in sent)
