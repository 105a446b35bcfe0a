import numpy as np
from helpers import docs, read
from pyspark.sql import functions as F

from hearth.llm.toxicity import LabelModel, learn_toxicity, op3_toxicity, score_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op3_toxicity(spark, SF).toPandas()
    assert len(got) == len(read("documents", SF)) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    out = got[got.held_out].merge(read("labels", SF), on="doc_id")
    caught, wrong = out.predicted[out.toxic == 1].mean(), out.predicted[out.toxic == 0].mean()
    assert caught > 0.75 and wrong < 0.01


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.02)
    poor = np.where(y, rng.random(4000) < 0.3, rng.random(4000) < 0.15)
    noisy = np.where(rng.random(4000) < 0.1, ~y, y).astype(float)
    v = np.stack([good, poor, poor, poor, poor], axis=1).astype(float)
    m = LabelModel(v, noisy)
    assert m.weight[0] > 0.9 and m.weight[1] < 0.35
    assert abs(m.fires1[0] - 0.8) < 0.05 and ((m.posterior > 0.5) == y).mean() > ((noisy > 0.5) == y).mean() + 0.02


def test_edges(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("aeioubdlmnrst"), 5)) for _ in range(200)]
    talk = {i: " ".join(rng.choice(plain, 12)) for i in range(400)}
    bad = [(i, talk[i] + " nitwit " + talk[i + 1], "s") for i in range(0, 400, 4)]
    fine = [(i, talk[i] + " weather", "s") for i in range(400) if i % 4]
    # a group of copies teaches no more than one document
    bad += [(i, "copied again and again " + talk[3], "s") for i in range(1000, 1200, 4)]
    d = docs(spark, bad + fine).withColumn("y", F.lit("clash")).withColumn("t", F.lit(0))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(i, 1, 1) for i in range(1000, 1200, 4)] + [(None, 1, 1), (1, 1, None), (9999, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    scorer = learn_toxicity(d, labels)
    assert "nitwit" in scorer.voters and "copied" not in scorer.voters
    rows = [(1, None), (2, ""), (3, "A NITWIT!"), (3, "A NITWIT!"), (None, "fine weather"), (4, "weather " * 50_000 + "nitwit")]
    got = score_toxicity(docs(spark, rows).withColumn("score", F.lit(1)), scorer).collect()
    assert got[0]["score"] == got[1]["score"] < 0.1 and got[2] == got[3] and got[2]["score"] > 0.7 > got[4]["score"] and got[5]["score"] > 0.7
    assert score_toxicity(docs(spark, []), scorer).count() == 0
    none = learn_toxicity(d, labels.limit(0))
    assert {r["score"] for r in score_toxicity(docs(spark, rows), none).collect()} == {0.5}


def test_a_repeated_doc_id_counts_once(spark, monkeypatch):
    from hearth.llm import toxicity
    seen, scorer = [], toxicity.Scorer

    def spy(found, votes, y):
        seen.append(len(y))
        return scorer(found, votes, y)
    monkeypatch.setattr(toxicity, "Scorer", spy)
    told = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    rng = np.random.default_rng(3)
    own = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(400)]
    text = lambda: " ".join(rng.choice(own, 30))
    rows = [(0, text()) for _ in range(300)] + [(i, text()) for i in range(1, 12)]
    learn_toxicity(docs(spark, rows), told, remainder=3)
    assert seen[-1] == 12
