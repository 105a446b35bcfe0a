import numpy as np
from helpers import docs, read
from pyspark.sql import functions as F

from hearth.llm.quality import keep_quality, learn_quality, op9_quality, score_quality

SF = "/root/testdata/sf0.01"


def auc(score, y):
    a, b = score[y == 1], score[y == 0]
    return (a[:, None] > b[None]).mean() + (a[:, None] == b[None]).mean() / 2


def test_held_out_accuracy(spark):
    got = op9_quality(spark, SF).toPandas()
    assert len(got) == len(read("documents", SF)) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    out = got[got.held_out].merge(read("labels", SF), on="doc_id")
    assert auc(out.score.to_numpy(), out.quality.to_numpy()) > 0.95 and (out.predicted == out.quality).mean() > 0.93


def test_edges(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ranker = learn_quality(d.withColumn("y", F.lit("clash")), labels.withColumn("text", F.lit("clash")))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "One line of text."), (4, "a"), (4, "a"), (5, "word " * 60_000)]
    got = score_quality(docs(spark, rows).withColumn("score", F.lit(1)), ranker).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"] == got[2]["score"] and got[4] == got[5]
    assert score_quality(docs(spark, []), ranker).count() == 0 and keep_quality(docs(spark, []), ranker).count() == 0
    kept = keep_quality(docs(spark, rows).withColumn("score", F.lit(1)), ranker)
    assert {"score", "n_chars"} <= set(kept.columns) and kept.count() == sum(r["score"] >= 0.5 for r in got)
    none = learn_quality(d, labels.limit(0))
    assert {r["score"] for r in score_quality(docs(spark, rows), none).collect()} == {0.5}
    one = learn_quality(d, labels.withColumn("quality", F.lit(1)))
    assert np.all(one.score(np.zeros((2, 14))) == 0.5)


def test_a_repeated_doc_id_counts_once(spark, monkeypatch):
    from hearth.llm import quality
    seen = []
    monkeypatch.setattr(quality, "Ranker", lambda x, y: seen.append((x, y)))
    told = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    once = [(i, f"a text of its own {'word ' * i}") for i in range(1, 12)]
    for rows in ([(0, f"copy {'x ' * (n % 40)}") for n in range(300)], [(0, f"copy {'x ' * (n % 40)}") for n in range(299, -1, -1)]):
        learn_quality(docs(spark, rows + once), told, remainder=3)
    assert [len(x) for x, _ in seen] == [12, 12] and sum(seen[0][1]) == 6
    assert np.array_equal(seen[0][0], seen[1][0])
