from collections import Counter

from helpers import SF, docs, read
from pyspark.sql import functions as F
from test_simhash import brute_components, brute_fingerprint

import __spark_entry__ as entry
import corpus_pipeline


def shingles(text, k=5):
    w = (text or "").lower().encode().split()
    return {b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} or ({b" ".join(w)} if w else set())


def test_stages_take_effect(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, SF).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        kept[name] = d.toPandas()
        if name != "shards":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before = kept["quality"]
    part = brute_components(list(before.doc_id), [brute_fingerprint(t) for t in before.text])
    assert sorted(kept["near_duplicates"].doc_id) == sorted(set(part.values()))

    items = [shingles(t) for t in read("benchmark").text]
    clean = [i for i, t in zip(kept["near_duplicates"].doc_id, kept["near_duplicates"].text)
             if not any(s and len(s & shingles(t)) >= 0.8 * len(s) - 1e-9 for s in items)]
    assert sorted(kept["benchmark"].doc_id) == sorted(clean)

    times = Counter(kept["mixture"].doc_id)
    assert set(times) <= set(clean) and max(times.values()) <= 3
    out = kept["shards"]
    assert Counter(out.doc_id) == times
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard")) and out.shard.between(0, 39).all()


def test_run_and_registration(spark):
    q = entry.queries()
    assert q["pipeline"] is corpus_pipeline.run and [k for k in q if k.startswith("op")].__len__() == 13
    assert "pipeline" not in entry.oracle_sql()
    assert {"doc_id", "text", "size", "shard", "slot"} <= set(corpus_pipeline.run(spark, SF).columns)


def test_stages_stand_nulls_empty_tables_and_clashing_columns(spark):
    odd = docs(spark, [(1, None), (None, "One line of text that is long enough, and plain."), (2, ""), (2, ""), (3, "word " * 40_000)]).withColumns(
        {c: F.lit(1) for c in ("size", "shard", "score", "text_hash", "h", "g", "placement", "target")})
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, SF)
            assert set(df.columns) <= set(out.columns), name
            assert out.count() <= 3 * df.count()
