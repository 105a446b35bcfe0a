import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from helpers import SF, docs, read
from pyspark.sql import functions as F

from hearth.llm import lmscore
from hearth.llm.lmscore import fill, level_of, op11_lm_scoring, read_levels, score, steps, train


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def floor_level(c):
    return int(steps()[level_of(np.array([c]))[0] - 1])


def brute(learn, texts):
    """The model with dictionaries instead of a filter."""
    uni, bi, after = Counter(), Counter(), defaultdict(set)
    for t in learn:
        ws = tokens(t)
        uni.update(ws)
        for h, w in zip(["", *ws], ws):
            bi[h, w] += 1
            after[h].add(w)
    n, v, out = sum(uni.values()), len(uni), []
    for t in texts:
        ws, base, full = tokens(t), 0.0, 0.0
        for h, w in zip(["", *ws], ws):
            p1 = (uni[w] + 1) / (n + v + 1)
            ch = len(learn) if h == "" else uni[h]
            base += math.log10(p1)
            if ch:
                d = floor_level(bi[h, w]) if bi[h, w] else 0
                full += math.log10((d + floor_level(len(after[h])) * p1) / (ch + floor_level(len(after[h]))))
            else:
                full += math.log10(p1)
        out.append((len(ws), sum(uni[w] > 0 for w in ws), base, full))
    return n, out


def test_against_dictionaries(spark):
    d = read("documents")
    got = op11_lm_scoring(spark, SF).toPandas().set_index("doc_id").loc[d.doc_id]
    out = np.array([crc32(str(i).encode()) % 7 == 2 for i in d.doc_id])
    assert (got.held_out.values == out).all()
    n, want = brute(list(d.text[~out]), list(d.text))
    assert (got.train_tokens == n).all()
    assert (got.n_tokens.values == [w[0] for w in want]).all() and (got.n_known.values == [w[1] for w in want]).all()
    assert np.allclose(got.base_score, [w[2] for w in want], rtol=1e-11)
    exact = np.array([w[3] for w in want])
    assert np.allclose(got.score, exact, rtol=0.01, atol=0.5)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_many_groups_give_the_same(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    # small parts: the commonest words are dealt out bigram by bigram
    model = train(d, part_tokens=400)
    assert len(model.hot) and len(model.sizes) > 5
    one = score(d, model).toPandas().sort_values("doc_id")
    few = score(d, model, broadcast_bytes=40_000).toPandas().sort_values("doc_id")
    assert len(lmscore._groups(model.sizes, 40_000)) > 1 and model.distinct * 16 > 40_000
    assert np.allclose(one.iloc[:, 1:], few.iloc[:, 1:], rtol=1e-11)
    whole = score(d, train(d)).toPandas().sort_values("doc_id")
    assert np.allclose(one.score, whole.score, rtol=0.01, atol=0.5)


def test_levels_read_back():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = np.minimum(rng.zipf(1.5, len(keys)), 10 ** 9)
    bits, size = fill(keys, level_of(counts))
    flat = np.frombuffer(bits, np.uint8)

    def ask(k):
        return read_levels(flat, np.zeros(len(k), np.int64), np.full(len(k), size, np.uint64), k)
    got, want = ask(keys), level_of(counts)
    assert (got >= want).all() and (got > want).mean() < 0.01
    assert (ask(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.01
    assert (np.diff(steps()) > 0).all() and steps()[:5].tolist() == [1, 2, 3, 4, 5]


def test_probabilities_sum_to_one_at_most(spark):
    learn = ["a b a c", "a b", "b c c c d", None, ""]
    model = train(docs(spark, list(enumerate(learn))))
    words = ["a", "b", "c", "d"]
    # log10 P(text) for all texts of at most 3 words, plus the unknown word
    texts = [" ".join(t) for t in [[]] + [[x] for x in [*words, "zz"]] + [[x, y] for x in [*words, "zz"] for y in [*words, "zz"]]]
    got = score(docs(spark, list(enumerate(texts))), model).collect()
    assert sum(10 ** r["score"] for r in got) <= 1 + 1e-9
    assert all(r["n_tokens"] == len(t.split()) + 1 for r, t in zip(got, texts))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A a"), (3, "A a"), (None, "a \x0b b"), (4, "word " * 100_000), (5, "é" * 200_000)]
    d = docs(spark, rows).withColumn("score", F.lit("x")).withColumn("w", F.lit(1))
    got = score(d, train(d)).toPandas()
    n, want = brute([t for _, t in rows], [t for _, t in rows])
    assert n == 1 + 1 + 3 + 3 + 3 + 100_001 + 2 and len(got) == 7
    order = ["n_tokens", "n_known", "base_score"]
    got, want = got.sort_values(order), sorted(want)
    assert np.allclose(got[[*order, "score"]], want, rtol=1e-4)
    none = docs(spark, [])
    assert score(none, train(d)).count() == 0
    blank = score(d, train(none)).toPandas()
    assert (blank.score == 0).all() and (blank.base_score == 0).all() and (blank.n_known == 0).all()
