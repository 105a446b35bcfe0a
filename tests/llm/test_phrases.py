import re
from collections import Counter, defaultdict

import numpy as np
from helpers import docs, read
from pyspark.sql import functions as F

from hearth.llm import phrases as module
from hearth.llm.phrases import Bits, mine_phrases, op12_phrase_mining

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, g in f.items():
        cand = {p: a for p, a in g.items() if len(p) > 1 and a >= min_count}
        held = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i:i + m]] = max(held[p[i:i + m]], a)
        got = []
        for p, a in cand.items():
            if 100 * held[p] >= 100 * a:
                continue
            s, _, l, r = min((1000 * a * n[lang] // (g[p[:k]] * g[p[k:]]), k, g[p[:k]], g[p[k:]]) for k in range(1, len(p)))
            got.append((-s, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(got)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_against_brute_force(spark):
    d = read("documents")
    rows = list(zip(d.text, [None if i % 9 == 0 else x for i, x in enumerate(d.lang)]))
    df = spark.createDataFrame(rows, "text string, lang string")
    # all that is frequent, and lists that are settled before the frontier holds every word
    for min_count, top in ((4, 2000), (5, 15), (12, 3)):
        assert result(mine_phrases(df, min_count, top, bits=1 << 18)) == brute(rows, min_count, top)


def test_crowded_bit_tables_cost_only_time(spark):
    d = read("documents").head(60)
    rows = list(zip(d.text, d.lang))
    df = spark.createDataFrame(rows, "text string, lang string")
    assert result(mine_phrases(df, 3, 12, bits=1 << 17)) == brute(rows, 3, 12)
    assert result(mine_phrases(df, 3, 12, bits=1 << 16)) == brute(rows, 3, 12)


def test_frontier_stops_when_settled(spark, monkeypatch):
    """Rare passages fill the list in the first round: common words are never grown."""
    rng = np.random.default_rng(3)
    passages = [f"p{i}a p{i}b p{i}c p{i}d p{i}e" for i in range(40)] * 6
    common = [" ".join(rng.choice(["the", "of", "and", "to"], 2000)) for _ in range(20)]
    rows = [(t, "en") for t in passages + common]
    rounds = []
    plain = module._spelled
    monkeypatch.setattr(module, "_spelled", lambda *a: rounds.append(1) or plain(*a))
    got = result(mine_phrases(spark.createDataFrame(rows, "text string, lang string"), 5, 10, bits=1 << 16))
    assert len(rounds) == 1 and got == brute(rows, 5, 10) and all(r[2].startswith("p") for r in got)


def test_registered_query(spark):
    got = op12_phrase_mining(spark, "/root/testdata/sf0.001")
    d = read("documents")
    assert result(got) == brute(list(zip(d.text, d.lang)), 100, 2000)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A b, a\tb! A  b\x0ba b"), (3, "A b, a\tb! A  b\x0ba b"), (None, "é ü é ü é ü"), (5, "x y " * 50_000), (6, "a \x1cb")]
    df = docs(spark, rows).withColumn("phrase", F.lit(1)).withColumn("lang", F.when(F.col("doc_id") == 3, None).otherwise("l"))
    plain = [(t, None if i == 3 else "l") for i, t in rows]
    assert result(mine_phrases(df, 2, 50, bits=1 << 16)) == brute(plain, 2, 50)
    assert mine_phrases(docs(spark, []), 2, 50, bits=1 << 16).count() == 0
    assert mine_phrases(df, 10 ** 6, bits=1 << 16).count() == 0


def test_bits(spark):
    keys = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 500)
    b = Bits(1 << 18).add_all(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert b.has(keys.view(np.uint64)).all()
    assert b.has(np.arange(100_000, dtype=np.uint64)).sum() <= 500
