import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from helpers import docs, read
from pyspark.sql import functions as F

from hearth.llm.divergence import divergence, op13_source_divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, min_docs, top):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        df[lang].update(set(w))
        n[lang, source].update(w)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, c in df[lang].items() if c >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // total for t in kept}
        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def test_against_brute_force(spark):
    d = read("documents")
    rows = [(t, None if i % 11 == 0 else lang, None if i % 7 == 0 else s) for i, (t, lang, s) in enumerate(zip(d.text, d.lang, d.source))]
    assert result(divergence(frame(spark, rows), 3, 10)) == brute(rows, 3, 10)


def test_buckets_and_row_blocks_change_nothing(spark):
    rng = np.random.default_rng(7)
    words = [f"{c}{d}" for c in "abcdefgh" for d in "éxyzüo"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30), p=np.arange(48, 0, -1) / 1176)), rng.choice(["de", "en"]), f"s{rng.zipf(1.4) % 60}") for _ in range(700)]
    want = brute(rows, 5, 4)
    assert result(divergence(frame(spark, rows), 5, 4, bucket_rows=50, row_block=7)) == want
    assert result(divergence(frame(spark, rows), 5, 4)) == want


def test_registered_query(spark):
    d = read("documents")
    assert result(op13_source_divergence(spark, "/root/testdata/sf0.001")) == brute(list(zip(d.text, d.lang, d.source)), 30, 50)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "Été b-B 3c", "a"), (3, "Été b-B 3c", "a"), (None, "c É", "b"), (4, "word " * 60_000, "b"), (5, "[]{}@`~", "empty")]
    df = docs(spark, rows).withColumn("term", F.lit(1)).withColumn("value", F.lit("x"))
    plain = [(t, "en", s) for _, t, s in rows]
    assert result(divergence(df, 2, 5)) == brute(plain, 2, 5)
    # nothing kept: pairs of value 0, in order of their names
    none = divergence(df, 100, 5).toPandas()
    assert (none["part"] == "pair").all() and (none.value == 0).all() and len(none) == 4 * 3
    assert divergence(docs(spark, []), 1, 5).count() == 0
    assert isinstance(pd.DataFrame(result(divergence(docs(spark, [(1, "one", "only")]), 1, 5))), pd.DataFrame)
