import numpy as np
import pytest
import xxhash
from helpers import SF, docs, read

from hearth.llm.components import components
from hearth.llm.simhash import choose_plan, fingerprint, keep_one, near_duplicates, near_links, op2_simhash_near_dedup


def brute_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(k, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, d in enumerate(ids)}


def test_query_matches_brute_force(spark):
    d = read("documents")
    want_fp = {i: brute_fingerprint(t) for i, t in zip(d.doc_id, d.text)}
    want = brute_components(list(want_fp), list(want_fp.values()))
    for r in op2_simhash_near_dedup(spark, SF).collect():
        assert r["fingerprint"] == f"{want_fp[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("bucket_rows", [20000, 40])
def test_links_in_dense_and_crowded_buckets(spark, bucket_rows):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2 ** 63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:  # chains and clouds around each centre
        x = int(c)
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
        fps |= {int(c) ^ (1 << int(b)) for b in rng.choice(64, 10, replace=False)}
    fps = sorted(fps)
    want = brute_components(fps, fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    links = near_links(df, 4, bucket_rows=bucket_rows)
    star = {r["node"] % 2 ** 64: r["root"] % 2 ** 64 for r in components(links).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(star.get(x, x), set()).add(x)
    expected = {}
    for x in fps:
        expected.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("n", [10, 10 ** 5, 10 ** 7, 10 ** 9])
def test_plan_keeps_the_pigeonhole(n):
    rng = np.random.default_rng(2)
    together = np.full((64, 64), n / 4.0)
    np.fill_diagonal(together, n / 2.0)
    plan = choose_plan(n, together, rng.integers(0, 2 ** 63, 300, dtype=np.uint64), 4)
    assert sum(t + 1 for _, t in plan) == 5
    masks = [m for m, _ in plan]
    assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
    if n >= 10 ** 9:
        assert min(bin(m).count("1") for m in masks) > 16  # wider groups as the corpus grows


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text.upper()), (3, text), (3, text), (9, None), (8, ""), (7, " \t\n"), (None, text), (None, "lonely words here now"), (11, "x" * 200_000)]
    got = near_duplicates(docs(spark, rows).drop("n_chars")).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    fp = fingerprint(text)
    signed = fp - 2 ** 64 if fp >= 2 ** 63 else fp
    assert by[5, signed] == 3 and by[3, signed] == 3 and by[None, signed] == 3
    assert by[9, 0] == by[8, 0] == by[7, 0] == 7 and by[None, [k for d, k in by if d is None and k != signed][0]] is None
    kept = keep_one(docs(spark, rows).selectExpr("*", "1 AS text_hash", "2 AS fp"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["11", "3", "7", "None"]
    assert set(kept.columns) >= {"text_hash", "fp", "n_chars"}
    assert near_duplicates(docs(spark, [])).count() == 0 and keep_one(docs(spark, [])).count() == 0
