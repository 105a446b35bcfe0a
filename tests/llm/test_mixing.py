from collections import Counter, defaultdict
from math import comb

import pytest
from helpers import SF, docs, read
from pyspark.sql import functions as F

from hearth.llm.mixing import hypergeometric, mix, mixed_rows, op1_mixing, source_targets, split_quotas


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in free})
            break
        target.update({s: most * sizes[s] for s in over})
        free -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 3, "c": 1000, None: 7}, {"a": 1, "b": 1, "c": 10_000}, {"x": 0, "y": 5}, {"x": 0}, {"only": 9}])
def test_targets_match_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df, (5, 2, 1), 3).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_query_takes_near_target_and_repeats(spark):
    d = read("documents")
    size = {i: len((t or "").encode().split()) for i, t in zip(d.doc_id, d.text)}
    by = defaultdict(int)
    for i, s in zip(d.doc_id, d.source):
        by[s] += size[i]
    want = brute_targets(by)
    got = op1_mixing(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(d.doc_id)
    got = got.merge(d[["doc_id", "source"]], on="doc_id")
    for s, g in got.groupby("source"):
        assert (g.target - want[s]).abs().max() < 1e-6 * want[s] and (g.source_size == by[s]).all()
        assert (g["size"] == g.doc_id.map(size)).all()
        assert abs(g.taken.sum() - want[s]) <= max(size[i] for i in g.doc_id) / 2 + 1
    assert (got.taken <= 3 * got["size"]).all() and (got.taken[got["size"] > 0] % got["size"][got["size"] > 0] == 0).all()
    again = op1_mixing(spark, SF).toPandas().set_index("doc_id")
    assert (again.taken == got.set_index("doc_id").taken.reindex(again.index)).all()


def test_hypergeometric_has_the_exact_law(spark):
    kind, draws, pool, n = 7, 6, 20, 20_000
    x = spark.range(n).select(hypergeometric(F.lit(kind).cast("long"), F.lit(draws).cast("long"), F.lit(pool).cast("long"), F.col("id") / n).alias("x"))
    got = {r["x"]: r["n"] / n for r in x.groupBy("x").agg(F.count("*").alias("n")).collect()}
    for k in range(7):
        assert abs(got.get(k, 0) - comb(kind, k) * comb(pool - kind, draws - k) / comb(pool, draws)) < 1e-3
    big = spark.range(5).select(hypergeometric(F.lit(30_000).cast("long"), F.lit(20_000).cast("long"), F.lit(60_000).cast("long"), (F.col("id") + 0.5) / 5).alias("x")).collect()
    assert all(9_800 < r["x"] < 10_200 for r in big)


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_splitting_tree_partitions_every_quota(spark, shards):
    quota = {0: 13, 1: 0, 2: 40, 3: 1}
    runs = split_quotas(spark.createDataFrame(list(quota.items()), "src int, slots long"), shards, 3).collect()
    seen, per = defaultdict(list), Counter()
    for r in runs:
        seen[r["src"]] += range(r["first"], r["first"] + r["slots"])
        per[r["shard"]] += r["slots"]
    assert all(sorted(seen[s]) == list(range(q)) for s, q in quota.items())
    assert max(per[j] for j in range(shards)) - min(per[j] for j in range(shards)) <= 1


def test_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (2, None, None), (3, "", "y"), (4, " \t", "y"), (5, "w " * 500, "x")]
    got = mix(docs(spark, rows), shards=3).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == [0, 0, 0, 2, 3, 3, 500]
    assert all(len(r["placements"]) <= 3 and all(0 <= p["shard"] < 3 for p in r["placements"]) for r in got)
    assert mix(docs(spark, [])).count() == 0 and mixed_rows(docs(spark, [])).count() == 0
    assert mix(docs(spark, [(1, None), (2, "")])).agg(F.sum("target")).first()[0] == 0
    clash = docs(spark, rows).withColumn("size", F.lit("s")).withColumn("mix_r", F.lit(1)).withColumn("shard", F.lit(2))
    out = mix(clash, shards=2)
    assert {"mix_r", "shard", "placements"} <= set(out.columns) and out.count() == len(rows)
    assert mixed_rows(clash).columns == clash.columns


def test_large_partial_block_is_filled_by_sub_blocks(spark):
    many = spark.range(9000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 9))").alias("text"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("source"))
    got = mix(many, shards=4, block_words=10 ** 9).select("source", "target", (F.size("placements") * F.col("size")).alias("taken"))
    for r in got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r["target"] - r["taken"]) <= 1


def _taken(got):
    rows = got.select("source", "target", (F.size("placements") * F.col("size")).alias("taken")).groupBy("source")
    return {r["source"]: (r["target"], r["taken"]) for r in rows.agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}


@pytest.mark.parametrize("doc_id", ["null", "7", "id"])
def test_targets_are_met_with_null_and_repeated_ids(spark, doc_id):
    """Different texts are different documents, whatever their ids."""
    many = spark.range(3000).select(F.expr(f"cast({doc_id} as long)").alias("doc_id"), F.expr("concat('a b c w', id)").alias("text"),
                                    F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    for target, taken in _taken(mix(many, shards=4)).values():
        assert abs(target - taken) <= 4


def test_of_equal_rows_so_many_are_taken_as_fit(spark):
    """One text is most of a source: a part of its copies is taken, each at most three times."""
    hot = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x y z").alias("text"), F.lit("b").alias("source"))
    rest = spark.range(1000).select((F.col("id") + 10).alias("doc_id"), F.expr("concat('q r w', id)").alias("text"),
                                    F.when(F.col("id") < 300, "b").otherwise("a").alias("source"))
    docs_ = hot.unionByName(rest).repartition(5)
    got = mix(docs_, shards=3).cache()
    assert got.count() == 3000 and got.agg(F.max(F.size("placements"))).first()[0] <= 3
    for target, taken in _taken(got).values():
        assert abs(target - taken) <= 2
    copies = {r["n"] for r in got.where("doc_id = 5").select(F.size("placements").alias("n")).distinct().collect()}
    assert len(copies) == 2
    assert _taken(mix(docs_.repartition(3), shards=3)) == _taken(got)


def test_very_long_text(spark):
    rows = [(1, "w " * 400_000, "a"), *[(i, "u v", "a") for i in range(2, 40)], (99, "z", "b")]
    for target, taken in _taken(mix(docs(spark, rows), shards=2)).values():
        assert abs(target - taken) <= 200_001
