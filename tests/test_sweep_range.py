"""The fits of a sweep advance together and equal separate ones; the registered sweeps try every k
from 2 to 15 that the distinct rows allow."""


import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import kprototypes as kp
from hearth.operators import kselect as ks
from hearth.plans import k_sweep as sweep
from hearth.plans.registry import QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), "abc"[i % 3], "uvwx"[int(z)]) for i, (x, y, z) in enumerate(
        zip(rng.normal(np.arange(400) % 5 * 4, 0.6), rng.normal(np.arange(400) % 2 * 3, 0.6), rng.integers(0, 4, 400)))]
    return spark.createDataFrame(rows, "hid long, x double, y double, a string, b string").cache()


@pytest.fixture(params=["one task", "many tasks"])
def path(request, monkeypatch):
    if request.param == "many tasks":
        monkeypatch.setattr(kp, "TASK_ROWS", 0)
    return request.param


def test_one_task_and_many_agree(blobs, monkeypatch):
    small = kp.fit_many(blobs, ["x", "y"], ["a", "b"], [3, 6], n_init=4)
    monkeypatch.setattr(kp, "TASK_ROWS", 0)
    spread = kp.fit_many(blobs, ["x", "y"], ["a", "b"], [3, 6], n_init=4)
    for k in (3, 6):
        assert (small[k].restart, small[k].n_iter) == (spread[k].restart, spread[k].n_iter)
        assert small[k].cost == pytest.approx(spread[k].cost) and np.allclose(small[k].centroids.num, spread[k].centroids.num)
        assert small[k].centroids.cat == spread[k].centroids.cat


def test_fields_of_many_levels_are_compared_by_code(blobs, monkeypatch):
    want = kp.fit(blobs, ["x"], ["a", "b"], 4, n_init=2)
    monkeypatch.setattr(kp.Assigner, "DENSE_LEVELS", 3)
    got = kp.fit(blobs, ["x"], ["a", "b"], 4, n_init=2)
    assert got.cost == pytest.approx(want.cost) and got.centroids.cat == want.centroids.cat


def test_sweep_equals_separate_fits(blobs, path):
    together = kp.fit_many(blobs, ["x", "y"], ["a", "b"], [2, 3, 5, 8], n_init=3)
    for k, got in together.items():
        alone = kp.fit(blobs, ["x", "y"], ["a", "b"], k, n_init=3)
        assert (got.cost, got.restart, got.n_iter) == pytest.approx((alone.cost, alone.restart, alone.n_iter))
        assert got.centroids.cat == alone.centroids.cat and np.allclose(got.centroids.num, alone.centroids.num)
        # the cost is that of the rows' nearest centres
        assert kp.assign(blobs, ["x", "y"], ["a", "b"], got.centroids).agg(F.sum("dist")).first()[0] == pytest.approx(got.cost)


def test_starts_of_a_longer_chain_hold_those_of_a_shorter(blobs):
    long, short = (kp.cao_init(blobs, ["x", "y"], ["a", "b"], k) for k in (9, 4))
    assert (long.num[:4], long.cat[:4]) == (short.num, short.cat)
    many = kp.random_inits(blobs, ["x", "y"], ["a", "b"], 9, [3, 4])
    assert many[4].num[:5] == kp.random_init(blobs, ["x", "y"], ["a", "b"], 5, 4).num
    by_hash = blobs.orderBy(F.md5(F.concat_ws(":", F.lit("4"), F.col("hid").cast("string")))).limit(9).collect()
    assert many[4].num == [[r["x"], r["y"]] for r in by_hash]


def test_one_job_per_round(spark, blobs, monkeypatch):
    """However many models there are, a round reads the rows once."""
    passes = []
    monkeypatch.setattr(kp, "TASK_ROWS", 0)
    plain = kp.one_pass
    monkeypatch.setattr(kp, "one_pass", lambda *a: passes.append(len(a[3])) or plain(*a))
    fits = kp.fit_many(blobs, ["x", "y"], ["a"], range(2, 16), n_init=4)
    assert passes[0] == 14 * 4 and len(passes) <= 1 + max(r["iteration"] for f in fits.values() for r in f.history)


def test_indices_equal_the_single_operators(blobs):
    got = {r["k"]: r for r in sweep.k_sweep(blobs, ["x", "y"], ["a"], 2, 6, n_init=2, metric_sample=150).collect()}
    fits = kp.fit_many(blobs, ["x", "y"], ["a"], range(2, 7), n_init=2)
    for k, f in fits.items():
        lab = blobs.join(kp.assign(blobs, ["x", "y"], ["a"], f.centroids).select("hid", "cluster"), "hid")
        sizes = sorted(r["count"] for r in lab.groupBy("cluster").count().collect())
        assert got[k]["imbalance"] == sizes[-1] / sizes[0] and got[k]["min_frac"] == sizes[0] / 400
        assert got[k]["calinski_harabasz"] == pytest.approx(ks.calinski_harabasz(lab, ["x", "y"]).first()["calinski_harabasz"])
        assert got[k]["davies_bouldin"] == pytest.approx(ks.davies_bouldin(lab, ["x", "y"]).first()["davies_bouldin"])
        assert got[k]["silhouette"] == pytest.approx(ks.silhouette(lab, ["x", "y"], sample_size=150).first()["silhouette"])


def test_registered_sweeps(spark):
    modes = QUERIES["k_sweep_kmodes"](spark, SF).orderBy("k").toPandas()
    assert modes.k.tolist() == list(range(2, modes.k.max() + 1)) and 6 < modes.k.max() <= 15 and (modes.cost >= 0).all()
    mixed = QUERIES["k_sweep_fit"](spark, SF).toPandas()
    assert sorted(mixed.k) == list(range(2, 16)) and mixed.chosen.sum() == 1
    assert mixed[["silhouette", "calinski_harabasz", "davies_bouldin"]].notna().all().all()


@pytest.mark.parametrize("levels, last", [((2, 3), 6), ((4, 5), 15)])
def test_kmodes_sweep_ends_at_15_or_the_distinct_rows(spark, levels, last):
    a, b = levels
    f = spark.createDataFrame([(i, str(i % a), str(i % b)) for i in range(60)], "hid long, a string, b string")
    got = sweep.kmodes_sweep(f, ["a", "b"]).orderBy("k").collect()
    assert [r["k"] for r in got] == list(range(2, last + 1))


def test_rounds_read_blocks_encoded_once_and_rows_without_numerics_as_counts(spark):
    df = spark.range(0, 40_000, 1, 4).select(F.col("id").alias("hid"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")).alias("a"),
                                             (F.col("id") % 3).cast("string").alias("b"), (F.col("id") % 7).cast("double").alias("x"))
    packed = kp.pack(df, [], ["a", "b"])
    blocks = [pickle.loads(r["block"]) for r in packed.collect()]
    assert len(blocks) == 4 and all(len(w) == 15 for _, _, w in blocks) and sum(w.sum() for _, _, w in blocks) == 40_000
    cents = {(2, 0): kp.Centroids([[1.0], [5.0]], [[None, "1"], ["2", "2"]])}
    for num in ([], ["x"]):
        c = {m: kp.Centroids(v.num if num else [], v.cat) for m, v in cents.items()}
        (sums, modes), = kp.one_pass(kp.pack(df, num, ["a", "b"]), num, ["a", "b"], c, 0.5).values()
        near = kp.assign(df, num, ["a", "b"], c[2, 0])
        plain = {r["cluster"]: r for r in near.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("dist").alias("d")).collect()}
        top = {r["cluster"]: r for r in kp.update_centroids(near.join(df, "hid"), num, ["a", "b"]).collect()}
        for j in (0, 1):
            assert sums[j][0] == plain[j]["n"] and sums[j][1] == pytest.approx(plain[j]["d"])
            assert modes[j] == [top[j]["c0"], top[j]["c1"]]
            assert not num or sums[j][2] / sums[j][0] == pytest.approx(top[j]["n0"])
