"""Iterative refinement as table operations.

State lives in tables keyed by ``hid``:
  household_state(hid, cluster, status, initial_cluster, initial_persona,
                  last_valid_cluster, last_valid_persona)
  evaluated(hid, persona_id)
  persona_state(persona_id, cluster_id, name, fit_score, num_assigned)
``status`` is one of validated / problem / pending / unseen, so the
reference's disjoint id sets become one column.  Persona statistics are
bounded by (personas x fields) and are turned into column literals;
household-scale work is joins, windows and narrow projections.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.stats import collect_bounded

# Refinement defaults
ALPHA = 0.2
FIT_THRESHOLD = 0.6
DIRECT_OUTLIER_FIT = 0.30
MIN_PROBLEM_RATE = 0.05
COVERAGE_TARGET = 0.85
INFERRED_PER_SEED = 5
RANDOM_STATE = 42
ABSOLUTE_MAX = 2000
DEFAULT_CAP = 50  # fixed value: households sampled of a cluster without a cap
MAX_PERSONAS_COLLECTED = 100_000
MAX_SEEDS = 200_000

VALIDATED, PROBLEM, PENDING, UNSEEN = "validated", "problem", "pending", "unseen"


# ---------------------------------------------------------------- sampling

def adaptive_epsilon(total: Column) -> Column:
    """Total >= 1000 -> .05, >= 100 -> .10, else .20."""
    return F.when(total >= 1000, 0.05).when(total >= 100, 0.10).otherwise(0.20)


def adaptive_sample_sizes(sizes: DataFrame, epsilon: Column | float | None = None, delta: float = 0.05,
                          min_per_cluster: int = 3, floor: float = 0.01, ceiling: float = 0.20,
                          absolute_max: int = ABSOLUTE_MAX) -> DataFrame:
    """W15 over ``sizes(cluster, n)`` (one row per cluster).  The body of the
    reference wins over its docstring: max(fpc + diversity, proportional),
    capped at 20 % of N, then clamped to [3, N] and 2000."""
    allw = Window.partitionBy()
    s = sizes.withColumn("_k", F.count(F.lit(1)).over(allw)).withColumn("_total", F.sum("n").over(allw))
    eps = adaptive_epsilon(F.col("_total")) if epsilon is None else (
        epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon)))
    eps = F.greatest(F.lit(1e-6), eps)
    a = F.lit(max(1e-12, delta)) / F.col("_k")
    z = F.when(a >= 0.025, 1.96).when(a >= 0.005, 2.576).when(a >= 0.001, 3.0).otherwise(3.5)
    n0 = z * z / (4 * eps * eps)
    ni = F.greatest(F.lit(1), F.col("n")).cast("double")
    fpc = n0 / (1.0 + (n0 - 1.0) / ni)
    div = 10.0 * F.log(F.greatest(F.lit(1.0), ni))
    rate = F.greatest(F.lit(floor), F.least(F.lit(ceiling), 1.5 / F.sqrt(ni)))
    cand = F.least(F.greatest(fpc + div, ni * rate), ni * ceiling)
    final = F.ceil(cand)
    cap = F.when(ni <= min_per_cluster, ni).otherwise(
        F.least(F.least(F.greatest(F.lit(min_per_cluster), final), ni), F.lit(absolute_max)))
    return s.select("cluster", "n", eps.alias("epsilon"), cap.cast("long").alias("cap"))


def sample_key(seed: Column | int | str, hid: Column) -> Column:
    """Portable pseudo-random order: md5('<seed>:<hid>') (same rows in any engine)."""
    sd = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", sd.cast("string"), hid.cast("string")))


def per_cluster_sample(df: DataFrame, n: int | None = 50, seed: int = 42, label: str = "cluster",
                       id_col: str = "hid") -> DataFrame:
    """At most ``n`` households per cluster (``n`` <= 0 or None = all).
    ``row_number() <= literal`` lets Spark cut each group map-side
    (window group limit) before the shuffle, so a huge cluster ships only n
    rows per input partition."""
    if not n or n <= 0:
        return df
    w = Window.partitionBy(label).orderBy(sample_key(seed, F.col(id_col)), F.col(id_col))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def iteration_seed(cluster: Column, iteration: int, random_state: int = RANDOM_STATE) -> Column:
    return (F.lit(random_state * 1000003 + iteration * 1009) + cluster.cast("long")) % F.lit(2 ** 32 - 1)


def capped_cluster_sample(need: DataFrame, caps: DataFrame, iteration: int, label: str = "cluster",
                          id_col: str = "hid", default_cap: int = DEFAULT_CAP) -> DataFrame:
    """Per cluster at most ``cap`` of the households needing validation,
    seeded by (random_state, iteration, cluster); a cap of 0 or less takes all,
    a cluster without a cap row gets ``default_cap``.  Adds ``sampled_down``
    (the cluster had more candidates than its cap).  Where every cap is
    positive, ranks beyond the largest are cut before the shuffle."""
    c = caps.select(F.col("cluster").alias(label), "cap")
    bounds = caps.agg(F.max("cap").alias("hi"), F.min("cap").alias("lo")).first()
    w = Window.partitionBy(label).orderBy(sample_key(iteration_seed(F.col(label), iteration), F.col(id_col)),
                                          F.col(id_col))
    ranked = need.withColumn("_r", F.row_number().over(w))
    if bounds["lo"] is None or bounds["lo"] > 0:
        ranked = ranked.where(F.col("_r") <= max(bounds["hi"] or 0, default_cap))
    cnt = need.groupBy(label).agg(F.count(F.lit(1)).alias("_need"))
    out = ranked.join(c, label, "left").join(cnt, label, "left").withColumn("cap", F.coalesce("cap", F.lit(default_cap)))
    return out.where((F.col("cap") <= 0) | (F.col("_r") <= F.col("cap"))) \
        .withColumn("sampled_down", (F.col("cap") > 0) & (F.col("cap") < F.col("_need"))) \
        .drop("_r", "_need", "cap")


def cap_outliers(outliers: DataFrame, cap: int, iteration: int, id_col: str = "hid") -> DataFrame:
    """Over the cap keep current-iteration outliers first (sampled if
    more than the cap), then sampled older ones.  ``orderBy().limit(cap)`` is a
    top-k per partition merged on one task (at most cap x partitions rows)."""
    key = sample_key(iteration, F.col(id_col))
    return outliers.orderBy(F.col("is_current").desc(), key, F.col(id_col)).limit(cap)


def need_validation(members: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Cluster members not yet evaluated for their persona."""
    return members.join(evaluated.select("hid", "persona_id"), ["hid", "persona_id"], "left_anti")


# ---------------------------------------------------------------- personas

@dataclass
class PersonaStats:
    persona_id: int
    means: dict[str, tuple[float | None, float | None]]  # field -> (mean, std)
    modes: dict[str, str | None]


def persona_stats_from_profiles(profiles: DataFrame, cluster_col: str = "cluster_id") -> list[PersonaStats]:
    """Statistics per persona from a wide A10 profile (persona id = cluster id).
    Bounded by personas x fields."""
    rows = collect_bounded(profiles.orderBy(cluster_col), MAX_PERSONAS_COLLECTED, "persona statistics")
    out = []
    for r in rows:
        d = r.asDict()
        means, modes = {}, {}
        for k, v in d.items():
            if k.endswith("_mean"):
                b = k[:-5]
                if b not in ("cluster_id", "n_samples", "percentage"):
                    means[b] = (v, d.get(f"{b}_std"))
            elif k.endswith("_mode"):
                b = k[:-5]
                if b not in ("cluster_id", "n_samples", "percentage"):
                    modes[b] = None if v is None else str(v)
        out.append(PersonaStats(int(d[cluster_col]), means, modes))
    return out


def _num(c: Column) -> Column:
    return c.try_cast("double")


PERSONA_BLOCK = 512            # personas whose distances are worked out together
PERSONA_BYTES = 128 << 20      # statistics shipped to the tasks at once


class PersonaTable:
    """Statistics of many personas as arrays in blocks of similar personas, for J4.

    A block knows the range of its means and its widest spread per field, so a household
    has a lower bound of its distance to every persona of the block; blocks whose bound
    is above the ``k``-th best distance so far are passed over."""

    def __init__(self, personas: Sequence[PersonaStats], num: Sequence[str], cat: Sequence[str], first: int = 0):
        def value(v):
            return float(v) if v is not None and math.isfinite(float(v)) else math.nan
        lower = [{f.lower(): v for f, v in p.means.items()} for p in personas]
        modes = [{f.lower(): v for f, v in p.modes.items()} for p in personas]
        self.ids = np.array([p.persona_id for p in personas], dtype=np.int64)
        self.ord = np.arange(first, first + len(personas))
        mean = np.array([[value(d.get(f.lower(), (None, None))[0]) for f in num] for d in lower], dtype=float).reshape(len(personas), len(num))
        sd = np.array([[value(d.get(f.lower(), (None, None))[1]) for f in num] for d in lower], dtype=float).reshape(len(personas), len(num))
        self.there = ~np.isnan(mean)
        self.mean, self.sd = np.where(self.there, mean, 0.0), np.where(np.isnan(sd) | (sd <= 0), 1.0, sd)
        # a persona has a numeric part if any of its fields has a mean, whether the table has the field or not
        self.numeric = np.array([any(not math.isnan(value(m)) for m, _ in p.means.values()) for p in personas], dtype=bool)
        self.mode = [np.array([m.get(f.lower()).strip() if m.get(f.lower()) is not None else None for m in modes], dtype=object) for f in cat]
        # neighbours in one block: in order of the first field's mean
        order = np.argsort(self.mean[:, 0], kind="stable") if len(num) and len(personas) > PERSONA_BLOCK else np.arange(len(personas))
        self.blocks = [order[i:i + PERSONA_BLOCK] for i in range(0, len(order), PERSONA_BLOCK)]
        usable = [self.there[b].all(axis=0) for b in self.blocks]
        self.low = [np.where(u, self.mean[b].min(axis=0), -np.inf) for b, u in zip(self.blocks, usable)]
        self.high = [np.where(u, self.mean[b].max(axis=0), np.inf) for b, u in zip(self.blocks, usable)]
        self.wide = [self.sd[b].max(axis=0) for b in self.blocks]

    def _distances(self, block: np.ndarray, x: np.ndarray, cats: list[np.ndarray], current: np.ndarray) -> np.ndarray:
        sq = np.zeros((len(x), len(block)))
        for i in range(x.shape[1]):
            h = x[:, i, None]
            part = ((h - self.mean[block, i]) / self.sd[block, i]) ** 2
            sq += np.where(np.isnan(h) | ~self.there[block, i], 0.0, part)
        mism, used = np.zeros(sq.shape), np.zeros(sq.shape, dtype=bool)
        for values, mode in zip(cats, self.mode):
            ask = mode[block]
            both = pd.notna(values)[:, None] & pd.notna(ask)[None, :]
            mism += both & (values[:, None] != ask[None, :])
            used |= both
        d = np.where(self.numeric[block], np.sqrt(sq), 0.0) + 0.5 * mism
        d[~(self.numeric[block][None, :] | used)] = np.inf
        d[(current[:, None] >= 0) & (self.ids[block][None, :] == current[:, None])] = np.inf
        return d

    def nearest(self, x: np.ndarray, cats: list[np.ndarray], current: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, distances, positions) of the k nearest personas of each row, infinite where
        there are fewer; ties -> persona order."""
        none = np.iinfo(np.int64).max
        best, place = np.full((len(x), k), np.inf), np.full((len(x), k), none)
        ids = np.full((len(x), k), -1)
        bounds = []
        for low, high, wide in zip(self.low, self.high, self.wide):
            gap = np.maximum(np.maximum(low - x, x - high), 0.0) / wide
            bounds.append(np.sqrt((np.where(np.isnan(gap), 0.0, gap) ** 2).sum(axis=1)))
        # the bounds stand a little lower, so that rounding cannot pass over a tie
        bounds = np.array(bounds).reshape(len(self.blocks), len(x)) * (1 - 1e-12)
        for j in np.argsort(bounds.mean(axis=1)) if len(x) else []:
            rows = np.flatnonzero(bounds[j] <= best[:, -1])
            if not len(rows):
                continue
            block = self.blocks[j]
            d = np.concatenate([best[rows], self._distances(block, x[rows], [c[rows] for c in cats], current[rows])], axis=1)
            at = np.concatenate([place[rows], np.broadcast_to(self.ord[block], (len(rows), len(block)))], axis=1)
            who = np.concatenate([ids[rows], np.broadcast_to(self.ids[block], (len(rows), len(block)))], axis=1)
            for r in range(k):
                least = d.min(axis=1)
                pick = np.where(d == least[:, None], at, none).argmin(axis=1)
                every = np.arange(len(rows))
                found = np.isfinite(least)
                best[rows, r] = least
                place[rows, r] = np.where(found, at[every, pick], none)
                ids[rows, r] = np.where(found, who[every, pick], -1)
                d[every, pick] = np.inf
        return ids, best, place


def nearest_personas(df: DataFrame, personas: Sequence[PersonaStats], top_k: int = 2, current: str | None = None,
                     keep: Sequence[str] = ()) -> DataFrame:
    """``(hid, *keep, near)`` with ``near`` an array<struct<persona_id, distance>> of the
    ``top_k`` nearest personas of each row, without the one in column ``current`` (where it is >= 0).

    Distance to a persona: ``sqrt(sum(((h - mean) / std)^2)) + 0.5 * #mode mismatches``; a missing
    household numeric contributes 0; std null or <= 0 -> 1; a missing household category is
    skipped; nothing usable -> no candidate.  Ties -> persona order.  Statistics are shipped as
    arrays, at most ``PERSONA_BYTES`` at once; more personas are scored group by group and each
    row's lists merged."""
    lower = {c.lower(): c for c in df.columns}
    num = list(dict.fromkeys(lower[f.lower()] for p in personas for f in p.means if f.lower() in lower))
    cat = list(dict.fromkeys(lower[f.lower()] for p in personas for f in p.modes if f.lower() in lower))
    keep = [c for c in keep if c != "hid"]
    rows = df.select("hid", *keep, (F.col(current).cast("long") if current else F.lit(-1).cast("long")).alias("_current"),
                     *[_num(F.col(c)).alias(f"_n{i}") for i, c in enumerate(num)],
                     *[F.trim(F.col(c).cast("string")).alias(f"_c{i}") for i, c in enumerate(cat)])
    kept = df.select("hid", *keep).schema
    step = max(1, PERSONA_BYTES // (16 * max(1, len(num)) + 64 * max(1, len(cat))))
    groups = [PersonaTable(personas[i:i + step], num, cat, i) for i in range(0, len(personas), step)]
    if not groups:
        return df.select("hid", *keep, F.array().cast("array<struct<persona_id:int,distance:double>>").alias("near"))
    names = ["hid", *keep]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)

    def scored(table: PersonaTable) -> DataFrame:
        # broadcasts are pickled by reference: arrays travel, the class comes with the function
        shared = df.sparkSession.sparkContext.broadcast(vars(table))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = PersonaTable.__new__(PersonaTable)
            vars(t).update(shared.value)
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    b = batch.iloc[at:at + 2048]
                    x = np.stack([b[f"_n{i}"].to_numpy(dtype=float) for i in range(len(num))], axis=1) if num else np.zeros((len(b), 0))
                    cats = [b[f"_c{i}"].astype(object).to_numpy() for i in range(len(cat))]
                    ids, dist, place = t.nearest(x, cats, b["_current"].fillna(-1).to_numpy(dtype=np.int64), top_k)
                    out = b[names].copy()
                    out["near"] = [[{"distance": float(d), "ord": int(o), "persona_id": int(i)} for i, d, o in zip(*r) if math.isfinite(d)]
                                   for r in zip(ids, dist, place)]
                    yield out
        return rows.mapInPandas(run, f"{shape}, near array<struct<distance:double,ord:bigint,persona_id:int>>")
    out = scored(groups[0])
    if len(groups) > 1:
        for g in groups[1:]:
            out = out.unionByName(scored(g))
        out = out.groupBy("hid").agg(*[F.first(c).alias(c) for c in keep],
                                     F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, top_k).alias("near"))
    return out.select(*names, F.transform("near", lambda s: F.struct(s["persona_id"].alias("persona_id"), s["distance"].alias("distance"))).alias("near"))


def reassign_noise(df: DataFrame, personas: list[PersonaStats], cluster_of_persona: dict[int, int],
                   label: str = "cluster", noise: int = -1) -> DataFrame:
    """Noise households take the cluster of their nearest persona (no
    candidate -> unchanged).  Only the noise rows evaluate distances."""
    mine = df.where(F.col(label) == noise)
    kind = df.schema[label].dataType
    best = nearest_personas(mine, personas, 1, keep=df.columns).withColumn("_p", F.get("near", F.lit(0))["persona_id"])
    if all(p == c for p, c in cluster_of_persona.items()):
        new = F.col("_p")
    else:
        pairs = df.sparkSession.createDataFrame(list(cluster_of_persona.items()), "_p int, _c int")  # one row per persona
        best, new = best.join(pairs, "_p", "left"), F.col("_c")
    moved = best.withColumn(label, F.coalesce(new, F.col(label)).cast(kind)).select(*df.columns)
    return df.where(F.col(label).isNull() | (F.col(label) != noise)).unionByName(moved)


def cluster_persona_map(personas: DataFrame) -> DataFrame:
    """persona's cluster = cluster_id, else statistics['cluster_id'], else its position."""
    stat_cid = F.col("statistics").getItem("cluster_id").try_cast("int") if "statistics" in personas.columns \
        else F.lit(None).cast("int")
    return personas.select("persona_id", F.coalesce(F.col("cluster_id").cast("int"), stat_cid,
                                                    F.col("pos").cast("int")).alias("cluster"))


def initial_mapping(df: DataFrame, cmap: DataFrame, label: str = "cluster") -> DataFrame:
    """Household -> initial cluster (non-numeric -> -1) and persona (unmapped -> -1).
    If several personas map to one cluster the first (lowest persona id) wins."""
    first = cmap.groupBy("cluster").agg(F.min("persona_id").alias("persona_id"))
    c = F.col(label).cast("string").try_cast("int")
    h = df.select("hid", F.coalesce(c, F.lit(-1)).alias("initial_cluster"))
    return h.join(first.withColumnRenamed("cluster", "initial_cluster"), "initial_cluster", "left") \
        .select("hid", "initial_cluster", F.coalesce("persona_id", F.lit(-1)).alias("initial_persona"))


# ---------------------------------------------------------------- similar outliers

def _similar_partition(seeds: pd.DataFrame, stds: dict, num: list[str], cat: list[str], k: int):
    seed_groups = {c: g for c, g in seeds.groupby("cluster")}

    def best(found: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(found, ignore_index=True)
        every = every.sort_values(["seed_hid", "similarity", "hid"], ascending=[True, False, True])
        return every.groupby("seed_hid", sort=False).head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[pd.DataFrame] = []  # the task's best per seed so far, and newer finds
        kept = 0
        for b in batches:
            for cl, rows in b.groupby("cluster"):
                sg = seed_groups.get(cl)
                if sg is None or rows.empty:
                    continue
                std = np.array([stds.get((cl, f), 1.0) for f in num], dtype=float)
                a_num = sg[num].to_numpy(dtype=float) if num else np.zeros((len(sg), 0))
                a_cat = sg[cat].astype(object).to_numpy() if cat else np.zeros((len(sg), 0), dtype=object)
                # block size keeps the seeds x rows x fields distance block near 4M cells
                step = max(64, min(2048, 4_000_000 // max(1, len(sg) * max(1, len(num) + len(cat)))))
                for start in range(0, len(rows), step):
                    r = rows.iloc[start:start + step]
                    b_num = r[num].to_numpy(dtype=float) if num else np.zeros((len(r), 0))
                    b_cat = r[cat].astype(object).to_numpy() if cat else np.zeros((len(r), 0), dtype=object)
                    diff = (a_num[:, None, :] - b_num[None, :, :]) / std[None, None, :]
                    ok = ~np.isnan(diff)
                    n_used = ok.sum(axis=2)
                    ssq = np.where(ok, diff * diff, 0.0).sum(axis=2)
                    a_ok = pd.notna(a_cat)
                    b_ok = pd.notna(b_cat)
                    c_ok = a_ok[:, None, :] & b_ok[None, :, :]
                    a_s = np.vectorize(lambda v: str(v).strip(), otypes=[object])(a_cat) if a_cat.size else a_cat
                    b_s = np.vectorize(lambda v: str(v).strip(), otypes=[object])(b_cat) if b_cat.size else b_cat
                    mism = (c_ok & (a_s[:, None, :] != b_s[None, :, :])).sum(axis=2)
                    c_used = c_ok.sum(axis=2)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        nd = np.where(n_used > 0, np.sqrt(ssq / np.maximum(n_used, 1)), 0.0)
                        cd = np.where(c_used > 0, mism / np.maximum(c_used, 1), 0.0)
                    sim = 1.0 / (1.0 + nd + 0.5 * cd)
                    valid = (n_used + c_used) > 0
                    seed_ids = sg["seed_hid"].to_numpy()
                    cand = r["hid"].to_numpy()
                    self_pair = seed_ids[:, None] == cand[None, :]
                    valid &= ~self_pair
                    out_s, out_c, out_v, out_u = [], [], [], []
                    for i in range(len(sg)):
                        idx = np.nonzero(valid[i])[0]
                        if idx.size == 0:
                            continue
                        order = np.lexsort((cand[idx], -sim[i, idx]))[:k]
                        sel = idx[order]
                        out_s += [seed_ids[i]] * len(sel)
                        out_c += cand[sel].tolist()
                        out_v += sim[i, sel].tolist()
                        out_u += (n_used[i, sel] + c_used[i, sel]).tolist()
                    if out_s:
                        found.append(pd.DataFrame({"seed_hid": out_s, "hid": out_c, "similarity": out_v,
                                                   "fields_used": out_u}))
                        kept += len(out_s)
                    if kept > 4 * k * len(seeds) + 100_000:
                        found = [best(found)]
                        kept = len(found[0])
        if found:
            yield best(found)
    return run


def similar_outliers(cluster_rows: DataFrame, candidates: DataFrame, seeds: DataFrame,
                     num: Sequence[str], cat: Sequence[str], k: int = INFERRED_PER_SEED) -> DataFrame:
    """For each outlier seed, the ``k`` most similar candidates of its cluster.

    distance = sqrt(mean z^2) + 0.5 * mismatch share over fields present on
    both sides, z by the cluster's population std (<= 1e-12 -> 1);
    similarity = 1 / (1 + distance); ties -> smaller hid.  Seeds are bounded
    by the per-cluster sample caps and are shipped to the tasks; every
    candidate task keeps and emits only its own top ``k`` per seed (numpy, in
    blocks), so no seed x candidate pair ever becomes a row; a final
    per-seed top ``k`` merges the partial lists.
    """
    num, cat = list(num), list(cat)
    stds_rows = collect_bounded(
        cluster_rows.groupBy("cluster").agg(*[F.stddev_pop(_num(F.col(f))).alias(f) for f in num])
        if num else cluster_rows.select("cluster").distinct(), MAX_SEEDS, "cluster std")
    stds = {}
    for r in stds_rows:
        for f in num:
            v = r[f]
            stds[(r["cluster"], f)] = 1.0 if (v is None or not math.isfinite(v) or v <= 1e-12) else float(v)
    seed_pd = pd.DataFrame([r.asDict() for r in collect_bounded(
        seeds.select(F.col("hid").alias("seed_hid"), "cluster", *[_num(F.col(f)).alias(f) for f in num],
                     *[F.col(f).cast("string").alias(f) for f in cat]), MAX_SEEDS, "outlier seeds")],
        columns=["seed_hid", "cluster"] + num + cat)
    if seed_pd.empty:
        return candidates.sparkSession.createDataFrame([], "seed_hid long, hid long, similarity double, fields_used long")
    cand = candidates.select("hid", "cluster", *[_num(F.col(f)).alias(f) for f in num],
                             *[F.col(f).cast("string").alias(f) for f in cat])
    partial = cand.mapInPandas(_similar_partition(seed_pd, stds, num, cat, k),
                               "seed_hid long, hid long, similarity double, fields_used long")
    w = Window.partitionBy("seed_hid").orderBy(F.col("similarity").desc(), "hid")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- scores and state

def ucb_reward(fit: Column, total: Column, n: Column, alpha: float = ALPHA) -> Column:
    """Fit + alpha * sqrt(ln N / n); n = 0 -> +inf."""
    return F.when(n <= 0, F.lit(float("inf"))).otherwise(fit + alpha * F.sqrt(F.log(total.cast("double")) / n))


def triage(scored: DataFrame) -> DataFrame:
    """R3 on ``scored(hid, cluster, persona_id, fit, combined, alt1_id, alt1_combined,
    alt2_id, alt2_combined)``: combined >= .6 validated; raw fit < .30
    outlier; else the best alternate strictly above the current score with
    >= .6 moves (pending), otherwise outlier with the best score."""
    c = F.col("combined")
    b1 = F.when(F.col("alt1_combined") > c, F.col("alt1_combined")).otherwise(c)
    p1 = F.when(F.col("alt1_combined") > c, F.col("alt1_id")).otherwise(F.col("persona_id"))
    b2 = F.when(F.col("alt2_combined") > b1, F.col("alt2_combined")).otherwise(b1)
    p2 = F.when(F.col("alt2_combined") > b1, F.col("alt2_id")).otherwise(p1)
    outcome = (F.when(c >= FIT_THRESHOLD, F.lit("validated"))
               .when(F.col("fit") < DIRECT_OUTLIER_FIT, F.lit("outlier"))
               .when((b2 >= FIT_THRESHOLD) & (p2 != F.col("persona_id")), F.lit("moved"))
               .otherwise(F.lit("outlier")))
    return scored.select("*", outcome.alias("outcome"),
                         F.when(outcome == "moved", p2).alias("new_persona_id"),
                         F.when(outcome == "validated", c).when(F.col("fit") < DIRECT_OUTLIER_FIT, c)
                         .otherwise(b2).alias("best_score"))


def state_transitions(state: DataFrame, outcomes: DataFrame, cluster_of_persona: dict[int, int]) -> DataFrame:
    """Apply triage outcomes to ``household_state``.
    validated -> status validated, last-valid set; outlier -> problem; moved ->
    pending with the new persona's cluster; untouched rows keep their state."""
    o = outcomes.select("hid", "outcome", "persona_id", "new_persona_id", F.col("cluster").alias("o_cluster"))
    if all(p == c for p, c in cluster_of_persona.items()):
        target = F.col("new_persona_id")
    else:
        pairs = state.sparkSession.createDataFrame(list(cluster_of_persona.items()), "new_persona_id int, _target int")  # one row per persona
        o, target = o.join(pairs, "new_persona_id", "left"), F.col("_target")
    j = state.join(o, "hid", "left")
    oc = F.col("outcome")
    return j.select(
        "hid",
        F.when(oc == "moved", F.coalesce(target, F.col("cluster"))).otherwise(F.col("cluster"))
        .cast("int").alias("cluster"),
        F.when(oc == "validated", F.lit(VALIDATED)).when(oc == "outlier", F.lit(PROBLEM))
        .when(oc == "moved", F.lit(PENDING)).otherwise(F.col("status")).alias("status"),
        "initial_cluster", "initial_persona",
        F.when(oc == "validated", F.col("o_cluster")).otherwise(F.col("last_valid_cluster")).cast("int")
        .alias("last_valid_cluster"),
        F.when(oc == "validated", F.col("persona_id")).otherwise(F.col("last_valid_persona")).cast("int")
        .alias("last_valid_persona"))


def evaluated_after(evaluated: DataFrame, outcomes: DataFrame) -> DataFrame:
    """R12 on ``evaluated``: every triaged household is evaluated for its persona;
    a moved one is un-evaluated for the new persona."""
    add = outcomes.select("hid", "persona_id")
    moved = outcomes.where(F.col("outcome") == "moved").select("hid", F.col("new_persona_id").alias("persona_id"))
    return evaluated.select("hid", "persona_id").unionByName(add).distinct().join(moved, ["hid", "persona_id"],
                                                                                  "left_anti")


def running_fit(persona_state: DataFrame, new_scores: DataFrame) -> DataFrame:
    """``(fit * n + sum(new)) / (n + m)`` over first passing evaluations per
    (persona, household); ``new_scores(persona_id, hid, score)``."""
    first = new_scores.groupBy("persona_id", "hid").agg(F.min_by("score", "hid").alias("score"))
    agg = first.groupBy("persona_id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("m"))
    j = persona_state.join(agg, "persona_id", "left")
    n = F.coalesce(F.col("num_assigned"), F.lit(0))
    m = F.coalesce(F.col("m"), F.lit(0))
    fit = F.when(n + m > 0, (F.coalesce(F.col("fit_score"), F.lit(0.0)) * n + F.coalesce(F.col("s"), F.lit(0.0)))
                 / (n + m)).otherwise(F.col("fit_score"))
    return j.select("persona_id", fit.alias("fit_score"), (n + m).alias("num_assigned"))


def convergence_metrics(state: DataFrame, personas: DataFrame | None = None) -> DataFrame:
    """Coverage, validated, problem-or-pending and pending shares; avg
    persona fit over personas with n > 0."""
    st = F.col("status")
    m = state.agg(F.count(F.lit(1)).alias("n"),
                  F.count(F.when(st.isin(VALIDATED, PROBLEM, PENDING), 1)).alias("n_covered"),
                  F.count(F.when(st == VALIDATED, 1)).alias("n_validated"),
                  F.count(F.when(st == PROBLEM, 1)).alias("n_problem"),
                  F.count(F.when(st == PENDING, 1)).alias("n_pending"))
    return m.select("n", (F.col("n_covered") / F.col("n")).alias("coverage"),
                    (F.col("n_validated") / F.col("n")).alias("validated_rate"),
                    ((F.col("n_problem") + F.col("n_pending")) / F.col("n")).alias("problem_rate"),
                    (F.col("n_pending") / F.col("n")).alias("pending_rate"), "n_pending")


def converged(metrics: DataFrame, new_personas: Column | int = 0, at_capacity: Column | bool = False) -> DataFrame:
    """Problem < .05, coverage >= .85, nothing pending, and no new persona
    (or no room for one).  Average fit is not tested."""
    newp = new_personas if isinstance(new_personas, Column) else F.lit(int(new_personas))
    cap = at_capacity if isinstance(at_capacity, Column) else F.lit(bool(at_capacity))
    return metrics.withColumn("converged", (F.col("problem_rate") < MIN_PROBLEM_RATE)
                              & (F.col("coverage") >= COVERAGE_TARGET) & (F.col("n_pending") == 0)
                              & ((newp == 0) | cap))


def stage2_trigger(n_outliers: Column, n_evaluated: Column, rate: float = MIN_PROBLEM_RATE) -> Column:
    """#outliers >= max(1, ceil(rate * evaluated))."""
    return n_outliers >= F.greatest(F.lit(1), F.ceil(F.lit(rate) * n_evaluated))


def stall_detection(history: DataFrame, window: int = 3) -> DataFrame:
    """``window`` consecutive idle iterations (no validated, no outliers, no
    moves) with an identical 7-part signature -> stalled."""
    sig = F.concat_ws("|", *[F.col(c).cast("string") for c in
                             ("n_validated", "n_problem", "n_pending", "n_personas", "coverage",
                              "problem_rate", "n_new_personas")])
    idle = (F.col("iter_validated") == 0) & (F.col("iter_outliers") == 0) & (F.col("iter_moved") == 0)
    w = Window.orderBy("iteration")  # one row per iteration
    h = history.withColumn("_sig", sig).withColumn("_idle", idle)
    same = F.lit(True)
    for lag in range(1, window):
        same = same & (F.lag("_sig", lag).over(w) == F.col("_sig")) & F.lag("_idle", lag).over(w)
    return h.withColumn("stalled", F.coalesce(same & F.col("_idle"), F.lit(False))).drop("_sig", "_idle")


def mapping_provenance(state: DataFrame, persona_names: DataFrame, persona_fit: DataFrame) -> DataFrame:
    """Each household's persona: current if validated, else last validated,
    else initial; with names, average fit and the source label."""
    st = F.col("status")
    src = (F.when(st == VALIDATED, F.lit("current_validated"))
           .when(F.col("last_valid_persona").isNotNull(), F.lit("last_validated"))
           .otherwise(F.lit("initial")))
    pid = (F.when(st == VALIDATED, F.col("cluster"))
           .when(F.col("last_valid_persona").isNotNull(), F.col("last_valid_persona"))
           .otherwise(F.col("initial_persona")))
    cid = (F.when(st == VALIDATED, F.col("cluster"))
           .when(F.col("last_valid_persona").isNotNull(), F.col("last_valid_cluster"))
           .otherwise(F.col("initial_cluster")))
    m = state.select("hid", pid.cast("int").alias("persona_id"), cid.cast("int").alias("final_cluster"),
                     src.alias("mapping_source"), "status")
    # one row per persona: Spark broadcasts them where it has found them small
    names = persona_names.select("persona_id", "persona_name")
    fits = persona_fit.select("persona_id", F.col("fit_score").alias("persona_avg_fit"))
    return m.join(names, "persona_id", "left").join(fits, "persona_id", "left") \
        .withColumn("persona_name", F.coalesce("persona_name", F.lit("Unknown")))


def outlier_group_stats(outliers: DataFrame, continuous: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """The single fallback group: mean of each numeric (coerced) and the
    mode of each categorical with nulls read as 'Missing' (ties -> smallest)."""
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    aggs += [F.avg(_num(F.col(c))).alias(f"{c}_mean") for c in continuous]
    aggs += [F.mode(F.coalesce(F.col(c).cast("string"), F.lit("Missing")), True).alias(f"{c}_mode") for c in categorical]
    return outliers.agg(*aggs).withColumn("percentage", F.lit(100.0))


def new_persona_ids(sub_sizes: DataFrame, max_existing_id: int, slots: int) -> DataFrame:
    """Sub-clusters by size desc (ties -> lower local id) get ids
    max_existing + 1, + 2, ... while persona slots remain; cluster id = persona id."""
    w = Window.orderBy(F.col("n").desc(), F.col("local_cluster"))  # one row per sub-cluster
    r = sub_sizes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(0, slots))
    return r.select("local_cluster", "n", (F.lit(max_existing_id) + F.col("_r")).cast("int").alias("persona_id"),
                    (F.lit(max_existing_id) + F.col("_r")).cast("int").alias("cluster_id"))


def tracker_snapshot(persona_state: DataFrame, state: DataFrame, total: int, alpha: float = ALPHA) -> DataFrame:
    """Per persona fit, n, reward and current household count."""
    counts = state.where(F.col("cluster") >= 0).groupBy(F.col("cluster").alias("persona_id")) \
        .agg(F.count(F.lit(1)).alias("n_households"))
    return persona_state.join(counts, "persona_id", "left").select(
        "persona_id", "fit_score", "num_assigned",
        ucb_reward(F.col("fit_score"), F.lit(total), F.col("num_assigned"), alpha).alias("reward"),
        F.coalesce("n_households", F.lit(0)).alias("n_households"))


def attach_field_metadata(stats_long: DataFrame, metadata: DataFrame) -> DataFrame:
    """Profile fields ``(cluster_id, field, metric, value)`` -> one row per
    (cluster_id, field) with category, short label and description from the
    field metadata ``(var_id, category, short_label, description, var_name)``
    (missing -> ''); description whitespace-collapsed and cut to 237 + '...'
    when longer than 240; metrics as a map.  Metadata is one row per field."""
    m = metadata.select(F.col("var_id").alias("field"),
                        F.coalesce(F.trim("category"), F.lit("")).alias("category"),
                        F.coalesce(F.trim("short_label"), F.lit("")).alias("short_label"),
                        F.trim(F.regexp_replace(F.coalesce(F.nullif(F.trim("description"), F.lit("")),
                                                           F.trim("var_name"), F.lit("")), r"\s+", " ")).alias("_d"))
    m = m.withColumn("description", F.when(F.length("_d") > 240, F.concat(F.substring("_d", 1, 237), F.lit("...")))
                     .otherwise(F.col("_d"))).drop("_d")
    per = stats_long.groupBy("cluster_id", "field").agg(F.map_from_entries(F.collect_list(
        F.struct("metric", "value"))).alias("metrics"))
    j = per.join(F.broadcast(m), "field", "left")
    return j.select("cluster_id", "field", *[F.coalesce(F.col(c), F.lit("")).alias(c)
                                            for c in ("category", "short_label", "description")], "metrics")


def match_cluster_households(profiles: DataFrame, households: DataFrame, label: str = "cluster") -> DataFrame:
    """Households of each profile row - numeric comparison when the labels
    parse as numbers (and the profile id does), else text equality.
    Returns ``(cluster_id, hid)``; profiles are one row per cluster (broadcast)."""
    num_labels = households.select(F.max(F.col(label).cast("string").try_cast("double").isNotNull().cast("int"))
                                   .alias("m")).collect()[0]["m"] == 1
    p = profiles.select("cluster_id")
    if num_labels:
        h = households.select("hid", F.col(label).cast("string").try_cast("double").alias("_k"))
        cond = F.col("cluster_id").cast("string").try_cast("double") == F.col("_k")
    else:
        h = households.select("hid", F.col(label).cast("string").alias("_k"))
        cond = F.col("cluster_id").cast("string") == F.col("_k")
    return h.join(p, cond).select("cluster_id", "hid")


def supplementary_fields(values_long: DataFrame, metadata: DataFrame, used: Sequence[str] = (),
                         max_fields: int = 10, per_category: int = 2, demographics_cap: int = 3) -> DataFrame:
    """Per household, unused non-identifier fields with a non-null value,
    demographics first then score (composite, else 10 * importance + usable / 10),
    ties in metadata order; at most 2 per category (3 demographics), 10 in all.
    ``values_long(hid, field, value)``; ``metadata(ord, var_id, category, label,
    composite_score, importance_score, usable_percentage)`` one row per field."""
    used_l = [u.lower() for u in used]
    cat = F.lower(F.trim(F.coalesce(F.col("category"), F.lit(""))))
    comp = F.coalesce(F.col("composite_score").try_cast("double"), F.lit(0.0))
    alt = (F.coalesce(F.col("importance_score").try_cast("double"), F.lit(0.0)) * 10.0
           + F.coalesce(F.col("usable_percentage").try_cast("double"), F.lit(0.0)) / 10.0)
    meta = metadata.where(F.col("var_id").isNotNull() & (F.trim("var_id") != "")) \
        .withColumn("field", F.trim("var_id")).where(~F.lower(F.col("field")).isin(used_l) if used_l else F.lit(True)) \
        .withColumn("cat", cat).where(F.col("cat") != "identifier") \
        .withColumn("score", F.when(comp > 0, comp).otherwise(alt)) \
        .withColumn("is_demo", F.col("cat") == "demographics")
    w = Window.orderBy(F.col("is_demo").desc(), F.col("score").desc(), "ord")  # one row per field
    ranked = meta.withColumn("rank", F.row_number().over(w)).select(
        "field", "rank", F.when(F.col("cat") == "", "unknown").otherwise(F.col("cat")).alias("cat"), "label")
    j = values_long.where(F.col("value").isNotNull()).join(F.broadcast(ranked), "field")
    wc = Window.partitionBy("hid", "cat").orderBy("rank")
    j = j.withColumn("_c", F.row_number().over(wc)).where(
        F.col("_c") <= F.when(F.col("cat") == "demographics", demographics_cap).otherwise(per_category))
    wh = Window.partitionBy("hid").orderBy("rank")
    return j.withColumn("pos", F.row_number().over(wh)).where(F.col("pos") <= max_fields).drop("_c")
