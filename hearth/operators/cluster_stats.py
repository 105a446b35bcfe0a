"""Cluster-level aggregations.

All of them are one ``groupBy`` over the labelled table (partial aggregation
map-side, so a cluster holding a third of all rows is combined before the
shuffle) followed by work on a k-row table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.stats import collect_bounded, py_round

NOISE = -1
MAX_LABELS = 100_000  # label tables brought to the driver are bounded by this


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Households and share per label (noise included)."""
    sizes = df.groupBy(F.col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # k rows
    return sizes.select("cluster", "n", (F.col("n") * 100.0 / total).alias("percentage"))


def small_cluster_min_size(n_rows: int) -> int:
    return max(5, py_round(0.01 * n_rows))


def filter_small_clusters(df: DataFrame, label: str = "cluster",
                          min_size: int | None = None) -> DataFrame:
    """Labels of clusters below the minimum size become -1.

    The size table has one row per label (bounded), so it is collected and the
    relabelling is a narrow projection - no join, no second shuffle.
    """
    rows = collect_bounded(df.groupBy(label).count(), MAX_LABELS, "cluster sizes")
    n = sum(r["count"] for r in rows)
    thr = small_cluster_min_size(n) if min_size is None else min_size
    small = [r[label] for r in rows if r["count"] < thr and r[label] is not None]
    if not small:
        return df
    return df.withColumn(label, F.when(F.col(label).isin(small), F.lit(NOISE))
                         .otherwise(F.col(label)).cast(df.schema[label].dataType))


def cluster_profiles(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str],
                     label: str = "cluster") -> DataFrame:
    """A10: per non-noise cluster: size, share of *all* rows, mean / sample std of
    continuous fields, mode (ties -> smallest, nulls ignored) of categorical ones."""
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for f in continuous:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.stddev_samp(f).alias(f"{f}_std")]
    for f in categorical:
        aggs.append(F.mode(f, True).alias(f"{f}_mode"))
    per = df.groupBy(F.col(label).alias("cluster_id")).agg(*aggs)
    total = F.sum("n_samples").over(Window.partitionBy())
    out = per.withColumn("percentage", F.col("n_samples") * 100.0 / total)
    cols = ["cluster_id", "n_samples", "percentage"] + [c for c in per.columns
                                                          if c not in ("cluster_id", "n_samples")]
    return out.where(F.col("cluster_id") != NOISE).select(*cols)


def profile_long(profiles: DataFrame) -> DataFrame:
    """Wide profile -> long ``(cluster_id, field, metric, num, txt)`` (the working form)."""
    cells = []
    for c in profiles.columns:
        for metric in ("mean", "std", "mode", "median"):
            if c.endswith("_" + metric):
                field = c[: -len(metric) - 1]
                dt = profiles.schema[c].dataType.simpleString()
                num = F.col(c).cast("double") if dt not in ("string",) else F.lit(None).cast("double")
                cells.append(F.struct(F.lit(field).alias("field"), F.lit(metric).alias("metric"),
                                      num.alias("num"), F.col(c).cast("string").alias("txt")))
    return profiles.select("cluster_id", F.explode(F.array(*cells)).alias("m")).select(
        "cluster_id", "m.*")


def cluster_balance(sizes: DataFrame) -> DataFrame:
    """Smallest share, share of clusters under max(10, 1% of rows), max/min
    ratio.  ``sizes`` is the A9 output restricted to real clusters (k rows)."""
    stats = sizes.agg(F.sum("n").alias("total"), F.min("n").alias("n_min"),
                      F.max("n").alias("n_max"), F.count(F.lit(1)).alias("k"),
                      F.collect_list("n").alias("ns"))  # k values
    thr = F.greatest(F.lit(10.0), F.col("total") * 0.01)
    return stats.select(
        "k", (F.col("n_min") / F.col("total")).alias("min_share"),
        (F.size(F.filter("ns", lambda n: n < thr)) / F.col("k")).alias("small_share"),
        (F.col("n_max") / F.col("n_min")).alias("imbalance"))


def cluster_persona_counts(df: DataFrame, personas: DataFrame, label: str = "cluster") -> DataFrame:
    """Households per cluster with persona id and name (``Unknown`` if unmapped).
    ``personas(cluster_id, persona_id, name)`` is one row per persona (bounded)."""
    counts = df.groupBy(F.col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    p = personas.select(F.col("cluster_id").alias("cluster"), "persona_id", "name")
    return counts.join(p, "cluster", "left").select(
        "cluster", "n", F.coalesce("persona_id", F.lit(-1)).alias("persona_id"),
        F.coalesce("name", F.lit("Unknown")).alias("persona_name"))


def unique_row_count(df: DataFrame, columns: Sequence[str], max_k: int | None = None) -> DataFrame:
    """Distinct feature rows (doubles rounded to 6 places, text trimmed),
    exact over all rows; optionally capped at ``max_k``."""
    keys = []
    for c in columns:
        dt = df.schema[c].dataType.simpleString()
        if dt in ("double", "float"):
            keys.append(F.round(F.col(c), 6).alias(c))
        elif dt in ("string",):
            keys.append(F.trim(F.col(c)).alias(c))
        else:
            keys.append(F.col(c))
    n = df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_unique"))
    if max_k is not None:
        n = n.withColumn("n_unique", F.least(F.col("n_unique"), F.lit(max_k)))
    return n


def histogram_by_cluster(df: DataFrame, features: Sequence[str], label: str = "cluster", bins: int = 20) -> DataFrame:
    """``bins``-bin histogram per (cluster, feature) over that cluster's
    own [min, max] (last bin closed; a constant feature falls in the middle
    bin, as numpy does).  All bins are reported, empty ones with 0."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]
    long = df.select(F.col(label).alias("cluster"), F.explode(F.array(*cells)).alias("c")) \
        .select("cluster", "c.feature", "c.x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    rng = long.groupBy("cluster", "feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = F.col("hi") - F.col("lo")
    b = F.when(span == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / span * bins), F.lit(bins - 1))).cast("int")
    counts = long.join(F.broadcast(rng), ["cluster", "feature"]).groupBy("cluster", "feature", b.alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))  # rng: clusters x features rows
    grid = rng.select("cluster", "feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edge = F.when(span == 0, F.col("lo") - 0.5 + F.col("bin") / bins).otherwise(F.col("lo") + span * F.col("bin") / bins)
    return grid.join(counts, ["cluster", "feature", "bin"], "left").select(
        "cluster", "feature", "bin", edge.alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def sample_distributions(sample: DataFrame, fields: Sequence[str], label: str = "cluster") -> DataFrame:
    """Value counts of the demographic fields present in a household sample."""
    present = [f for f in fields if f in sample.columns]
    if not present:
        return sample.sparkSession.createDataFrame([], "cluster int, field string, value string, n long")
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in present]
    return sample.select(F.col(label).alias("cluster"), F.explode(F.array(*cells)).alias("c")) \
        .select("cluster", "c.field", "c.value").groupBy("cluster", "field", "value").agg(F.count(F.lit(1)).alias("n"))
