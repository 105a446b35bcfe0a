"""Candidate-field scoring and per-category quota selection
(T6-T8, F1, F8, W1-W5, W7, A5-A7, J1).

Candidate tables can be large (one row per extracted field per chunk); the
category tables are small (one row per category).  Dedupe uses ``min_by``
(map-side combined, safe when one id holds a third of all rows); per-category
top-n uses ``row_number`` with a literal upper bound so Spark inserts a
partial window-group-limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default category priorities (1-10) of the field allocator
PRIORITY = {
    "identifier": 10, "demographics": 9, "income": 8, "consumption": 8, "assets": 8, "debt": 7,
    "employment_behavior": 7, "financial_behavior": 7, "housing_behavior": 6, "health_behavior": 6,
    "education_investment": 7, "time_use_lifestyle": 5, "attitudes_expectations": 7,
    "program_participation": 6, "other": 3,
}
DEFAULT_PRIORITY = 5
FIELD_TARGET = 75

# Held-out test and validation variables per dataset
HOLDOUT = {
    "psid": ["ER84008", "ER82904", "ER82886", "ER82459", "ER84134", "ER82052", "ER82479", "ER82444",
             "ER84114", "ER82147",
             "ER84043", "ER82885", "ER82887", "ER82890", "ER82442", "ER84048", "ER82069", "ER82160",
             "ER82692", "ER82070", "ER84034", "ER84150", "ER82958", "ER85222", "ER83971", "ER85208",
             "ER83872", "ER82148", "ER84024", "ER85243"],
    "shed": ["K21_c", "ppfs0001", "E1_e", "E1_d", "EF6C_b", "K21_f", "A0", "D44_c", "E1_b", "R11",
             "EF1", "pay_casheqv", "K5A_b", "EF5C", "K5A_c", "S16_a", "EF3_a", "DC4", "INF3_f", "A0B",
             "BNPL1", "C3P", "D44_d", "D44_a", "D44_e", "ND4_c", "K0", "E1_a", "E1_c", "R1_c"],
}


def holdout_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, v) for d, ids in HOLDOUT.items() for v in ids],
                                 "dataset string, var_id string")


def parse_percent(c: Column) -> Column:
    """Keep digits and dots, then to double (unparsable -> null)."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.]", "").try_cast("double")


def parse_score(c: Column) -> Column:
    """Text -> double; null when it does not parse."""
    return F.trim(c.cast("string")).try_cast("double")


def normalize_data_type(category: Column, data_type: Column) -> Column:
    """Category identifier forces data_type identifier; a data_type
    identifier elsewhere becomes categorical."""
    cat = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    dt = F.lower(F.trim(F.coalesce(data_type, F.lit(""))))
    return F.when(cat == "identifier", "identifier").when(dt == "identifier", "categorical").otherwise(data_type)


def priority_expr(category: Column, priorities: dict[str, int] | None = None) -> Column:
    p = priorities or PRIORITY
    m = F.create_map(*[x for k, v in p.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[category], F.lit(DEFAULT_PRIORITY))


def exclude_holdout(candidates: DataFrame, holdout: DataFrame) -> DataFrame:
    """drop held-out ``(dataset, var_id)``; the holdout list is small and
    bounded (tens of ids per dataset), hence broadcast."""
    return candidates.join(F.broadcast(holdout.select("dataset", "var_id")), ["dataset", "var_id"], "left_anti")


def drop_unscored(candidates: DataFrame) -> DataFrame:
    """F8: candidates without an importance score are removed."""
    return candidates.where(F.col("importance_score").isNotNull())


def composite_score(importance: Column, usable: Column, quality_filter: bool = True) -> Column:
    """``0.7 * 10 * importance + 0.3 * usable`` (defaults 5 / 100), or ``10 * importance``."""
    imp = F.coalesce(importance, F.lit(5.0))
    if not quality_filter:
        return imp * 10
    return imp * 10 * 0.7 + F.coalesce(usable, F.lit(100.0)) * 0.3


def dedupe_first(candidates: DataFrame, quality_filter: bool = True, columns: list[str] | None = None) -> DataFrame:
    """W1 (+T6-T8, A6): first row per var_id by ``seq``; blank ids skipped; rows
    whose importance does not parse are skipped *before* they count as seen.
    ``columns`` are the ones to carry (default all): name them, so that texts
    nobody asks for are neither read nor shuffled."""
    c = candidates.where(F.col("var_id").isNotNull() & (F.trim(F.col("var_id")) != ""))
    imp_txt = F.col("importance_score").cast("string")
    imp = parse_score(imp_txt)
    c = c.where(F.col("importance_score").isNull() | imp.isNotNull())
    c = c.withColumn("importance", imp).withColumn("usable", parse_percent(F.col("usable_percentage")))
    c = c.withColumn("data_type", normalize_data_type(F.col("category"), F.col("data_type")))
    c = c.withColumn("composite_score", composite_score(F.col("importance"), F.col("usable"), quality_filter))
    cols = [x for x in (columns or c.columns) if x != "var_id"]
    first = c.groupBy("var_id").agg(F.min_by(F.struct(*cols), F.col("seq")).alias("r"))
    return first.select("var_id", "r.*")


def category_stats(fields: DataFrame) -> DataFrame:
    """A5: per category count, average usable (missing -> 0) and importance
    (missing -> 0), first-seen position."""
    return fields.groupBy("category").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(F.coalesce(F.col("usable"), F.lit(0.0))).alias("avg_quality"),
        F.avg(F.coalesce(F.col("importance"), F.lit(0.0))).alias("avg_importance"),
        F.min("seq").alias("first_seen"))


def quota_allocation(stats: DataFrame, target: int = FIELD_TARGET,
                     priorities: dict[str, int] | None = None) -> DataFrame:
    """Group score ``priority * ln(n + 1) * avg_importance / 5`` (identifier
    scores 1 and gets quota 1); quota = trunc((target - 1) * score / total),
    capped at n, at least 1.  One row per category (small)."""
    pr = priority_expr(F.col("category"), priorities)
    is_id = F.col("category") == "identifier"
    s = stats.withColumn("priority", pr).withColumn(
        "alloc_score", F.when(is_id, F.lit(1.0)).otherwise(
            F.col("priority") * F.log(F.col("count") + 1.0) * (F.col("avg_importance") / 5)))
    total = F.sum("alloc_score").over(Window.partitionBy())
    q = F.floor((target - 1) * F.col("alloc_score") / total).cast("long")
    q = F.when(is_id, F.lit(1)).otherwise(F.greatest(F.least(q, F.col("count")), F.lit(1)))
    return s.withColumn("quota0", q.cast("long"))


def quota_remainder(alloc: DataFrame, target: int = FIELD_TARGET) -> DataFrame:
    """W3 (fair round-robin, D7): if the quotas sum below ``target`` hand out +1
    per round to categories with room, priority desc then first seen; if
    above, take 1 per round from categories with quota left, priority asc.
    Identifier untouched.  Only ``|diff|`` slots are ever materialised."""
    w_all = Window.partitionBy()
    a = alloc.withColumn("diff", F.lit(target) - F.sum("quota0").over(w_all))
    non_id = F.col("category") != "identifier"
    room = F.when(non_id & (F.col("diff") > 0), F.least(F.col("count") - F.col("quota0"), F.col("diff"))) \
        .when(non_id & (F.col("diff") < 0), F.least(F.col("quota0"), -F.col("diff"))).otherwise(0)
    slots = a.where(room > 0).select("category", "priority", "first_seen", "diff",
                                     F.explode(F.sequence(F.lit(1).cast("long"), room.cast("long"))).alias("round"))
    pri = F.when(F.col("diff") > 0, -F.col("priority")).otherwise(F.col("priority"))
    w = Window.orderBy("round", pri, "first_seen")  # at most |diff| x categories rows
    taken = slots.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.abs(F.col("diff")))
    delta = taken.groupBy("category").agg((F.count(F.lit(1)) * F.signum(F.first("diff"))).cast("long").alias("delta"))
    out = a.join(delta, "category", "left")
    return out.withColumn("quota", F.col("quota0") + F.coalesce(F.col("delta"), F.lit(0))).drop("delta", "diff")


def top_n_per_group(fields: DataFrame, quotas: DataFrame) -> DataFrame:
    """Best ``quota`` rows per category by composite score, ties keep input
    order.  ``quotas`` has one row per category (broadcast); the largest quota
    bounds the rank, so that groups are cut before the shuffle."""
    max_quota = quotas.agg(F.max("quota")).first()[0] or 0
    w = Window.partitionBy("category").orderBy(F.col("composite_score").desc(), "seq")
    ranked = fields.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_quota)
    q = F.broadcast(quotas.select("category", "quota"))
    return ranked.join(q, "category").where(F.col("rank") <= F.col("quota"))


def quota_report(quotas: DataFrame) -> DataFrame:
    """Allocated, available, utilisation %, filtered-out count per category."""
    return quotas.select(
        "category", F.col("quota").alias("allocated"), F.col("count").alias("available"),
        F.when(F.col("count") > 0, F.col("quota") / F.col("count") * 100.0).otherwise(0.0).alias("utilization"),
        F.greatest(F.col("count") - F.col("quota"), F.lit(0)).alias("filtered"))


def final_category_summary(chosen: DataFrame) -> DataFrame:
    """Count, average usable and importance per category of the chosen fields."""
    return chosen.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("usable", F.lit(0.0))).alias("avg_quality"),
        F.avg(F.coalesce("importance", F.lit(0.0))).alias("avg_importance"))


def category_digest(chosen: DataFrame, k: int = 10, order_col: str = "rank") -> DataFrame:
    """First ``k`` fields per category (list order) + how many more."""
    w = Window.partitionBy("category").orderBy(order_col)
    c = chosen.withColumn("i", F.row_number().over(w))
    n = chosen.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    lines = c.where(F.col("i") <= k).withColumn(
        "line", F.format_string("- %s: %s (usable: %.1f%%)", F.col("var_id"), F.coalesce("var_name", F.lit("")),
                                F.coalesce("usable", F.lit(0.0))))
    firsts = lines.groupBy("category").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]),
                     "\n").alias("listing"))
    return n.join(firsts, "category").select("category", "n", "listing",
                                             F.greatest(F.col("n") - k, F.lit(0)).alias("n_more"))


def align_with_codebook(fields: DataFrame, codebook: DataFrame) -> DataFrame:
    """Overwrite var_name / description with the codebook's non-empty label /
    description; unmatched rows unchanged.  The codebook side is one row per
    variable, joined on the id (shuffle join when large, broadcast by AQE when small)."""
    cb = codebook.select(F.trim(F.col("var_id")).alias("_vid"), F.col("label").alias("_label"),
                         F.col("description").alias("_desc"))
    j = fields.join(cb, F.trim(F.col("var_id")) == F.col("_vid"), "left")
    return j.withColumn("var_name", F.coalesce(F.nullif(F.col("_label"), F.lit("")), F.col("var_name"))) \
        .withColumn("description", F.coalesce(F.nullif(F.col("_desc"), F.lit("")), F.col("description"))) \
        .drop("_vid", "_label", "_desc")


def allocate(candidates: DataFrame, target: int = FIELD_TARGET, quality_filter: bool = True,
             priorities: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """W1-W4 composed: (chosen fields, per-category quota table)."""
    fields = dedupe_first(candidates, quality_filter)
    quotas = quota_remainder(quota_allocation(category_stats(fields), target, priorities), target)
    return top_n_per_group(fields, quotas, max(target, 1)), quotas
