"""Column profiling and field selection.

A wide table is profiled with *one* long value-count table per type
(``melt`` -> ``groupBy(column, value)``), map-side combined, instead of one job
per column.  Moments and quartiles come from the long table of the numeric columns.
The resulting profile has one row per column (bounded by the schema) and is made once,
however often it is read afterwards.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.stats import (collect_bounded, group_sizes, is_numeric_type, melt, quantiles,
                                    small_table, value_counts)

# Fixed values (defaults of the segmentation job)
MIN_COMPLETENESS = 0.7
MAX_CATEGORICAL_LEVELS = 20
MAX_SELECTED_FIELDS = 50
MISSING_THRESHOLD = 0.5
CONSTANT_THRESHOLD = 0.95
GOOD_QUALITY = 6.5
DEFAULT_EXCLUDED_PATTERNS = [r"^id$", r"^.*_id$", r"^interview_"]
MAX_COLUMNS = 100_000
SUMMARY = ("field string, ord int, is_num boolean, n_total long, n_nonnull long, n_unique long, top_cnt long, "
           "entropy_ln double, mean double, std double, q25 double, q50 double, q75 double")


def _field_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts, levels, the commonest level, entropy, moments and quartiles,
    from two jobs and those of the quantiles, whatever the number of columns."""
    spark = df.sparkSession
    numeric = [(i, c) for i, c in enumerate(columns) if is_numeric_type(df.schema[c].dataType)]
    moments, total = [], None
    if numeric:
        long = melt(df, numeric, "double")
        moments = collect_bounded(long.groupBy("ord").agg(F.count(F.lit(1)).alias("n_total"), F.avg("x").alias("mean"),
                                                          F.stddev_samp("x").alias("std"), *group_sizes("x")),
                                  MAX_COLUMNS, "column moments")
        total = moments[0]["n_total"] if moments else 0
    total = df.count() if total is None else total
    rows = {i: {"field": c, "ord": i, "is_num": False, "n_total": total, "n_nonnull": 0, "n_unique": 0}
            for i, c in enumerate(columns) if total}
    if rows:
        # equal counts of a column together: at most sqrt(2 n) rows per column are left
        same = (reduce(DataFrame.union, [v.select("ord", "cnt") for v in value_counts(df, columns)])
                .groupBy("ord", "cnt").agg(F.count(F.lit(1)).alias("levels")))
        p = F.col("cnt") / F.sum(F.col("cnt") * F.col("levels")).over(Window.partitionBy("ord"))
        levels = same.withColumn("p", p).groupBy("ord").agg(
            F.sum(F.col("cnt") * F.col("levels")).alias("n_nonnull"), F.sum("levels").alias("n_unique"), F.max("cnt").alias("top_cnt"),
            (-F.sum(F.col("levels") * F.col("p") * F.log(F.col("p") + F.lit(1e-10)))).alias("entropy_ln"))
        for r in collect_bounded(levels, MAX_COLUMNS, "column levels"):
            rows[r["ord"]].update(r.asDict())
    if rows and numeric:
        for i, _ in numeric:
            rows[i]["is_num"] = True
        quartiles = quantiles(long, ["ord"], "x", [0.25, 0.5, 0.75], sizes=moments)
        for table in (moments, collect_bounded(quartiles, MAX_COLUMNS, "column quartiles")):
            for r in table:
                rows[r["ord"]].update(r.asDict())
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    return small_table(spark, [tuple(r.get(c) for c in names) for r in rows.values()], SUMMARY).coalesce(1)


def field_profile(df: DataFrame, columns: Sequence[str] | None = None,
                  max_levels: int = MAX_CATEGORICAL_LEVELS) -> DataFrame:
    """A1-A4: one row per column.

    ``field_type`` cascade (in order): <=1 distinct constant, =2 binary, numeric
    and > max_levels continuous, <= max_levels categorical, else
    high_cardinality.  ``variance_score``: dispersion (A2) for continuous,
    ``min(10, 3 H)`` (A3) for categorical, 5 binary, 3 high cardinality, 0
    constant.  ``quality_score = 5 completeness + 0.3 variance + 2 [usable type]``.
    """
    j = _field_summary(df, list(columns if columns is not None else df.columns))
    nu = F.col("n_unique")
    ftype = (F.when(nu <= 1, "constant").when(nu == 2, "binary")
             .when(F.col("is_num") & (nu > max_levels), "continuous")
             .when(nu <= max_levels, "categorical").otherwise("high_cardinality"))
    iqr = F.greatest(F.lit(0.0), F.col("q75") - F.col("q25"))
    denom = F.greatest(F.abs(F.col("mean")), F.abs(F.col("q50")), F.lit(1e-9))
    dispersion = F.least(F.lit(10.0), F.greatest(F.col("std"), iqr) / denom * 5.0)
    out = j.withColumn("field_type", ftype).withColumn(
        "variance_score",
        F.when(F.col("field_type") == "constant", F.lit(0.0))
        .when(F.col("field_type") == "binary", F.lit(5.0))
        .when(F.col("field_type") == "continuous", F.coalesce(dispersion, F.lit(0.0)))
        .when(F.col("field_type") == "categorical",
              F.least(F.lit(10.0), F.col("entropy_ln") * 3.0))
        .otherwise(F.lit(3.0)))
    completeness = F.when(F.col("n_total") > 0, F.col("n_nonnull") / F.col("n_total")).otherwise(0.0)
    usable = F.col("field_type").isin("continuous", "categorical", "binary").cast("double")
    return out.select(
        F.col("field").alias("field_name"), "ord", "field_type",
        completeness.alias("completeness"), F.col("n_unique"),
        "variance_score",
        (completeness * 5.0 + F.col("variance_score") / 10.0 * 3.0 + usable * 2.0).alias("quality_score"),
        F.col("is_num").alias("is_numeric"),
        (F.col("top_cnt") / F.col("n_nonnull")).alias("dominant_ratio"),
        (F.col("n_total") - F.col("n_nonnull")).alias("n_missing"),
        F.col("mean"), F.col("std"), F.col("q25"), F.col("q50"), F.col("q75"),
        F.col("entropy_ln"))


# ---------------------------------------------------------------- cleaning

def _matches_any(name: str, patterns: Iterable[str]) -> bool:
    return any(re.match(p, name, re.IGNORECASE) for p in patterns)


def cleaning_decisions(profile: DataFrame, excluded_patterns: Sequence[str] = (),
                       force_include: Sequence[str] = (),
                       missing_threshold: float = MISSING_THRESHOLD,
                       constant_threshold: float = CONSTANT_THRESHOLD) -> DataFrame:
    """F5-F7 on the profile: ``(field_name, ord, null_rate, top_share, reason)``.

    F5 drops null share > 0.5; after it, F6 drops all-null columns and top-value
    share >= 0.95 unless the name matches an excluded pattern; forced columns
    are always kept.  ``reason`` is null for kept columns.
    """
    force = list(force_include)
    excl = F.lit(False)
    for p in excluded_patterns:
        excl = excl | F.col("field_name").rlike("(?i)^(?:" + p.lstrip("^") + ")")
    forced = F.col("field_name").isin(force) if force else F.lit(False)
    null_rate = 1.0 - F.col("completeness")
    top = F.col("dominant_ratio")
    reason = (F.when(forced, F.lit(None).cast("string"))
              .when(null_rate > missing_threshold, F.lit("missing"))
              .when(excl, F.lit(None).cast("string"))
              .when(top.isNull() | (top >= constant_threshold), F.lit("constant")))
    return profile.select("field_name", "ord", null_rate.alias("null_rate"),
                          top.alias("top_share"), reason.alias("reason"))


# ---------------------------------------------------------------- gates

def gate_candidates(profile: DataFrame, min_levels: int = 2, max_levels: int = 12,
                    max_null_share: float = 0.35) -> DataFrame:
    """Columns with 2..12 distinct non-null values and null share <= 0.35."""
    return profile.where(F.col("n_unique").between(min_levels, max_levels)
                         & ((1.0 - F.col("completeness")) <= max_null_share)) \
        .select("field_name", "ord")


# ---------------------------------------------------------------- selection

def field_summary_topk(profile: DataFrame, k: int = 20) -> DataFrame:
    """Best ``k`` fields by quality per field type (ties -> column order)."""
    w = Window.partitionBy("field_type").orderBy(F.col("quality_score").desc(), "ord")
    return profile.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _eligible(profile: DataFrame, min_completeness: float, max_levels: int) -> Column:
    ft = F.col("field_type")
    return (ft.isin("continuous", "categorical", "binary")
            & (F.col("completeness") >= min_completeness)
            & ~(ft.isin("categorical", "binary") & (F.col("n_unique") > max_levels)))


def selection_bounds(profile: DataFrame, n_samples: Column | int,
                     min_completeness: float = MIN_COMPLETENESS,
                     max_levels: int = MAX_CATEGORICAL_LEVELS,
                     max_selected: int = MAX_SELECTED_FIELDS,
                     target_request: int | None = None,
                     min_request: int | None = None) -> DataFrame:
    """``(target, min_fields, pool_size, use_good)`` in one row.

    pool = eligible fields with quality >= 6.5 if there are >= 6 of them, else
    all eligible.  Python ``round`` is half-to-even, hence ``bround``.
    """
    el = profile.where(_eligible(profile, min_completeness, max_levels))
    agg = el.agg(F.count(F.lit(1)).alias("n_el"),
                 F.count(F.when(F.col("quality_score") >= GOOD_QUALITY, 1)).alias("n_good"))
    n = F.greatest(F.lit(1), F.lit(n_samples) if isinstance(n_samples, int) else n_samples)
    pool = F.when(F.col("n_good") >= 6, F.col("n_good")).otherwise(F.col("n_el"))
    factor = F.least(F.lit(1.0), 0.7 + 0.3 * F.log10(F.greatest(F.lit(10), n).cast("double")) / 2)
    pool_target = F.bround(pool * 0.6, 0)
    adjusted = F.bround(pool_target * factor, 0)
    min_reason = F.greatest(F.lit(8.0), F.bround(pool * 0.3, 0))
    target = F.least(F.greatest(min_reason, adjusted), F.lit(float(max_selected)), pool.cast("double"))
    if target_request and target_request > 0:
        target = F.least(F.greatest(target, F.lit(float(target_request))), pool.cast("double"),
                         F.lit(float(max_selected)))
    out = agg.select(pool.alias("pool_size"), (F.col("n_good") >= 6).alias("use_good"),
                     target.cast("int").alias("target"))
    mn = F.least(F.greatest(F.lit(6.0), F.bround(F.col("target") * 0.8, 0)),
                 F.col("target").cast("double"), F.col("pool_size").cast("double"))
    if min_request and min_request > 0:
        mn = F.least(F.greatest(mn, F.lit(float(min_request))), F.col("target").cast("double"),
                     F.col("pool_size").cast("double"))
    return out.select("target", mn.cast("int").alias("min_fields"),
                      F.col("pool_size").cast("int").alias("pool_size"), "use_good")


def rank_select(profile: DataFrame, bounds: DataFrame,
                min_completeness: float = MIN_COMPLETENESS,
                max_levels: int = MAX_CATEGORICAL_LEVELS) -> DataFrame:
    """Deterministic stand-in for the model's choice - fields of the W10 pool
    by quality desc then name; take ``target``.  ``type`` is continuous for
    continuous fields, categorical otherwise.  ``bounds`` is W10's single row."""
    b = collect_bounded(bounds, 1, "selection bounds")[0]
    pool = profile.where(_eligible(profile, min_completeness, max_levels))
    if b["use_good"]:
        pool = pool.where(F.col("quality_score") >= GOOD_QUALITY)
    w = Window.orderBy(F.col("quality_score").desc(), F.col("field_name"))  # one row per column
    ranked = pool.withColumn("sel_ord", F.row_number().over(w))
    return ranked.where(F.col("sel_ord") <= F.lit(int(b["target"]))).select(
        "sel_ord", "field_name",
        F.when(F.col("field_type") == "continuous", "continuous").otherwise("categorical").alias("type"))


def validate_selection(selection: DataFrame, profile: DataFrame,
                       force_include: Sequence[str] = (), cap: int = MAX_SELECTED_FIELDS) -> DataFrame:
    """Normalise entries ``(sel_ord, field_name|name|var_id|var_name, type)``, drop
    unknown columns, default type from the profile, append forced fields,
    dedupe keeping the first, cap at 50."""
    cols = selection.columns
    name_cols = [c for c in ("field_name", "name", "var_id", "var_name") if c in cols]
    name = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in name_cols])
    typ = F.col("type") if "type" in cols else F.lit(None).cast("string")
    sel = selection.select(F.col("sel_ord").cast("long").alias("sel_ord"), name.alias("field_name"),
                           F.lower(typ).alias("req_type"))
    prof = F.broadcast(profile.select("field_name", "field_type"))
    known = sel.join(prof, "field_name", "inner")
    if force_include:
        spark = selection.sparkSession
        forced = spark.createDataFrame([(10**9 + i, f, None) for i, f in enumerate(force_include)],
                                       "sel_ord long, field_name string, req_type string")
        known = known.unionByName(forced.join(prof, "field_name", "inner"))
    default_type = F.when(F.col("field_type") == "continuous", "continuous").otherwise("categorical")
    typed = known.withColumn("type", F.when(F.col("req_type").isin("continuous", "categorical"),
                                            F.col("req_type")).otherwise(default_type))
    w = Window.partitionBy("field_name").orderBy("sel_ord")
    first = typed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    w2 = Window.orderBy("sel_ord")
    return (first.withColumn("pos", F.row_number().over(w2)).where(F.col("pos") <= cap)
            .select("pos", "field_name", "type"))


def selection_statistics(selection: DataFrame) -> DataFrame:
    """Totals of continuous / categorical fields in a selection."""
    return selection.agg(F.count(F.lit(1)).alias("total"),
                         F.count(F.when(F.col("type") == "continuous", 1)).alias("n_continuous"),
                         F.count(F.when(F.col("type") == "categorical", 1)).alias("n_categorical"))


# ---------------------------------------------------------------- W11, W12

def reuse_selection(df: DataFrame, saved: list, excluded_patterns: Sequence[str] = (),
                    force_include: Sequence[str] = (), cap: int = MAX_SELECTED_FIELDS) -> list[dict] | None:
    """Re-apply a saved selection to a (new) table.  Entries are names or
    ``{field_name|name|var_id|var_name, type}``; missing or excluded columns are
    dropped, a missing type comes from the column type (numeric -> continuous,
    else categorical), forced columns are appended, first occurrence kept, at
    most ``cap``.  Works on ``df.dtypes`` (schema only).  Nothing usable -> None."""
    types = dict(df.dtypes)
    numeric = {f.name for f in df.schema.fields if is_numeric_type(f.dataType)}
    out, seen = [], set()

    def add(name, typ):
        if name in seen or name not in types:
            return
        if _matches_any(name, excluded_patterns) and name not in force_include:
            return
        t = (typ or "").lower()
        if t not in ("continuous", "categorical"):
            t = "continuous" if name in numeric else "categorical"
        seen.add(name)
        out.append({"field_name": name, "type": t})

    for item in saved or []:
        if isinstance(item, str):
            add(item.strip(), None)
        elif isinstance(item, dict):
            name = next((str(item[k]).strip() for k in ("field_name", "name", "var_id", "var_name")
                         if item.get(k) and str(item[k]).strip()), None)
            if name:
                add(name, item.get("type"))
    for f in force_include:
        add(f, None)
    out = out[:cap]
    return out or None


def recluster_fields(df: DataFrame, saved: list | None = None, max_numeric: int = 20,
                     max_categorical: int = 30) -> tuple[list[str], list[str]]:
    """The saved selection's fields present in the table, else numeric
    columns (first 20) and non-numeric columns with 2..20 levels (first 30),
    excluding ``cluster`` and ``q1_`` .. ``q10_`` columns.  The level counts are
    one ``approx``-free ``countDistinct`` aggregation over the candidate columns."""
    if saved:
        cont = [s["field_name"] for s in saved if isinstance(s, dict) and s.get("field_name") in df.columns
                and str(s.get("type", "")).lower() == "continuous"]
        cat = [s["field_name"] for s in saved if isinstance(s, dict) and s.get("field_name") in df.columns
               and str(s.get("type", "")).lower() != "continuous"]
        if cont or cat:
            return cont, cat
    blocked = tuple(f"q{i}_" for i in range(1, 11))
    cands = [c for c in df.columns if c != "cluster" and not c.startswith(blocked)]
    numeric = {f.name for f in df.schema.fields if is_numeric_type(f.dataType)}
    num = [c for c in cands if c in numeric]
    obj = [c for c in cands if c not in numeric]
    cat = []
    if obj:
        counts = df.agg(*[F.countDistinct(c).alias(c) for c in obj]).collect()[0]
        cat = [c for c in obj if 2 <= counts[c] <= 20]
    return num[:max_numeric], cat[:max_categorical]
