"""Structural vs real missingness, imputation and scaling.

Plan shape: the gate columns are unpivoted once (N x G rows) and grouped by
``(gate, level)`` with one ``sum(is_missing)`` column per target, so every
(target, gate) pair is decided from a table of at most G x 13 rows after one
map-side-combined shuffle.  Rules, medians and scaling constants are bounded
by the number of columns and become literals in narrow projections.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.stats import collect_bounded, is_numeric_type, py_round, quantiles

# Missing-answer tokens and placeholder levels
MISSING_TOKENS = ["refus", "don't know", "dont know", "dk", "unknown", "not ascertained"]
PLACEHOLDERS = ["missing", "inapplicable", "<na>", "nan"]
NA_LEVEL = "<NA>"
# thresholds (high, low, min_gap, min_explained)
CONT_RULE = (0.9, 0.1, 0.7, 0.6)
CAT_RULE = (0.8, 0.2, 0.6, 0.5)
MAX_RULES = 100_000


def token_hit(c: Column) -> Column:
    """lower-cased, trimmed text contains a missing-answer token."""
    t = F.lower(F.trim(c.cast("string")))
    hit = F.lit(False)
    for tok in MISSING_TOKENS:
        hit = hit | F.contains(t, F.lit(tok))
    return F.coalesce(hit, F.lit(False))


def is_blank(c: Column) -> Column:
    """null, or a string whose trim is empty."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def is_placeholder(c: Column) -> Column:
    """blank or one of the placeholder levels (case-insensitive)."""
    return is_blank(c) | F.lower(F.trim(c.cast("string"))).isin(PLACEHOLDERS)


def min_group_size(n_rows: int) -> int:
    return max(3, py_round(n_rows * 0.02))


def _missing_flag(df: DataFrame, t: str, numeric: bool) -> Column:
    c = F.col(t)
    if numeric:
        dt = df.schema[t].dataType
        return (c.isNull() if is_numeric_type(dt) else c.cast("string").try_cast("double").isNull())
    return is_blank(c)


def gate_missing_rates(df: DataFrame, gates: Sequence[str], targets: dict[str, bool]) -> DataFrame:
    """``(gate, gate_ord, level, size, target, n_miss, rate)``.

    ``targets`` maps a column to True when it is numeric (coerced) or False when
    it is categorical (null or blank counts as missing).  Null gate values form
    the level ``<NA>``.
    """
    cells = [F.struct(F.lit(g).alias("gate"), F.lit(i).alias("gate_ord"),
                      F.coalesce(F.col(g).cast("string"), F.lit(NA_LEVEL)).alias("level"))
             for i, g in enumerate(gates)]
    flags = [_missing_flag(df, t, num).cast("int").alias(f"m{j}") for j, (t, num) in enumerate(targets.items())]
    long = df.select(F.explode(F.array(*cells)).alias("g"), *flags).select("g.*", *[f"m{j}" for j in range(len(targets))])
    agg = long.groupBy("gate", "gate_ord", "level").agg(
        F.count(F.lit(1)).alias("size"), *[F.sum(f"m{j}").alias(f"m{j}") for j in range(len(targets))])
    per_t = [F.struct(F.lit(t).alias("target"), F.lit(num).alias("target_numeric"),
                      F.col(f"m{j}").alias("n_miss")) for j, (t, num) in enumerate(targets.items())]
    return agg.select("gate", "gate_ord", "level", "size", F.explode(F.array(*per_t)).alias("t")) \
        .select("gate", "gate_ord", "level", "size", "t.*",
                (F.col("t.n_miss") / F.col("size")).alias("rate"))


def structural_rules(rates: DataFrame, min_size: int, cont=CONT_RULE, cat=CAT_RULE) -> DataFrame:
    """Best gate per target.

    Conditions: gate != target; gate has no token-like level; >= 2 levels of the
    minimum size; among them max rate >= high, min rate <= low, gap >= min_gap;
    structural levels = rate >= high; explained share >= min_explained.
    score = 10 explained + gap; ties go to the earlier gate column.
    """
    hi = F.when(F.col("target_numeric"), cont[0]).otherwise(cat[0])
    lo = F.when(F.col("target_numeric"), cont[1]).otherwise(cat[1])
    gap_min = F.when(F.col("target_numeric"), cont[2]).otherwise(cat[2])
    expl_min = F.when(F.col("target_numeric"), cont[3]).otherwise(cat[3])
    r = rates.where(F.col("gate") != F.col("target"))
    wtg = Window.partitionBy("target", "gate")
    r = r.withColumn("tot_miss", F.sum("n_miss").over(wtg)) \
         .withColumn("gate_token", F.max(F.when(F.col("level") != NA_LEVEL,
                                                token_hit(F.col("level"))).otherwise(False)).over(wtg)) \
         .withColumn("hi", hi).withColumn("lo", lo).withColumn("gap_min", gap_min) \
         .withColumn("expl_min", expl_min)
    big = r.where((F.col("size") >= min_size) & (F.col("tot_miss") > 0) & ~F.col("gate_token"))
    is_struct = F.col("rate") >= F.col("hi")
    g = big.groupBy("target", "target_numeric", "gate", "gate_ord").agg(
        F.count(F.lit(1)).alias("n_groups"), F.max("rate").alias("max_rate"),
        F.min("rate").alias("min_rate"),
        F.sum(F.when(is_struct, F.col("n_miss")).otherwise(0)).alias("struct_miss"),
        F.array_sort(F.collect_list(F.when(is_struct, F.col("level")))).alias("gate_values"),
        F.first("tot_miss").alias("tot_miss"), F.first("hi").alias("hi"), F.first("lo").alias("lo"),
        F.first("gap_min").alias("gap_min"), F.first("expl_min").alias("expl_min"))
    explained = F.col("struct_miss") / F.col("tot_miss")
    ok = g.withColumn("explained", explained).where(
        (F.col("n_groups") >= 2) & (F.col("max_rate") >= F.col("hi")) & (F.col("min_rate") <= F.col("lo"))
        & ((F.col("max_rate") - F.col("min_rate")) >= F.col("gap_min")) & (F.size("gate_values") > 0)
        & (F.col("explained") >= F.col("expl_min")))
    ok = ok.withColumn("score", F.col("explained") * 10.0 + (F.col("max_rate") - F.col("min_rate")))
    w = Window.partitionBy("target").orderBy(F.col("score").desc(), "gate_ord")
    return ok.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        "target", "target_numeric", F.col("gate").alias("gate_col"), "gate_values", "explained",
        "max_rate", "min_rate", "score")


@dataclass(frozen=True)
class Rule:
    target: str
    gate_col: str
    gate_values: tuple[str, ...]


def find_rules(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str],
               gates: Sequence[str], n_rows: int) -> dict[str, Rule]:
    if not gates:
        return {}
    targets = {**{c: True for c in continuous}, **{c: False for c in categorical}}
    rows = collect_bounded(structural_rules(gate_missing_rates(df, gates, targets), min_group_size(n_rows)),
                           MAX_RULES, "structural rules")
    return {r.target: Rule(r.target, r.gate_col, tuple(r.gate_values)) for r in rows}


def _gate_key(rule: Rule) -> Column:
    return F.coalesce(F.col(rule.gate_col).cast("string"), F.lit(NA_LEVEL))


def impute(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str],
           rules: dict[str, Rule], keep: Sequence[str] = (), real: bool = True) -> DataFrame:
    """I3-I5 (``real=False`` stops after the structural fill, I3).

    numeric: structural missing -> 0.0; the rest -> median of non-null values
    outside the structural gate levels; if none, the global median after the
    structural fill; if none, 0.0.  categorical: structural -> 'Inapplicable',
    other null / blank -> 'Missing'; text output.
    """
    exprs: dict[str, Column] = {}
    med_inputs = []
    for c in continuous:
        x = F.col(c) if is_numeric_type(df.schema[c].dataType) else F.col(c).cast("string").try_cast("double")
        x = x.cast("double")
        rule = rules.get(c)
        if rule is not None:
            in_gate = _gate_key(rule).isin(list(rule.gate_values))
            filled = F.when(x.isNull() & in_gate, F.lit(0.0)).otherwise(x)
            med_inputs.append(F.struct(F.lit(c).alias("t"), F.lit("app").alias("kind"),
                                       F.when(~in_gate, x).alias("x")))
        else:
            filled = x
        med_inputs.append(F.struct(F.lit(c).alias("t"), F.lit("all").alias("kind"), filled.alias("x")))
        exprs[c] = filled
    medians: dict[tuple[str, str], float] = {}
    if med_inputs and real:
        long = df.select(F.explode(F.array(*med_inputs)).alias("m")).select("m.*")
        for r in collect_bounded(quantiles(long, ["t", "kind"], "x", [0.5]), MAX_RULES, "medians"):
            medians[(r["t"], r["kind"])] = r["q50"]
    out_cols = [F.col(k) for k in keep]
    for c in continuous:
        if not real:
            out_cols.append(exprs[c].alias(c))
            continue
        m = medians.get((c, "app")) if c in rules else None
        if m is None or not math.isfinite(m):
            m = medians.get((c, "all"))
        if m is None or not math.isfinite(m):
            m = 0.0
        out_cols.append(F.coalesce(exprs[c], F.lit(float(m))).alias(c))
    for c in categorical:
        col = F.col(c)
        miss = is_blank(col)
        rule = rules.get(c)
        v = F.when(miss, F.lit("Missing")).otherwise(col.cast("string"))
        if rule is not None:
            v = F.when(miss & _gate_key(rule).isin(list(rule.gate_values)), F.lit("Inapplicable")).otherwise(v)
        out_cols.append(v.alias(c))
    return df.select(*out_cols)


def imputation_report(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str],
                      rules: dict[str, Rule]) -> DataFrame:
    """Rows filled per column and kind (structural / real) in one aggregation."""
    aggs = []
    for c in list(continuous) + list(categorical):
        numeric = c in continuous
        miss = _missing_flag(df, c, numeric)
        rule = rules.get(c)
        st = miss & _gate_key(rule).isin(list(rule.gate_values)) if rule else F.lit(False)
        aggs.append(F.count(F.when(st, 1)).alias(f"{c}__structural"))
        aggs.append(F.count(F.when(miss & ~st, 1)).alias(f"{c}__real"))
    wide = df.agg(*aggs)
    cells = []
    for c in list(continuous) + list(categorical):
        rule = rules.get(c)
        cells.append(F.struct(F.lit(c).alias("field"), F.lit(rule.gate_col if rule else None).cast("string").alias("gate_col"),
                              F.col(f"{c}__structural").alias("n_structural"),
                              F.col(f"{c}__real").alias("n_real")))
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def zscore_params(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """I7 constants: mean and population std per column (one wide aggregation)."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).collect()[0]
    out = {}
    for i, c in enumerate(columns):
        mu, sd = row[f"a{i}"], row[f"s{i}"]
        mu = 0.0 if mu is None else float(mu)
        sd = 1.0 if (sd is None or not math.isfinite(sd) or sd < 10 * 2.220446049250313e-16) else float(sd)
        out[c] = (mu, sd)
    return out


def zscore(df: DataFrame, columns: Sequence[str], params: dict[str, tuple[float, float]] | None = None,
           keep: Sequence[str] | None = None) -> DataFrame:
    """``(x - mean) / population std``; zero variance -> divisor 1."""
    params = params or zscore_params(df, columns)
    keep = [c for c in df.columns if c not in columns] if keep is None else list(keep)
    return df.select(*keep, *[((F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c)
                              for c in columns])


def assemble_features(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str],
                      id_col: str = "hid") -> DataFrame:
    """I8: ``(hid, num array<double>, cat array<string>)``; numerics then categoricals."""
    fields = list(continuous) + list(categorical)
    if not fields:
        raise ValueError("no features: continuous and categorical lists are both empty")
    missing = [c for c in fields if c not in df.columns]
    if missing:
        raise KeyError(missing)
    num = F.array(*[F.col(c).cast("double") for c in continuous]) if continuous else F.array().cast("array<double>")
    cat = F.array(*[F.col(c).cast("string") for c in categorical]) if categorical else F.array().cast("array<string>")
    return df.select(F.col(id_col), num.alias("num"), cat.alias("cat"))
