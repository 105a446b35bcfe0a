"""Shared statistical building blocks.

* ``melt``           wide table -> long ``(ord, x)`` rows of one type (one row per cell)
* ``value_counts``   wide table -> one ``(ord, x, cnt)`` table per type; map-side combined,
                     so a hot value never reaches the shuffle as many rows
* ``quantiles``      exact linear-interpolated quantiles (pandas / DuckDB
                     ``quantile_cont`` semantics) per group
* ``collect_bounded`` bring a table to the driver only under a stated row bound
* ``small_table``    a few rows of the driver as a table, without Python on the executors
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_
from typing import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType, T.BooleanType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a table that is small by construction; refuse if the bound is broken."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows, not collected to the driver")
    return rows


SMALL_CELLS = 2_000


def small_table(spark, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """``createDataFrame`` for a few rows: as literals, since each such table else starts
    Python workers in every task that reads it.  More cells than that go the usual way."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not rows or len(rows) * len(schema) > SMALL_CELLS:
        return spark.createDataFrame(rows, schema)
    cells = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema)]) for r in rows]
    return spark.sql("SELECT 1").select(F.inline(F.array(*cells)))


def py_round(x: float) -> int:
    """Python's round(): half to even."""
    return int(round(x))


def melt(df: DataFrame, columns: Sequence[tuple[int, str]], cast: str) -> DataFrame:
    """Wide -> long: ``(ord, x)``, one row per cell of the ``(ord, name)`` columns, as type ``cast``."""
    cells = [F.struct(F.lit(i).alias("ord"), F.col(c).cast(cast).alias("x")) for i, c in columns]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _count_type(dt: T.DataType) -> str:
    """Type that keeps the values of ``dt`` apart as their texts do, at the least width."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "long"
    return "double" if isinstance(dt, (T.FloatType, T.DoubleType)) else "string"


def value_counts(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Rows per distinct non-null value of every column: one table ``(ord, x, cnt)`` for each
    type that occurs, so that numbers are counted as numbers and not as texts."""
    types = {f.name: _count_type(f.dataType) for f in df.schema.fields}
    out = []
    for cast in ("long", "double", "string"):
        mine = [(i, c) for i, c in enumerate(columns) if types[c] == cast]
        if mine:
            # grouping takes -0.0 for 0.0, their texts differ
            sign = [F.when(F.col("x") == 0, F.col("x").cast("string") == "-0.0").alias("sign")] if cast == "double" else []
            out.append(melt(df, mine, cast).where(F.col("x").isNotNull()).groupBy("ord", "x", *sign)
                       .agg(F.count(F.lit(1)).alias("cnt")).select("ord", "x", "cnt"))
    return out


MAX_EXACT_DISTINCT = 200_000
REFINE_BUCKETS = 64


def group_sizes(x: str) -> list[Column]:
    """Size and range of a group as ``quantiles`` takes them: without nulls and NaN."""
    value = F.when(~F.isnan(F.col(x).cast("double")), F.col(x))
    return [F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")]


def quantiles(df: DataFrame, keys: Sequence[str], x: str, probs: Iterable[float], prefix: str = "q",
              max_exact: int = MAX_EXACT_DISTINCT, buckets: int = REFINE_BUCKETS, sizes: Sequence | None = None) -> DataFrame:
    """Exact linear quantiles of ``x`` per ``keys`` (pandas / DuckDB
    ``quantile_cont`` semantics) with bounded per-task state.

    Groups of at most ``max_exact`` rows use Spark's exact ``percentile``.  For all
    larger groups and all probabilities together, two more passes over the rows: a
    histogram of equal steps brackets every quantile between two values and counts the rows
    below, and those inside are grouped by value and ranked.  Where outliers leave more than
    four rows in ``buckets`` inside, a sketch brackets those groups instead, and one pass counts the
    rows outside.  Only group sizes, histograms, brackets and the chosen values reach the driver.
    ``sizes``: the groups' rows of ``keys`` and ``group_sizes``, where a pass of the caller has them already.
    """
    probs, keys = list(probs), list(keys)
    names = [f"{prefix}{int(round(p * 100)):02d}" for p in probs]
    # NaN counts as missing
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*keys, F.col(x).alias("_x"))
    if sizes is None:
        sizes = collect_bounded(rows.groupBy(*keys).agg(*group_sizes("_x")), 1_000_000, "quantile group sizes")
    sizes = [r for r in sizes if r["n"]]
    big = [r for r in sizes if r["n"] > max_exact]
    small_rows = rows
    if big:
        spark = df.sparkSession
        group = T.StructType([rows.schema[k] for k in keys])
        named = T.StructType([T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(group)])
        of_big = F.broadcast(small_table(spark, [tuple(r[k] for k in keys) for r in big], named))
        small_rows = rows.join(of_big, _same_group(keys), "left_anti")
    arr = F.percentile(F.col("_x"), F.array(*[F.lit(float(p)) for p in probs]))
    small = small_rows.groupBy(*keys).agg(arr.alias("_qs")).select(
        *keys, *[F.col("_qs")[i].alias(n) for i, n in enumerate(names)])
    if not big:
        return small
    found = _big_group_quantiles(spark, rows, keys, named, big, probs, buckets)
    extra = small_table(spark, [tuple(r[k] for k in keys) + tuple(q) for r, q in zip(big, found)], small.schema)
    return extra if len(big) == len(sizes) else small.unionByName(extra)


def _same_group(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cond


MAX_STEPS = 400_000   # histogram steps of all groups together
STEPS = 4096          # and of one group
FEW_GROUPS = 64       # so many groups are told apart without a join


def _big_group_quantiles(spark, rows: DataFrame, keys, named: T.StructType, big, probs, buckets: int) -> list[list[float]]:
    """The quantiles of each group of ``big`` (its size and range)."""
    many = range(len(probs))
    ranks = [[(int(math.floor(p * (g["n"] - 1))), min(int(math.floor(p * (g["n"] - 1))) + 1, g["n"] - 1)) for p in probs] for g in big]
    ends = [[[float(g["lo"]), float(g["hi"])] for _ in many] for g in big]
    below = [[0] * len(probs) for _ in big]

    def joined(only: Iterable[int], fields: list[str], of: Callable[[int], list[float]]) -> DataFrame:
        only = list(only)
        if len(only) <= FEW_GROUPS:  # no join: the group's number and constants are expressions
            number, consts = F.lit(None).cast("int"), {at: of(at) for at in only}
            for at in only:
                mine = reduce(and_, [F.col(k).eqNullSafe(F.lit(big[at][k])) for k in keys], F.lit(True))
                number = F.coalesce(number, F.when(mine, F.lit(at))) if at != only[0] else F.when(mine, F.lit(at))
            pick = [F.array(*[F.lit(consts[at][j] if at in consts else 0.0) for at in range(len(big))])[F.col("_g")].alias(f)
                    for j, f in enumerate(fields)]
            return rows.withColumn("_g", number).where(F.col("_g").isNotNull()).select("*", *pick)
        schema = T.StructType([T.StructField("_g", T.IntegerType()), *named, *[T.StructField(f, T.DoubleType()) for f in fields]])
        table = [(at, *[big[at][k] for k in keys], *of(at)) for at in only]
        return rows.join(F.broadcast(small_table(spark, table, schema)), _same_group(keys))

    def bracketed(only: Iterable[int]) -> DataFrame:
        return joined(only, [f"_e{i}_{side}" for i in many for side in (0, 1)], lambda at: [e for pair in ends[at] for e in pair])

    def end(i: int, side: int) -> Column:
        return F.col(f"_e{i}_{side}")
    # groups of one value are bracketed by it; a range that is not finite has no equal steps
    wide = [at for at in range(len(big)) if float(big[at]["lo"]) != float(big[at]["hi"])]
    stepped = [at for at in wide if math.isfinite(float(big[at]["hi"]) - float(big[at]["lo"]))]
    rest = set(wide) - set(stepped)
    if stepped:
        steps = max(16, min(STEPS, MAX_STEPS // len(stepped)))
        x = F.col("_x").cast("double")
        step = F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * steps), F.lit(steps - 1))
        table = joined(stepped, ["_lo", "_hi"], lambda at: [float(big[at]["lo"]), float(big[at]["hi"])]).groupBy("_g", step.alias("_b")).agg(
            F.count(F.lit(1)).alias("_w"), F.min(x).alias("_min"), F.max(x).alias("_max"))
        histogram: dict[int, list] = {}
        for r in sorted(collect_bounded(table, steps * len(stepped), "histogram steps"), key=lambda r: (r["_g"], r["_b"])):
            histogram.setdefault(r["_g"], []).append(r)
        for at in stepped:
            for i in many:
                upto, inside = 0, 0
                first, last = ranks[at][i]
                for r in histogram[at]:
                    if upto <= first < upto + r["_w"]:
                        ends[at][i][0], below[at][i] = r["_min"], upto
                    upto += r["_w"]
                    if upto > first:
                        inside += r["_w"]
                    if upto > last:
                        ends[at][i][1] = r["_max"]
                        break
                if inside * buckets > 4 * big[at]["n"] and ends[at][i][0] != ends[at][i][1]:
                    rest.add(at)
    if rest:
        _sketched(big, probs, ranks, ends, below, sorted(rest), bracketed, joined, 20 * buckets)
    within = [F.col("_x").between(end(i, 0), end(i, 1)) for i in many]
    inside = F.array(*[F.when(w, F.lit(i)) for i, w in enumerate(within)])
    values = (bracketed(range(len(big))).where(reduce(or_, within)).select("_g", "_x", F.explode(inside).alias("_i")).where(F.col("_i").isNotNull())
              .groupBy("_g", "_i", "_x").agg(F.count(F.lit(1)).alias("_w")))
    want = small_table(spark, [(at, i, r - below[at][i]) for at, _ in enumerate(big) for i in many for r in sorted(set(ranks[at][i]))],
                       "_g int, _i int, _r long")
    upto = F.sum("_w").over(Window.partitionBy("_g", "_i").orderBy("_x"))
    ranked = values.withColumn("_c", upto).join(F.broadcast(want), ["_g", "_i"]).where(
        (F.col("_r") < F.col("_c")) & (F.col("_r") >= F.col("_c") - F.col("_w")))
    value = {(r["_g"], r["_i"], r["_r"] + below[r["_g"]][r["_i"]]): float(r["_x"])
             for r in collect_bounded(ranked, 2 * len(big) * len(probs), "values at ranks")}
    out = []
    for at, g in enumerate(big):
        qs = []
        for i, p in enumerate(probs):
            r, (k1, k2) = p * (g["n"] - 1), ranks[at][i]
            v1, v2 = value[at, i, k1], value[at, i, k2]
            qs.append(v1 if v1 == v2 or r == k1 else v1 + (r - k1) * (v2 - v1))
        out.append(qs)
    return out


def _sketched(big, probs, ranks, ends, below, rest: list[int], bracketed, joined, accuracy: int) -> None:
    """Brackets and rows below them, from a sketch and one counting pass, for the groups ``rest``."""
    many = range(len(probs))
    marks = [min(1.0, max(0.0, p + side * 2 / accuracy)) for p in probs for side in (-1, 1)]
    for r in collect_bounded(joined(rest, [], lambda at: []).groupBy("_g").agg(F.percentile_approx("_x", marks, accuracy).alias("marks")),
                             len(rest), "sketches"):
        ends[r["_g"]] = [[float(r["marks"][2 * i]), float(r["marks"][2 * i + 1])] for i in many]
    counted = bracketed(rest).groupBy("_g").agg(*[F.count(F.when(F.col("_x") < F.col(f"_e{i}_0"), 1)).alias(f"b{i}") for i in many],
                                                *[F.count(F.when(F.col("_x") <= F.col(f"_e{i}_1"), 1)).alias(f"u{i}") for i in many])
    for r in collect_bounded(counted, len(rest), "rows outside of brackets"):
        for i in many:
            first, last = ranks[r["_g"]][i]
            below[r["_g"]][i] = r[f"b{i}"]
            if r[f"b{i}"] > first:   # a sketch that missed: open the bracket on that side
                ends[r["_g"]][i][0], below[r["_g"]][i] = float(big[r["_g"]]["lo"]), 0
            if r[f"u{i}"] <= last:
                ends[r["_g"]][i][1] = float(big[r["_g"]]["hi"])
