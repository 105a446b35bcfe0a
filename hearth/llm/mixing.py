"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks (by a hash of the row) and each epoch of a
source is one permutation of its blocks, so a source's share of the mix is a
run of block slots: whole epochs, then the first blocks of one more epoch, the
last of them in part.  The slot quotas of all sources stand at the root of a
binary tree over the output shards; every node draws how many slots of each
source go left from the multivariate hypergeometric law (sources one after
another, each hypergeometric given those before), the rest go right.  A leaf
takes its own disjoint run of every source's slots.  Inside a shard rows are
ordered by a hash.

DataFrame functions only; what is collected or broadcast is one row per source
or per block, and blocks are at most ``max_blocks`` besides one per source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearth.llm.common import WORD, fresh, table
from hearth.llm.registry import register
from hearth.session import cut_lineage

BROADCAST_ROWS = 200_000  # narrow rows that may be broadcast; more are joined by shuffle
BOUNDARY_ROWS = 2000      # documents among which the last, partial block is filled one by one


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and marked for broadcast if it has few rows."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, src int from 0, source_size, weight, target) from
    ``sizes(source, source_size)``.  Sources in code point order, null last,
    weigh ``weights`` in turn.  Targets share the total by weight; none exceeds
    ``most`` times its source's size, the excess goes to the others by weight."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    rows = (sizes.withColumn("src", F.row_number().over(order) - 1)
            .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("src") % len(weights)))
            .withColumn("cap", F.col("source_size") * float(most)))
    all_rows = W.partitionBy(F.lit(0))
    # in order of cap per weight the capped sources come first; a row's level is
    # the words per weight left to it and those behind, were all before it capped
    filling = W.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(W.unboundedPreceding, -1)
    rows = (rows.withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(filling), F.lit(0.0)))
                            / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))))
            .withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
            .withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(all_rows)))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return rows.select("source", "src", "source_size", "weight", target.alias("target"))


# ------------------------------------------------------------- the splitting tree

def _steps(low: Column, high: Column) -> Column:
    """low+1 .. high (none if high <= low)."""
    return F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<long>"))


def _let(values: Sequence[Column], body: Callable[..., Column]) -> Column:
    """``body`` over the values, each evaluated once (a name put into a lambda
    as an expression would be evaluated at every step of a fold)."""
    bound = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(bound, lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))


def hypergeometric(kind: Column, draws: Column, pool: Column, u: Column) -> Column:
    """How many of ``kind`` among ``pool`` slots are met in ``draws`` draws
    without return, by inverting the distribution at ``u``.  The weights follow
    from their ratios, summed as logarithms so that nothing under- or overflows;
    three passes over the support."""
    zero = F.lit(0.0)

    def draw(kind: Column, draws: Column, pool: Column, u: Column, low: Column, steps: Column) -> Column:
        def log_ratio(x: Column) -> Column:  # weight of x over weight of x - 1
            return F.log(((kind - x + 1) * (draws - x + 1)).cast("double") / (x * (pool - kind - draws + x)).cast("double"))

        def grown(a: Column, x: Column) -> Column:
            return a["l"] + log_ratio(x)

        def walk(top: Column, goal: Column) -> Column:
            """Sums weights from ``low`` on; x stops where the sum first passes ``goal``."""
            return F.aggregate(steps, F.struct(zero.alias("l"), F.exp(-top).alias("s"), low.alias("x")),
                               lambda a, x: _let([grown(a, x)], lambda l: F.struct(
                                   l.alias("l"), (a["s"] + F.exp(l - top)).alias("s"), F.when(a["s"] < goal, x).otherwise(a["x"]).alias("x"))))
        top = F.aggregate(steps, F.struct(zero.alias("l"), zero.alias("m")),
                          lambda a, x: _let([grown(a, x)], lambda l: F.struct(l.alias("l"), F.greatest(a["m"], l).alias("m"))),
                          lambda a: a["m"])
        return _let([top], lambda t: _let([walk(t, F.lit(float("inf")))["s"] * u], lambda goal: walk(t, goal)["x"]))

    low = F.greatest(F.lit(0).cast("long"), draws - (pool - kind))
    return _let([kind, draws, pool, u, low, _steps(low, F.least(kind, draws))], draw)


def _draw_left(node: Column, quotas: Column, draws: Column, seed: int) -> Column:
    """Slots of each source that go left: one multivariate hypergeometric draw."""
    pool = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(draws.alias("n"), pool.alias("pool"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        # what the source before took is settled here, so that each draw is made once
        n = acc["n"] - F.when(i > 0, F.get(acc["out"], i - 1)).otherwise(F.lit(0).cast("long"))
        left = acc["pool"] - F.when(i > 0, F.get(quotas, i - 1)).otherwise(F.lit(0).cast("long"))
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, i), 11).cast("double") * F.lit(2.0 ** -53)
        return F.struct(n.alias("n"), left.alias("pool"),
                        F.array_append(acc["out"], hypergeometric(F.get(quotas, i), n, left, u)).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(quotas) - 1), start, step, lambda a: a["out"])


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(src, shard, first, slots) from ``quotas(src int from 0, slots long)``:
    which run of each source's slots every shard takes.  Shard totals differ by
    at most one slot; the counts are a multivariate-hypergeometric draw."""
    root = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "slots"))), lambda s: s["slots"].cast("long")).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
    tree = root.where(F.size("q") > 0).select(
        F.lit(0).alias("low"), F.lit(shards).alias("high"), F.lit(1).cast("long").alias("node"), "q",
        F.transform("q", lambda x: F.lit(0).cast("long")).alias("at"), total.alias("total"))
    depth = max(0, (shards - 1).bit_length())
    for _ in range(depth):
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")

        def edge(j: Column) -> Column:
            return F.floor(j.cast("long") * F.col("total") / shards).cast("long")
        drawn = tree.withColumn("left", F.when(F.col("high") - F.col("low") > 1, _draw_left(
            F.col("node"), F.col("q"), edge(mid) - edge(F.col("low")), seed)))
        drawn = cut_lineage(drawn)  # one row per node; the draws of a level are made once

        def child(low, high, node, q, at):
            return F.struct(low.alias("low"), high.alias("high"), node.alias("node"), q.alias("q"), at.alias("at"))
        both = F.array(
            child(F.col("low"), mid, F.col("node") * 2, F.col("left"), F.col("at")),
            child(mid, F.col("high"), F.col("node") * 2 + 1, F.zip_with("q", "left", lambda a, b: a - b),
                  F.zip_with("at", "left", lambda a, b: a + b)))
        same = F.array(child(F.col("low"), F.col("high"), F.col("node"), F.col("q"), F.col("at")))
        tree = drawn.select(F.explode(F.when(F.col("left").isNotNull(), both).otherwise(same)).alias("c"), "total").select("c.*", "total")
    return (tree.select(F.col("low").alias("shard"), F.posexplode(F.arrays_zip(F.col("at").alias("first"), F.col("q").alias("slots"))).alias("src", "r"))
            .select("src", "shard", F.col("r.first").alias("first"), F.col("r.slots").alias("slots")).where(F.col("slots") > 0))


# ------------------------------------------------------------- rows of the mix

def _fill(pool: DataFrame) -> DataFrame:
    """Of the last blocks' documents ``pool(src, left, r, doc_id, size)``, those
    taken so that each source gets about ``left`` more words: by hashed
    sub-blocks as long as a pool is large, then one by one, the largest that
    still fits first, and one document over if that is nearer than none.  Equal
    documents are a unit of ``n`` copies, of which ``m`` are taken."""
    units = cut_lineage(pool.where((F.col("size") > 0) & (F.col("left") > 0))
                        .groupBy("src", "left", "r", "doc_id", "size").agg(F.count("*").alias("n")))
    taken: list[DataFrame] = []
    level = 0
    while (units.groupBy("src").count().agg(F.max("count")).first()[0] or 0) > BOUNDARY_ROWS:
        level += 1
        subs = units.withColumn("sub", F.pmod(F.xxhash64("r", "doc_id", F.lit(level)), F.lit(64)))
        order = W.partitionBy("src").orderBy("sub").rowsBetween(W.unboundedPreceding, 0)
        sums = (subs.groupBy("src", "left", "sub").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
                .withColumn("upto", F.sum("words").over(order)))
        subs = subs.join(_small(sums.select("src", "sub", "words", "upto")), ["src", "sub"])  # 64 rows per source
        subs = cut_lineage(subs)
        taken.append(subs.where(F.col("upto") <= F.col("left")).select("src", "r", "doc_id", "size", "n", F.col("n").alias("m")))
        edge = subs.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") < F.col("left")))
        units = cut_lineage(edge.select("src", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "r", "doc_id", "size", "n"))
    unit = F.struct((-F.col("size")).alias("w"), "r", "doc_id", "n")
    lists = units.groupBy("src", "left").agg(F.array_sort(F.collect_list(unit)).alias("d"))
    kind = "array<struct<w:bigint,r:bigint,doc_id:bigint,n:bigint,m:bigint>>"
    start = F.struct(F.col("left").cast("double").alias("rest"), F.array().cast(kind).alias("take"))

    def fit(a: Column, x: Column) -> Column:
        def put(m: Column) -> Column:
            return F.struct((a["rest"] + x["w"] * m).alias("rest"),
                            F.array_append(a["take"], F.struct(x["w"].alias("w"), x["r"].alias("r"), x["doc_id"].alias("doc_id"), x["n"].alias("n"), m.alias("m"))).alias("take"))
        return _let([F.least(x["n"], F.floor(a["rest"] / -x["w"])).cast("long")], put)
    lists = cut_lineage(lists.withColumn("f", F.aggregate("d", start, fit)))
    # the smallest document left out, if with it the sum is nearer
    out = F.element_at(F.filter("f.take", lambda t: t["m"] < t["n"]), -1)
    more = F.transform("f.take", lambda t: F.struct(
        (-t["w"]).alias("size"), t["r"].alias("r"), t["doc_id"].alias("doc_id"), t["n"].alias("n"),
        (t["m"] + F.when((t["r"] == F.col("last.r")) & (t["w"] == F.col("last.w")) & t["doc_id"].eqNullSafe(F.col("last.doc_id"))
                         & (-t["w"] < 2 * F.col("f.rest")), 1).otherwise(0)).alias("m")))
    lists = lists.withColumn("last", F.when(F.exists("f.take", lambda t: t["m"] < t["n"]), out))
    one = (lists.select("src", F.explode(more).alias("x")).select("src", "x.r", "x.doc_id", "x.size", "x.n", "x.m").where(F.col("m") > 0))
    for t in taken:
        one = one.unionByName(t)
    return one


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, shards: int = 40,
        block_words: int = 20_000, max_blocks: int = 65_536, seed: int = 23) -> DataFrame:
    """All rows of ``docs(doc_id, text, source, ...)`` with size, source_size,
    target, placements: one (epoch, shard, order_key) for each time the mix
    takes the row, at most ``ceil(most)`` times.  Exploded placements are the
    mix; within a shard, ``order_key`` is its shuffled order.

    The size of a document is its number of words (null text: 0), a row of size
    0 is placed like the others of its block.  The words taken of a source miss
    its target by less than half of its smallest document left out.  A null
    source is a source of its own, a null doc_id is an id like any other.  Rows
    that agree in doc_id, source and text stand in one block; where only a part of the
    block is taken, so many of them are as fit.  No rows: no rows.
    The result depends on rows and seed only.  Columns of ``docs`` called like
    an output column are replaced."""
    new = ("size", "source_size", "target", "placements")
    base = docs.drop(*[c for c in docs.columns if c.lower() in new])
    r, block, src = (fresh(base, c) for c in ("mix_r", "mix_block", "mix_src"))
    sized = (base.withColumn("size", word_count(F.col("text")))
             .withColumn(r, F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "size", F.col("text").cast("string"))))
    narrow = cut_lineage(sized.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), "size", F.col(r).alias("r")))

    sizes = narrow.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = cut_lineage(source_targets(sizes, weights, most))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    per_block = max(block_words, -(-total // max_blocks))
    sources = _small(sources.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / per_block)))
                     # a quotient that rounding leaves just under a whole number of epochs is that number
                     .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(F.lit(0)).cast("long"))
                     .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size"))))
    placed = narrow.join(sources.select(F.col("source").alias("s"), "src", "blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("block", F.pmod("r", F.col("blocks")))

    # the permutations: slots of the whole epochs, then of the partial one up to its last block
    blocks = cut_lineage(placed.groupBy("src", "block").agg(F.sum("size").cast("long").alias("words")))
    every = (blocks.join(sources, "src")
             .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))))
    shuffled = W.partitionBy("src", "epoch").orderBy(F.xxhash64(F.lit(seed), "src", "epoch", "block"), "block")
    slots = (every.withColumn("p", F.row_number().over(shuffled) - 1)
             .withColumn("upto", F.sum("words").over(shuffled.rowsBetween(W.unboundedPreceding, 0)))
             .withColumn("there", F.count("*").over(W.partitionBy("src", "epoch")))
             .withColumn("before", F.col("upto") - F.col("words")))
    slots = slots.withColumn("whole", (F.col("epoch") < F.col("full")) | (F.col("upto") <= F.col("rest")))
    slots = slots.where(F.col("whole") | (F.col("before") < F.col("rest")))
    slots = cut_lineage(slots.select("src", "block", "epoch", "whole", (F.col("epoch") * F.col("there") + F.col("p")).alias("slot"),
                                     (F.col("rest") - F.col("before")).alias("left")))

    quotas = sources.select("src").join(slots.groupBy("src").agg(F.count("*").alias("slots")), "src", "left").fillna(0, ["slots"])
    runs = split_quotas(quotas, shards, seed)
    owned = runs.select("src", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("slot"))
    places = _small(slots.join(owned, ["src", "slot"]).groupBy("src", "block")
                    .agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "whole"))).alias("places")))

    # documents of the last, partial blocks
    edge = _small(slots.where(~F.col("whole")).select("src", "block", "left"))
    chosen = _small(_fill(placed.join(edge, ["src", "block"]).select("src", "left", "r", "doc_id", "size"))
                    .select(F.col("src").alias("c_src"), F.col("r").alias("c_r"), F.col("doc_id").alias("c_doc"),
                            F.col("size").alias("c_size"), F.col("n").alias("c_n"), F.col("m").alias("c_m")))

    out = (sized.alias("d").join(sources.select(F.col("source").alias("m_source"), F.col("src").alias("m_src"), F.col("blocks").alias("m_blocks"),
                                                "source_size", "target"), F.col("source").cast("string").eqNullSafe(F.col("m_source")))
           .withColumn("m_block", F.pmod(F.col(r), F.col("m_blocks")))
           .join(places.select(F.col("src").alias("p_src"), F.col("block").alias("p_block"), "places"),
                 (F.col("m_src") == F.col("p_src")) & (F.col("m_block") == F.col("p_block")), "left")
           .join(chosen, (F.col("m_src") == F.col("c_src")) & (F.col(r) == F.col("c_r")) & (F.col("size") == F.col("c_size"))
                 & F.col("doc_id").cast("long").eqNullSafe(F.col("c_doc")), "left"))

    def placed_rows(rows: DataFrame, in_part: Column) -> DataFrame:
        mine = F.filter(F.coalesce("places", F.array().cast("array<struct<epoch:bigint,shard:int,whole:boolean>>")), lambda p: p["whole"] | in_part)
        placements = F.transform(mine, lambda p: F.struct(p["epoch"].alias("epoch"), p["shard"].alias("shard"),
                                                          F.xxhash64(F.lit(seed), p["shard"], p["epoch"], F.col(r)).alias("order_key")))
        return rows.select(*[F.col(c) for c in base.columns], "size", "source_size", "target", placements.alias("placements"))
    partly = F.coalesce(F.col("c_m") < F.col("c_n"), F.lit(False))
    keep = out.select(*[F.col(f"d.{c}") for c in base.columns], F.col(f"d.{r}").alias(r), "size", "source_size", "target", "places", "c_src", "c_n", "c_m")
    if chosen.where(F.col("c_m") < F.col("c_n")).isEmpty():
        return placed_rows(keep, F.col("c_m").isNotNull())
    # equal rows of which some are taken: those that come first, counted over the partitions
    some = cut_lineage(keep.where(partly).withColumn(block, F.spark_partition_id()))
    there = some.groupBy("c_src", r, "size", F.col("doc_id").cast("long").alias("e_doc"), block).agg(F.count("*").alias("e_n"))
    before = W.partitionBy("c_src", r, "size", "e_doc").orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    there = _small(there.withColumn("e_before", F.coalesce(F.sum("e_n").over(before), F.lit(0))).select(
        F.col("c_src").alias("e_src"), F.col(r).alias("e_r"), F.col("size").alias("e_size"), "e_doc", F.col(block).alias("e_block"), "e_before"))
    place = F.row_number().over(W.partitionBy("c_src", r, "size", "doc_id", block).orderBy(F.lit(0)))
    ranked = some.withColumn(src, place).join(there, (F.col("c_src") == F.col("e_src")) & (F.col(r) == F.col("e_r")) & (F.col("size") == F.col("e_size"))
                                              & F.col("doc_id").cast("long").eqNullSafe(F.col("e_doc")) & (F.col(block) == F.col("e_block")))
    return (placed_rows(keep.where(~partly), F.col("c_m").isNotNull())
            .unionByName(placed_rows(ranked, F.col(src) + F.col("e_before") <= F.col("c_m"))))


def mixed_rows(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: the rows of ``docs`` (its columns only), each as often as it is taken."""
    row = fresh(docs, "row")
    packed = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias(row))
    return mix(packed, **params).select(row, F.explode("placements")).select(f"{row}.*")


@register("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each with the words that the mix takes of it."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.size("placements") * F.col("size")).cast("long").alias("taken"))
