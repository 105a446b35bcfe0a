"""Exact top-k inner-product search by columnar branch and bound.

Candidates and queries meet in a grid of bounded blocks, so nothing is
broadcast or collected.  Inside a block the candidates lie in vertical layout,
one contiguous slab per group of dimensions.  Partial products are accumulated
slab by slab; the norms of the dimensions still to come bound what a candidate
may yet gain or lose, and candidates that can no longer reach a query's k-th
best are dropped from the slabs that follow.  Survivors get their exact integer
score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearth.llm.common import table
from hearth.llm.registry import register

FOUND = "query_id long, query_hash long, vec_id long, score long"


def quantise(embedding: Column) -> Column:
    """floor(256 * x) of each component; null if any component is null or not finite."""
    x = embedding.cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(good, F.transform(x, lambda v: F.floor(F.lit(256.0) * v)))


def branch_and_bound(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                     slab: int = 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the (ids, scores) of its ``k`` best candidates, ties to the
    smaller id; a candidate with the query's own id is left out."""
    n, d = vectors.shape
    # dimensions in which much can be decided go first
    weight = np.abs(queries).mean(axis=0) * np.abs(vectors).mean(axis=0) if n and len(queries) else np.zeros(d)
    order = np.argsort(-weight, kind="stable")
    x, q = vectors[:, order].astype(np.float64), queries[:, order].astype(np.float64)
    cuts = list(range(0, d, slab)) or [0]
    slabs = [np.ascontiguousarray(x[:, c:c + slab]) for c in cuts]
    x_left = [np.sqrt((x[:, c + slab:] ** 2).sum(axis=1)) for c in cuts]
    q_left = [np.sqrt((q[:, c + slab:] ** 2).sum(axis=1)) for c in cuts]
    # floating sums are off by far less than this; the exact score decides at the end
    slack = 1e-9 * (1.0 + np.sqrt((q ** 2).sum(axis=1)) * (np.sqrt((x ** 2).sum(axis=1)).max() if n else 0.0))
    out = []
    for i in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[i])
        part = np.zeros(len(alive))
        for b, c in enumerate(cuts):
            part = part + slabs[b][alive] @ q[i, c:c + slab]
            if len(alive) > k:
                room = q_left[b][i] * x_left[b][alive]
                floor = np.partition(part - room, len(part) - k)[len(part) - k]
                keep = part + room >= floor - slack[i]
                if not keep.all():
                    alive, part = alive[keep], part[keep]
        exact = vectors[alive] @ queries[i]
        best = np.lexsort((ids[alive], -exact))[:k]
        out.append((ids[alive][best], exact[best]))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, candidate_block: int = 8192,
          query_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors(vec_id long,
    v array<long>)`` that ``is_query`` marks: the ``k`` largest integer inner
    products over all rows with another vec_id and the same number of
    components, ties to the smaller vec_id; fewer where fewer exist.

    Rows with a null vec_id or a null ``v`` take no part.  Repeated candidate
    rows are candidates each; repeated query rows (same id, same vector) are
    one query.  No rows give none."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).withColumn("d", F.size("v"))
    asked = rows.where(is_query).dropDuplicates(["vec_id", "v"])
    n, m = rows.count(), asked.count()
    blocks, sheets = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    h = F.xxhash64("vec_id", "v")
    cand = (rows.withColumn("block", F.pmod(h, F.lit(blocks)).cast("int"))
            .withColumn("sheet", F.explode(F.sequence(F.lit(0), F.lit(sheets - 1)))))
    ask = (asked.withColumn("h", h).withColumn("sheet", F.pmod("h", F.lit(sheets)).cast("int"))
           .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query_hash": [], "vec_id": [], "score": []}
        if len(c) and len(a):
            found = branch_and_bound(c["vec_id"].to_numpy(np.int64), np.array(c["v"].tolist(), dtype=np.int64).reshape(len(c), -1),
                                     a["vec_id"].to_numpy(np.int64), np.array(a["v"].tolist(), dtype=np.int64).reshape(len(a), -1), k)
            for qid, qh, (ids, scores) in zip(a["vec_id"], a["h"], found):
                out["query_id"] += [qid] * len(ids)
                out["query_hash"] += [qh] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out, dtype="int64")

    keys = ["d", "block", "sheet"]
    local = cand.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(search, FOUND)
    best = W.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@register("op4_top_k_search", OP4_SQL)
def op4_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vec_id divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantise(F.col("embedding")).alias("v"))
    return top_k(rows, F.col("vec_id") % 50 == 0)
