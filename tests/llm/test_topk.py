import duckdb
import numpy as np
from helpers import SF
from pyspark.sql import functions as F

from hearth.llm.topk import OP4_SQL, branch_and_bound, op4_top_k_search, quantise, top_k


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.sql(OP4_SQL).fetchall())
    got = sorted(tuple(r) for r in op4_top_k_search(spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want


def test_branch_and_bound_is_exact():
    rng = np.random.default_rng(0)
    for d, low, high in ((40, -3, 4), (64, -300, 300), (1, -2, 3), (17, 0, 1)):
        x, q = rng.integers(low, high, (300, d)), rng.integers(low, high, (20, d))
        ids = rng.permutation(300)
        for i, (got, score) in enumerate(branch_and_bound(ids, x, ids[:20], q, 5)):
            s = x @ q[i]
            want = sorted((-s[j], ids[j]) for j in range(300) if ids[j] != ids[i])[:5]
            assert list(zip(-score, got)) == want


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.001, -0.001]), (3, None), (4, [1.0, None]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [9.0, 9.0]), (50, [1.0]), (100, []), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = df.select("vec_id", quantise(F.col("embedding")).alias("v"), F.lit(1).alias("score"))
    got = top_k(v, F.col("vec_id") % 50 == 0, candidate_block=2, query_block=1).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, -512), (50, 1, 7, 65536)]
    assert top_k(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0
