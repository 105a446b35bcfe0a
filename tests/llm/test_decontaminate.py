import duckdb
from helpers import SF, docs
from pyspark.sql import functions as F

from hearth.llm.decontaminate import OP5_SQL, decontaminate, find_contained, op5_decontamination


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.sql(OP5_SQL).fetchall())
    got = sorted(tuple(r) for r in op5_decontamination(spark, SF).select("doc_id", "item_id", "shared", "item_shingles", "containment").collect())
    assert got == want and want


def test_containment_at_the_threshold(spark):
    item = [f"w{i}" for i in range(14)]  # ten shingles
    held = " ".join(["pad"] * 3000 + item[:12] + ["pad"] * 3000)   # eight of them
    less = " ".join(["pad"] * 3000 + item[:11] + ["pad"] * 3000)   # seven
    apart = " ".join(item[:8] + ["x"] + item[4:14])                # all but two, in two places
    d = docs(spark, [(1, held), (2, less), (3, apart), (4, held), (4, held), (5, " ".join(item).upper())])
    got = find_contained(d, items(spark, [(7, " ".join(item)), (8, "other words that are nowhere to be found")]))
    assert {(r["doc_id"], r["item_id"], r["shared"]) for r in got.collect()} == {(1, 7, 8), (3, 7, 10), (4, 7, 8), (5, 7, 10)}


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta"
    rows = [(1, item), (2, None), (3, ""), (None, "x " + item), (5, "two words"), (6, "y " * 30000 + item), (1, "clean text under an id in use")]
    d = docs(spark, rows).withColumn("text_hash", F.lit(0)).withColumn("h", F.lit("c"))
    its = items(spark, [(1, item), (1, item), (2, None), (3, ""), (4, "two words"), (None, "two words")])
    left = decontaminate(d, its)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("1", "clean text under an id in use"), ("2", None), ("3", "")]
    assert left.columns == d.columns
    assert decontaminate(d, items(spark, [])).count() == len(rows)
    assert decontaminate(docs(spark, []), its).count() == 0
