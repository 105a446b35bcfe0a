"""The profile's passes, and small tables without Python on the executors."""

from pyspark.sql import functions as F
from test_profile_scale import _jobs

from hearth.functions import stats as st
from hearth.operators import profile as pf


def test_a_profile_takes_few_jobs(spark):
    df = spark.range(500).select(F.col("id").alias("a"), (F.col("id") * 0.5).alias("b"), (F.col("id") % 3).cast("string").alias("c"))
    plain = _jobs(spark, "one pass", lambda: df.groupBy("c").count().collect())
    assert _jobs(spark, "profile", lambda: pf.field_profile(df)) <= 8 * plain


def test_small_tables_are_literals_of_their_types(spark):
    rows = [(None, 1.5, "a"), (2, float("nan"), None)]
    t = st.small_table(spark, rows, "n long, x double, s string")
    assert t.dtypes == [("n", "bigint"), ("x", "double"), ("s", "string")]
    assert [repr(tuple(r)) for r in t.collect()] == [repr(r) for r in rows]
    assert st.small_table(spark, [], "n long").count() == 0
    assert st.small_table(spark, [(i,) for i in range(st.SMALL_CELLS + 1)], "n long").count() == st.SMALL_CELLS + 1
