"""The k table is made once for the elbow, the size and the choice."""

from hearth.plans.registry import QUERIES, load_all

load_all()


def test_select_k_reads_the_rows_once(spark):
    out = QUERIES["select_k"](spark, "/root/testdata/sf0.001")
    assert "InMemory" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("chosen").count() == 1
