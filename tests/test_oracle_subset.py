"""A representative subset of registered queries against their DuckDB twins (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as entry
from hearth.sources.tables import TABLES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"
KEYS = ["cluster_profiles", "field_profile", "structural_rules", "fill_real_numeric", "estimate_k",
        "assign_mixed", "top_n_per_group", "quota_remainder", "render_variable_block", "parse_fit_response",
        "questionnaire_score", "nearest_persona", "similar_outliers", "triage", "mapping_provenance"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    sdf = entry.queries()[key](spark, SF).toPandas()
    odf = con.sql(entry.oracle_sql()[key]).df()
    sc, sr = rows_of(sdf)
    oc, orows = rows_of(odf)
    assert sc == oc
    assert [repr(x) for x in sr] == [repr(x) for x in orows]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "cluster_id" in df.columns


def test_every_oracle_key_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
