"""Small fixtures of the operators' tests."""

import pandas as pd

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def read(name, sf=SF):
    return pd.read_parquet(f"{sf}/{name}.parquet")
