"""Sources, sinks and the streaming response ingestion."""

import json
import os

import pytest
from pyspark.sql import functions as F

from hearth.sources import io


def test_codebook_scan(spark, tmp_path):
    root = tmp_path / "data"
    (root / "psid").mkdir(parents=True)
    cb = {"ER1": {"label": "Age", "description": "Age of head", "availability_rate": "99%",
                  "code_values": [{"value": "1", "text": "young"}]},
          "ER0": {"label": "Sex", "description": "Sex", "code_values": []}}
    (root / "psid" / "PSID_codebook_wiki.json").write_text(json.dumps(cb))
    df = io.codebook_scan(spark, str(root), "psid")
    rows = df.orderBy("seq").collect()
    assert [r.var_id for r in rows] == ["ER1", "ER0"]  # file order kept
    assert rows[0].code_values[0].text == "young" and rows[1].availability_rate is None
    assert io.codebook_lookup(df, "ER0").count() == 1 and io.codebook_lookup(df, "nope").count() == 0
    with pytest.raises(ValueError):
        io.codebook_scan(spark, str(root), "nope")
    with pytest.raises(FileNotFoundError):
        io.codebook_scan(spark, str(root), "acs")
    u = io.codebook_union(spark, str(root))
    assert u.select("dataset").distinct().collect()[0].dataset == "psid"


def test_csv_scan_bom_and_case(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("﻿CaseID,age,income\n1,30,100.5\n2,40,\n", encoding="utf-8")
    df = io.survey_csv_scan(spark, str(p), encoding="utf-8-sig")
    assert df.columns == ["CaseID", "age", "income"]
    assert io.resolve_id_column(df.columns, "fid", "shed") == "CaseID"
    assert io.resolve_id_column(["caseid"], "fid", "shed") == "caseid"
    with pytest.raises(KeyError):
        io.resolve_id_column(["x"], None, "psid", require_present=True)
    q = tmp_path / "dup.csv"
    q.write_text("a,A\n1,2\n")
    with pytest.raises(Exception):
        io.survey_csv_scan(spark, str(q))


def test_field_metadata_shapes(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text(json.dumps([{"var_id": "v1", "category": "income"}, {"var_id": " ", "field_name": "v2"},
                             {"var_id": "v1", "category": "debt"}]))
    b = tmp_path / "b.json"
    b.write_text(json.dumps({"selected_fields": [{"field_name": "x", "type": "continuous"}]}))
    ra = {r.key: r.item for r in io.field_metadata_scan(spark, str(a)).collect()}
    assert ra["v1"]["category"] == "debt" and "v2" in ra  # later duplicate wins; blank id skipped
    rb = {r.key: r.item for r in io.field_metadata_scan(spark, str(b)).collect()}
    assert rb["x"]["type"] == "continuous"


def test_dataset_key_and_restrict(spark):
    assert io.dataset_key_from_path("/data/shed/file.csv") == "shed"
    assert io.dataset_key_from_path("/data/pshed/file.csv") is None
    assert io.dataset_key_from_path("results_acs_2020.csv") == "acs"
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert io.restrict_columns(df, ["zz"], ["c", "a", "q"]).columns == ["c", "a"]
    assert io.restrict_columns(df, ["zz"]).columns == ["a", "b", "c"]


def test_sinks_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0), (3, -1, 3.0)], "hid long, cluster int, v double")
    io.write_labeled_households(df, str(tmp_path / "lab"))
    prof = spark.createDataFrame([(0, 1, 33.3)], "cluster_id int, n_samples long, percentage double")
    io.write_cluster_profiles(prof, str(tmp_path / "prof"))
    p, h = io.read_clustering_results(spark, str(tmp_path / "prof"), str(tmp_path / "lab"))
    assert h.count() == 3 and sorted(r.cluster for r in h.collect()) == [-1, 0, 1]
    assert p.collect()[0].n_samples == 1
    io.write_mapping(df, str(tmp_path / "map"), iteration=5)
    io.write_mapping(df, str(tmp_path / "map"), iteration=10)
    assert spark.read.parquet(str(tmp_path / "map")).select("iteration").distinct().count() == 2


def test_streaming_fit_ingestion(spark, tmp_path):
    from hearth.streaming.responses import start_fit_ingestion
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"hid": 1, "persona_id": 0, "response": '{"fit_score": 0.9, "reasoning": "ok"}'},
            {"hid": 2, "persona_id": 0, "response": "```json\n{\"fit_score\": 1.5}\n```"},
            {"hid": 3, "persona_id": 1, "response": "broken {"}]
    (src / "part-0.json").write_text("\n".join(json.dumps(r) for r in rows))
    q = start_fit_ingestion(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = {r.hid: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out[1].fit == 0.9 and out[2].fit == 1.0 and out[3].parse_error
