"""Sources and sinks.

Codebooks and metadata are single JSON documents per dataset (metadata-sized,
one task per file); household tables are scanned lazily (CSV or parquet)
and written partitioned.  Paths are parameters; nothing here touches the
driver's local disk except through Spark readers / writers.
"""

from __future__ import annotations

import os
import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dataset keys and codebook file names
DATASETS = {
    "psid": "psid/PSID_codebook_wiki.json",
    "acs": "acs/ACS_codebook_wiki.json",
    "ces": "ces/CES_codebook_wiki.json",
    "shed": "shed/SHED_codebook_wiki.json",
    "sipp": "sipp/sipp_codebook_wiki.json",
}
# Household id column candidates per dataset, in lookup order
ID_CANDIDATES = {
    "psid": ["ER82002", "fid"],
    "shed": ["CaseID", "caseid"],
    "acs": ["SERIALNO", "serialno"],
    "ces": ["NEWID", "CUID", "newid", "cuid"],
    "sipp": ["family_id", "SHHADID", "ssuid", "shhadid"],
    None: ["ER82002", "fid", "CaseID", "caseid", "SERIALNO", "serialno", "NEWID", "CUID", "newid", "cuid",
           "SSUID", "SHHADID", "ssuid", "shhadid"],
}

CODEBOOK_ENTRY = ("struct<label:string,description:string,availability_rate:string,"
                  "code_values:array<struct<value:string,text:string>>>")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def codebook_scan(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """One dataset's codebook JSON object -> long table
    ``(dataset, seq, var_id, label, description, availability_rate, code_values)``
    in file order.  Unknown key -> ValueError, missing file -> FileNotFoundError."""
    key = (dataset or "").strip().lower()
    if key not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; expected one of {sorted(DATASETS)}")
    path = os.path.join(root, DATASETS[key])
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), f"map<string,{CODEBOOK_ENTRY}>")
    return raw.select(F.posexplode(F.map_entries(m)).alias("seq", "e")).select(
        F.lit(key).alias("dataset"), F.col("seq").cast("long"), F.col("e.key").alias("var_id"),
        "e.value.label", "e.value.description", "e.value.availability_rate", "e.value.code_values")


def codebook_union(spark: SparkSession, root: str) -> DataFrame | None:
    """Every dataset whose codebook file exists, unioned (missing ones skipped)."""
    out = None
    for key in DATASETS:
        try:
            df = codebook_scan(spark, root, key)
        except FileNotFoundError:
            continue
        out = df if out is None else out.unionByName(df)
    return out


def codebook_lookup(codebook: DataFrame, var_id: str | None = None) -> DataFrame:
    """S3: one variable (empty when absent) or all variables."""
    return codebook if var_id is None else codebook.where(F.col("var_id") == var_id)


def survey_csv_scan(spark: SparkSession, path: str, encoding: str | None = None,
                    schema=None) -> DataFrame:
    """Household CSV (header, inferred or explicit schema); a leading BOM is
    stripped from the first column name; names differing only by case are
    rejected (Spark resolves columns case-insensitively)."""
    r = spark.read.option("header", True)
    if encoding:
        r = r.option("encoding", "UTF-8" if encoding.lower() in ("utf-8-sig", "utf8-sig") else encoding)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path)
    # Spark renames case-duplicate headers (a0, A1); check the raw header row (one row)
    raw = spark.read.option("header", False).csv(path).limit(1).collect()
    if raw:
        names = [str(v).lstrip("\ufeff") for v in raw[0] if v is not None]
        low = [n.lower() for n in names]
        dups = sorted({n for n in names if low.count(n.lower()) > 1})
        if dups:
            raise ValueError(f"columns differ only by case: {dups}")
    first = df.columns[0] if df.columns else None
    if first and first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    lowered = [c.lower() for c in df.columns]
    dups = sorted({c for c in df.columns if lowered.count(c.lower()) > 1})
    if dups:
        raise ValueError(f"columns differ only by case: {dups}")
    return df


def field_metadata_scan(spark: SparkSession, path: str) -> DataFrame:
    """Extracted-field JSON, either a list or ``{"selected_fields": [...]}``;
    key = first non-blank of var_id / field_name / variable_name (trimmed);
    a later duplicate wins.  Returns ``(key, ord, item)`` with ``item`` the
    entry as a string map."""
    raw = spark.read.text(path, wholetext=True)
    item_t = "map<string,string>"
    as_list = F.from_json(F.col("value"), f"array<{item_t}>")
    as_obj = F.from_json(F.col("value"), f"struct<selected_fields:array<{item_t}>>")["selected_fields"]
    items = F.coalesce(as_obj, as_list)
    ex = raw.select(F.posexplode(items).alias("ord", "item"))

    def nonblank(k):
        v = F.col("item")[k]
        return F.when(F.length(F.trim(v)) > 0, v)
    key = F.trim(F.coalesce(nonblank("var_id"), nonblank("field_name"), nonblank("variable_name")))
    ex = ex.withColumn("key", key).where(F.col("key").isNotNull() & (F.col("key") != ""))
    return ex.groupBy("key").agg(F.max_by(F.struct("ord", "item"), "ord").alias("r")).select("key", "r.ord", "r.item")


def restrict_columns(df: DataFrame, *lists: Sequence[str] | None) -> DataFrame:
    """The first non-empty list whose existing members are non-empty wins;
    keeps list order; otherwise all columns (pushes down to the scan)."""
    for wanted in lists:
        if not wanted:
            continue
        keep = [c for c in wanted if c in df.columns]
        if keep:
            return df.select(*keep)
    return df


def resolve_id_column(columns: Sequence[str], requested: str | None = "fid", dataset: str | None = None,
                      require_present: bool = False) -> str | None:
    """Of the columns that spell a wanted name in any case, the one that
    ranks best: by place in the list of wanted names (the requested one first,
    then the dataset's), then exact spelling, then the rightmost column."""
    key = (dataset or "").strip().lower()
    wanted = [n for n in [requested, *ID_CANDIDATES.get(key or None, ID_CANDIDATES[None])] if n]
    place = {n.lower(): (i, n) for i, n in reversed(list(enumerate(wanted)))}
    ranked = [(place[c.lower()][0], c != place[c.lower()][1], -at, c) for at, c in enumerate(columns) if c.lower() in place]
    if not ranked and require_present:
        raise KeyError(f"none of {wanted} is a column (dataset {key or 'not given'})")
    return min(ranked)[-1] if ranked else requested


def dataset_key_from_path(path: str, *extra: str) -> str | None:
    """Dataset key appearing as a path token delimited by / \\ . _ - (or ends)."""
    hay = " ".join([path, *extra]).lower()
    for key in ("psid", "acs", "ces", "shed", "sipp"):
        if re.search(rf"(?:^|[\\/._-]){re.escape(key)}(?:$|[\\/._-])", hay):
            return key
    return None


# ---------------------------------------------------------------- sinks (S9-S13) and S14

def write_labeled_households(df: DataFrame, path: str, fmt: str = "parquet", label: str = "cluster") -> None:
    """Original columns + cluster, partitioned by cluster."""
    w = df.write.mode("overwrite").partitionBy(label)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_cluster_profiles(profiles: DataFrame, path: str) -> None:
    """The wide profile as CSV (one small file: k rows)."""
    profiles.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_selected_fields(selection: DataFrame, path: str) -> None:
    """The selection record as JSON lines."""
    selection.coalesce(1).write.mode("overwrite").json(path)


def write_personas(personas: DataFrame, path: str, iteration: int | None = None) -> None:
    """Persona records as JSON, final or per iteration."""
    df = personas if iteration is None else personas.withColumn("iteration", F.lit(iteration))
    w = df.write.mode("overwrite" if iteration is None else "append")
    (w.partitionBy("iteration") if iteration is not None else w).json(path)


def write_mapping(mapping: DataFrame, path: str, iteration: int | None = None) -> None:
    """Household -> persona mapping, final or per iteration (partitioned)."""
    if iteration is None:
        mapping.write.mode("overwrite").parquet(path)
    else:
        mapping.withColumn("iteration", F.lit(iteration)).write.mode("append").partitionBy("iteration").parquet(path)


def read_clustering_results(spark: SparkSession, profiles_path: str, households_path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles (CSV) and labelled households (parquet)."""
    prof = spark.read.option("header", True).option("inferSchema", True).csv(profiles_path)
    return prof, spark.read.parquet(households_path)
