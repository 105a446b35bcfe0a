"""Incremental ingestion of model responses with Structured Streaming.

The model boundary (SURVEY 7.3) is a set of response tables.  When a batch
inference service drops response files as they finish, this job parses them
as they arrive (T16 fit responses, T13 JSON extraction) and appends the
parsed rows to a table - exactly-once through the checkpointed file source
and an idempotent ``foreachBatch`` sink keyed by batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions.responses import extract_json_response, parse_fit_response

RESPONSE_SCHEMA = "hid long, persona_id int, response string"


def parsed_fit_stream(spark: SparkSession, source_dir: str, fmt: str = "json",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of parsed fit responses from files in ``source_dir``."""
    r = spark.readStream.schema(RESPONSE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.load(source_dir)
    fit = parse_fit_response(F.col("response"))
    return raw.select("hid", "persona_id", fit["fit_score"].alias("fit"), fit["reasoning"].alias("reasoning"),
                      fit["parse_error"].alias("parse_error"),
                      extract_json_response(F.col("response"))["source"].alias("json_source"))


def start_fit_ingestion(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                        trigger_once: bool = True):
    """Append parsed responses to a parquet table; each micro-batch is written
    under its batch id (a retried batch overwrites its own folder)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    w = parsed_fit_stream(spark, source_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
