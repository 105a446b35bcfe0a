"""Session construction and lineage cutting.

On a cluster the session is provided by the platform; ``get_session`` only
fills in settings that are not already present, so cluster-wide choices
(shuffle partitions, checkpoint folder, AQE) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # per-group top-n / sample caps up to 2000 rows are cut map-side before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    # broadcast joins are chosen explicitly behind size checks; keep the
    # automatic threshold at Spark's default (10 MB) rather than raising it.
}


def get_session(app: str = "hearth", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` (or an already-set SparkContext checkpoint
    dir).  Only in local mode (tests) is a fresh scratch folder created when
    neither is set; on a cluster a missing setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage (HDFS/S3/...)")
        configured = tempfile.mkdtemp(prefix="hearth-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written once in the shared checkpoint folder and read again.  For loops
    whose state is joined in every round: a checkpoint keeps the size estimate of its plan,
    which multiplies at each join and grows without end; a file has its own size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/written-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
