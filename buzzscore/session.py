"""SparkSession settings the engine relies on.

Timestamps are interpreted in UTC, ANSI mode stays on (we use ``try_*``
functions where a value may be invalid), AQE re-plans shuffles at run time
and the web UI stays off.  The checkpoint folder is read from the session
(``spark.checkpoint.dir``); only when it is unset *and* Spark runs in local
mode do we make a scratch folder of our own, as tests do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Rows that a Python worker gets at a time: posts are some KB each, with their terms ten times that.
ARROW_ROWS = 1000


def build_session(
    master: str | None = None,
    app_name: str = "buzzscore",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every query depends on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``.  A private scratch folder is
    made only when the setting is absent and Spark runs locally (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder every "
                "executor can reach (HDFS/S3/shared FS)"
            )
        configured = tempfile.mkdtemp(prefix="buzzscore-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for a written table."""
    return checkpoint_dir(spark).rstrip("/") + "/" + name


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read with
    column pruning, and not computed again when an executor is lost.

    A lazy result may read it, so it stays until ``drop_written``."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete the written tables of this process; results must be stored by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
