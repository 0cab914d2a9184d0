"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

# Bytes of a batch of rows on their way to Python. Spark's own limit is 64 MB, and the buffers of each column double as they
# grow, so wide texts take several hundred MB outside the heap for every task.
BATCH_BYTES = 4 << 20


def build_session(app: str = "driftlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder for checkpoints and intermediate tables.

    Taken from the running context or ``spark.checkpoint.dir``. Only a local master may fall back
    to a temporary folder, because on a cluster no executor could read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="driftlens-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later steps never recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python by ``BATCH_BYTES`` at most, or one by one where they are larger; queries run from now on use it."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def files(spark: SparkSession):
    """(path, file system of a path): the functions of Hadoop's file systems, for any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(name: str):
        return jvm.org.apache.hadoop.fs.Path(name)

    def fs(name: str):
        return path(name).getFileSystem(conf)

    return path, fs
