"""Session settings and the two helpers that depend on the cluster: shared folder and checked broadcast."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes up to which a side is broadcast after it was measured.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Compression of tables that the library writes.
PACKED = "zstd"


def build_session(app: str = "geoledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, adaptive plans, dynamic partition overwrite."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: what the cluster names in spark.checkpoint.dir, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


_job_dirs: set[str] = set()


def job_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables under the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/geoledger-{spark.sparkContext.applicationId}"
    if path not in _job_dirs:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(folder)
        store.deleteOnExit(folder)
        _job_dirs.add(path)
    return path


_step: ContextVar[str | None] = ContextVar("step", default=None)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside go when the block ends; frames over them must not leave it.

    For steps that repeat as long as the driver lives, such as the flushes of a stream.
    """
    folder = f"{job_dir(spark)}/step-{uuid.uuid4().hex}"
    before = _step.set(folder)
    try:
        yield
    finally:
        _step.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame) -> DataFrame:
    """Write the frame to the job's folder, or that of the step, as a table and read it back.

    Cuts the lineage, survives lost executors, and unlike a checkpoint of rows lets later steps read single
    columns and lets the planner know the size. It is written once and read a few times, and packed for that.
    """
    path = f"{_step.get() or job_dir(df.sparkSession)}/materialised-{uuid.uuid4().hex}"
    df.write.option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little to do may put off for longer than the
    disks last.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bytes(df: DataFrame) -> Column:
    """Size of a row: text and nested values by their length, everything else as eight bytes."""
    size = F.lit(0)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            part = F.octet_length(column)
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            part = F.octet_length(F.to_json(F.struct(column)))
        else:
            part = F.lit(8)
        size = size + F.coalesce(part, F.lit(0))
    return size


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark `df` for broadcast only after measuring that it stays under both bounds.

    The measure is one aggregate, combined in each task. Beyond the bounds the frame is returned as it is, and the
    join shuffles, with skewed keys split at run time by the adaptive planner. Frames that are costly to compute
    should be materialised first.
    """
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_bytes(df)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= max_rows and size["bytes"] <= max_bytes else df
