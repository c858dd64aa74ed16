"""Scratch tables that cut a long lineage, in the folder the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of an Arrow batch while a table is written: long texts by the ten
#: thousand would fill a Python worker.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local master
    for which none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not path and held.isDefined():
        path = held.get()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
        path = context._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but columnar and compressed.  The
    files survive lost executors and go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{label}-{uuid.uuid4().hex}"
    held = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(held)) if int(held) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    atexit.register(release, out)
    # the driver drops its references to the shuffles behind df, and so their files go
    spark.sparkContext._jvm.System.gc()
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = df.__dict__.pop("_scratch", None)
    try:
        if path:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # at exit the JVM may be gone already
        pass


def small_side(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` (or, of rows that hold
    arrays, counted elements) stay under ``most``."""
    return F.broadcast(df) if rows <= most else df


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt over at least four tasks per core, and not fewer than the
    shuffle partitions: for Python-bound passes, whose work small files would
    leave to one task and AQE would coalesce by bytes."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *cols)
