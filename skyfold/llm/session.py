"""Session helpers: the shared folder, materialised steps and Arrow batch bounds."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of text in one Arrow batch.  Spark's default of 10,000 would hold 10,000
#: whole documents in a worker at once.
TEXT_ROWS_PER_BATCH = 1000
#: Spark's setting by which a job's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read and write.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder serves a local session, as in tests; a cluster's executors
    would not see it, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if spark.sparkContext.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="skyfold-")
    return _LOCAL_DIRS[spark.sparkContext.applicationId]


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Delete a folder, now or when the session's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        fs.deleteOnExit(where)
    else:
        fs.delete(where, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the jobs run inside are deleted when each job ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks of later stages only.
    The table goes when ``discard`` is called, or with the session.  ``codec``: snappy
    for a table whose columns are read several times, zstd for others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skyfold-{uuid.uuid4().hex}"
    schema = df.schema
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    remove(spark, path, at_exit=True)
    out = spark.read.schema(schema).parquet(path)
    out._skyfold_path = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete the tables of ``materialise`` that nothing reads any more."""
    for step in steps:
        remove(step.sparkSession, step._skyfold_path)


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that hold whole texts small, unless the session already does."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > TEXT_ROWS_PER_BATCH:
        spark.conf.set(key, str(TEXT_ROWS_PER_BATCH))
