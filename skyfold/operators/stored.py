"""Steps that are written to the cluster's shared folder, and sums along a global order without one task that sorts all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}
#: Spark's setting by which a job's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def home(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local session where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="skyfold-"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; its shuffle files go at once, the table with the session."""
    spark = df.sparkSession
    path = f"{home(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def ordered_parts(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range-partitioned by the order, with the number of each row's range as ``__p``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))


def running_sums(df: DataFrame, order: list[Column], by: tuple = (), **sums: str) -> DataFrame:
    """``df`` with, for each name=column, the sum of the column over the rows of its group up to here in the order.

    Each range of (by, order) is summed on its own; the sums of the ranges
    before, a row for each range and group, are added.
    """
    parts = ordered_parts(df, *[F.col(c) for c in by], *order)
    here = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy("__p", *by).agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__p", *by, *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__t_{k}") for k in sums])
    out = parts
    for k, c in sums.items():
        out = out.withColumn(k, F.sum(c).over(here))
    out = out.join(totals, ["__p", *by])
    for k in sums:
        out = out.withColumn(k, F.col(k) + F.col(f"__t_{k}"))
    return out.drop("__p", *[f"__t_{k}" for k in sums])
