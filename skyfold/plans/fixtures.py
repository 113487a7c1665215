"""Views over the driver's tables that stand in for survey tables, for Spark and as SQL text.

Integer arithmetic gives the same rows in both engines.  All rows are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark, sf_dir) -> DataFrame:
    """Orders as frames: a customer is a flight."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("flight"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderkey") % 11 != 0, F.lit(-20.0) + (F.col("o_orderkey") % 100) * F.lit(0.0004)).alias("lat"),
        (F.lit(146.0) + (F.col("o_orderkey") % 97) * F.lit(0.0004)).alias("lon"),
    )


def rects(spark, sf_dir) -> DataFrame:
    """Line items as rectangles of a 32 x 32 tile for each order; odd numbers are true, even ones predicted."""
    # Dealt by tile once: what follows by tile, or by tile and more, needs no other shuffle.
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    g = li.groupBy(F.col("l_orderkey").alias("tile"), F.col("l_linenumber").alias("inst")).agg(
        F.min(F.col("l_partkey") % GRID).cast("int").alias("cx"),
        F.min((F.col("l_suppkey") * 7 + F.col("l_partkey")) % GRID).cast("int").alias("cy"),
        F.min(F.lit(2) + F.col("l_quantity").cast("int") % 5).alias("half"),
        (F.min(F.floor("l_extendedprice")) % 1000 / F.lit(1000.0)).alias("conf"),
    )
    lim = GRID - 1
    return g.select(
        "tile", "inst", "cx", "cy", "half", "conf",
        F.greatest(F.col("cx") - F.col("half"), F.lit(0)).alias("x0"),
        F.greatest(F.col("cy") - F.col("half"), F.lit(0)).alias("y0"),
        F.least(F.col("cx") + F.col("half"), F.lit(lim)).alias("x1"),
        F.least(F.col("cy") + F.col("half"), F.lit(lim)).alias("y1"),
        (F.col("inst") % 2 == 1).alias("gt"),
    )


def cells(r: DataFrame) -> DataFrame:
    """(tile, inst, r, c) of rectangles, both ends included."""
    x = r.select("tile", "inst", F.explode(F.sequence("y0", "y1")).alias("r"), "x0", "x1")
    return x.select("tile", "inst", "r", F.explode(F.sequence("x0", "x1")).alias("c"))


def spans(r: DataFrame) -> DataFrame:
    """(tile, inst, r, c0, c1) of rectangles."""
    return r.select("tile", "inst", F.explode(F.sequence("y0", "y1")).alias("r"), F.col("x0").alias("c0"), F.col("x1").alias("c1"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def scored(spark, sf_dir) -> DataFrame:
    """(vec_id, label, y, p): similarity to the mean vector of label 0, to six places."""
    from skyfold.functions.vectors import dot
    from skyfold.operators.vector import centroids, nearest

    v = vectors(spark, sf_dir)
    ref = centroids(v.filter("label = 0"), "label")
    out = nearest(v.withColumnRenamed("label", "own"), ref, "label", lambda c: dot(F.col("v"), c))
    return out.select("vec_id", F.col("own").alias("label"), (F.col("own") == 0).cast("int").alias("y"), F.round("score", 6).alias("p"))


def actions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    act = F.when(F.col("event_type") == "view", "keep").when(F.col("event_type") == "error", "skip").when(F.col("event_type") == "click", "undo")
    return e.select(F.col("user_id").alias("name"), "ts", "event_id", act.alias("action")).filter("action is not null")


def decisions(spark, sf_dir) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    kind = F.when(F.col("quality").isNull(), "undecided").when((F.col("quality") == 1) & (F.col("toxic") == 0), "keep").otherwise("skip")
    return d.join(l, "doc_id", "left").select(F.concat(F.lit("doc_"), "doc_id").alias("name"), kind.alias("decision"), "source")


SQL = {
    "frames": """frames AS (SELECT o_orderkey AS id, o_custkey AS flight, o_orderdate AS ts,
  CASE WHEN o_orderkey % 11 <> 0 THEN -20.0::DOUBLE + (o_orderkey % 100) * 0.0004::DOUBLE END AS lat,
  146.0::DOUBLE + (o_orderkey % 97) * 0.0004::DOUBLE AS lon FROM orders)""",
    "rects": """r0 AS (SELECT l_orderkey AS tile, l_linenumber AS inst, min(l_partkey % 32)::INT AS cx, min((l_suppkey * 7 + l_partkey) % 32)::INT AS cy,
  min(2 + trunc(l_quantity)::INT % 5) AS half, (min(floor(l_extendedprice)::BIGINT) % 1000) / 1000.0::DOUBLE AS conf FROM lineitem GROUP BY 1, 2),
rects AS (SELECT *, greatest(cx - half, 0) AS x0, greatest(cy - half, 0) AS y0, least(cx + half, 31) AS x1, least(cy + half, 31) AS y1, inst % 2 = 1 AS gt FROM r0)""",
    "cells": """cells AS (SELECT tile, inst, gt, r, unnest(range(x0, x1 + 1))::INT AS c FROM (SELECT *, unnest(range(y0, y1 + 1))::INT AS r FROM rects))""",
    "vectors": """vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)""",
    "scored": """dims AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM vectors),
ref AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM dims WHERE label = 0 GROUP BY i)),
scored AS (SELECT vec_id, label, (label = 0)::INT AS y, round(list_dot_product(v, m), 6) AS p FROM vectors, ref)""",
    "decisions": """decisions AS (SELECT 'doc_' || doc_id AS name, CASE WHEN quality IS NULL THEN 'undecided' WHEN quality = 1 AND toxic = 0 THEN 'keep' ELSE 'skip' END AS decision, source
  FROM documents LEFT JOIN labels USING (doc_id))""",
    "actions": """actions AS (SELECT * FROM (SELECT user_id AS name, ts, event_id, CASE event_type WHEN 'view' THEN 'keep' WHEN 'error' THEN 'skip' WHEN 'click' THEN 'undo' END AS action FROM events) WHERE action IS NOT NULL)""",
}


def sql(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
