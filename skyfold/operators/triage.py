"""Frames: thinning, decisions and the plan of what to keep."""

from __future__ import annotations

from math import cos, radians, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.geo import EARTH_M, ground_distance, known


def every_nth(frames: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """Rows 0, n, 2n ... of each flight."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frames.withColumn("__i", F.row_number().over(w) - 1).filter(F.col("__i") % n == 0).drop("__i")


def spacing(frames: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Each located frame with the metres to the one before in its flight."""
    w = Window.partitionBy(*by).orderBy(*order)
    located = frames.filter(known(F.col("lat")) & known(F.col("lon")))
    return located.withColumn("metres", ground_distance(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def min_spacing(frames: DataFrame, metres: float, by: str, order: list[str], key: str) -> DataFrame:
    """(by, key) of the frames kept: the first of a flight, then each that is far enough from the last kept; frames without a position stay.

    The choice depends on the last kept row, so it is a pass over the flight in
    order: flights run in parallel, stream through their partition and hold only
    the last kept position.
    """
    placed = known(F.col("lat")) & known(F.col("lon"))
    rows = frames.filter(placed).select(by, *dict.fromkeys([*order, "lat", "lon", key])).repartition(by).sortWithinPartitions(by, *order)
    names = dict.fromkeys([by, key])

    def walk(batches):
        flight, at = None, None
        for pdf in batches:
            keep = []
            for f, lat, lon in zip(pdf[by], pdf["lat"], pdf["lon"]):
                # Metres by the local equirectangular approximation, as in ``ground_distance``.
                a, b = radians(lat), radians(lon)
                if f != flight or at is None:
                    far = True
                else:
                    x, y = (b - at[1]) * cos((at[0] + a) / 2), a - at[0]
                    far = sqrt(x * x + y * y) * EARTH_M >= metres
                if far:
                    flight, at = f, (a, b)
                keep.append(far)
            yield pdf.loc[keep, list(names)]

    kinds = dict(frames.dtypes)
    kept = rows.mapInPandas(walk, ", ".join(f"`{n}` {kinds[n]}" for n in names))
    return kept.unionByName(frames.filter(~placed | placed.isNull()).select(*names))


def plan(decisions: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Originals that are to be kept, and kept names without an original."""
    keep = decisions.filter(F.col("decision") == "keep").select("name").distinct()
    return originals.join(keep, "name", "left_semi"), keep.join(originals, "name", "left_anti")


def counted(df: DataFrame, *by: str) -> DataFrame:
    """Rows by category with their percentage."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"))
    return out.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def work_list(wanted: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What has no output yet, or all of it."""
    return wanted if force else wanted.join(done, key, "left_anti")


def last_state(actions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, state): the same action twice clears, another one replaces, ``undo`` clears; null is undecided.

    Only the trailing run of equal actions matters: it decides if its length is odd.
    The last action and the last time of each action are partial aggregates; the run
    is what follows the last other action.
    """
    at = F.struct(*order)
    per = actions.groupBy(key, "action").agg(F.max(at).alias("at"))
    last = per.groupBy(key).agg(F.max(F.struct("at", "action")).alias("m")).select(key, F.col("m.action").alias("__last"))
    other = per.join(last, key).filter(F.col("action") != F.col("__last")).groupBy(key).agg(F.max("at").alias("__other"))
    run = actions.select(key, "action", at.alias("at")).join(last, key).filter(F.col("action") == F.col("__last")).join(other, key, "left")
    n = run.filter(F.col("__other").isNull() | (F.col("at") > F.col("__other"))).groupBy(key, "__last").agg(F.count("*").alias("n"))
    return n.select(key, F.when((F.col("__last") != "undo") & (F.col("n") % 2 == 1), F.col("__last")).otherwise("undecided").alias("state"))
