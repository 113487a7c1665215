"""Grids in long form (tile, r, c): morphology, components, boxes, sliding means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _offsets(k: int):
    return F.sequence(F.lit(-k), F.lit(k))


def dilate(cells: DataFrame, k: int, side: int) -> DataFrame:
    """Cells within k rows and columns of a set one; separable, clipped to the grid."""
    x = cells.select("tile", "c", F.explode(F.transform(_offsets(k), lambda o: F.col("r") + o)).alias("r")).filter(F.col("r").between(0, side - 1)).distinct()
    x = x.select("tile", "r", F.explode(F.transform(_offsets(k), lambda o: F.col("c") + o)).alias("c")).filter(F.col("c").between(0, side - 1))
    return x.distinct()


def _erode_along(cells: DataFrame, axis: str, k: int, side: int, border: bool) -> DataFrame:
    other = "c" if axis == "r" else "r"
    near = cells.select("tile", F.explode(F.transform(_offsets(k), lambda o: F.col(axis) + o)).alias(axis), other).filter(F.col(axis).between(0, side - 1))
    votes = near.groupBy("tile", "r", "c").agg(F.count("*").alias("n"))
    need = F.least(F.col(axis) + k, F.lit(side - 1)) - F.greatest(F.col(axis) - k, F.lit(0)) + 1 if border else F.lit(2 * k + 1)
    return votes.filter(F.col("n") == need).select("tile", "r", "c")


def erode(cells: DataFrame, k: int, side: int, border: bool) -> DataFrame:
    """Cells whose whole neighbourhood is set; outside counts as ``border``; by rows, then by columns.

    Cells vote for their neighbours; a cell stays if all neighbours that count have voted.
    """
    return _erode_along(_erode_along(cells, "r", k, side, border), "c", k, side, border)


def opening(cells, k, side, border=False):
    return dilate(erode(cells, k, side, border), k, side)


def closing(cells, k, side, border=False):
    return erode(dilate(cells, k, side), k, side, border)


def runs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Maximal horizontal runs (by…, r, c0, c1)."""
    w = Window.partitionBy(*by, "r").orderBy("c")
    g = cells.withColumn("g", F.col("c") - F.row_number().over(w))
    return g.groupBy(*by, "r", "g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("g")


def merged_runs(spans: DataFrame, by: list[str], side: int) -> DataFrame:
    """Maximal horizontal runs (by…, r, c0, c1) of spans that may overlap or touch; no cell is made."""
    # Rows stand one after the other with a gap between, so one running maximum serves a whole group.
    low, high = F.col("r") * (side + 2) + F.col("c0"), F.col("r") * (side + 2) + F.col("c1")
    w = Window.partitionBy(*by).orderBy("low", "high")
    s = spans.select(*by, low.alias("low"), high.alias("high"))
    reached = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.when(reached.isNull() | (F.col("low") > reached + 1), 1).otherwise(0))
    s = s.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.groupBy(*by, "g").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    at = lambda c: F.col(c) % (side + 2)
    return s.select(*by, F.floor(F.col("low") / (side + 2)).cast("int").alias("r"), at("low").cast("int").alias("c0"), at("high").cast("int").alias("c1"))


def shared_cells(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by…, n): how many cells two sets of merged runs share."""
    x, y = a.select(*by, "r", F.col("c0").alias("a0"), F.col("c1").alias("a1")), b.select(*by, "r", F.col("c0").alias("b0"), F.col("c1").alias("b1"))
    j = x.join(y, [*by, "r"]).filter("a0 <= b1 AND b0 <= a1")
    return j.groupBy(*by).agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0") + 1).alias("n"))


def label_runs(tile: np.ndarray, r: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """A component number for each run, sorted by (tile, r, c0): the index of its first run; 4-neighbours."""
    n = len(r)
    root = np.arange(n)
    if not n:
        return root
    # Runs of the row above that overlap stand side by side: both ends of a row's runs rise.
    tile, r, c0, c1 = (np.asarray(x) for x in (tile, r, c0, c1))
    new = np.concatenate([[True], (tile[1:] != tile[:-1]) | (r[1:] != r[:-1])])
    row = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    below = np.concatenate([[False], (tile[heads[1:]] == tile[heads[:-1]]) & (r[heads[1:]] == r[heads[:-1]] + 1)])
    j = np.flatnonzero(below[row])
    wide = int(c1.max()) + 2
    above = (row[j] - 1) * wide
    first = np.searchsorted(row * wide + c1, above + c0[j])
    count = np.maximum(np.searchsorted(row * wide + c0, above + c1[j], "right") - first, 0)
    b = np.repeat(j, count)
    a = np.repeat(first, count) + np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
    # The larger root of each link takes the smaller one, until no link has two.
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def components(cells: DataFrame) -> DataFrame:
    """``components_of_runs`` of cells (tile, r, c)."""
    return components_of_runs(runs(cells, ["tile"]))


def components_of_runs(found: DataFrame) -> DataFrame:
    """(tile, r, c0, c1, component) of 4-connected components, numbered from 1 in raster order within each tile.

    Tiles are whole in a partition and stream through it; a worker holds one
    Arrow batch and the tile that crosses into the next.
    """
    ordered = found.select("tile", "r", "c0", "c1").repartition("tile").sortWithinPartitions("tile", "r", "c0")

    def label(batches):
        def out(p: pd.DataFrame) -> pd.DataFrame:
            t = p["tile"].to_numpy()
            root = label_runs(t, p["r"].to_numpy(), p["c0"].to_numpy(), p["c1"].to_numpy())
            is_root = root == np.arange(len(p))
            rank = np.cumsum(is_root)
            first = np.concatenate([[True], t[1:] != t[:-1]])
            base = np.maximum.accumulate(np.where(first, rank - 1, 0))
            return p.assign(component=(rank[root] - base).astype("int32"))

        rest = None
        for p in batches:
            p = p if rest is None else pd.concat([rest, p], ignore_index=True)
            if not len(p):
                continue
            last = p["tile"].iloc[-1]
            whole = p["tile"] != last
            done, rest = p[whole].reset_index(drop=True), p[~whole].reset_index(drop=True)
            if len(done):
                yield out(done)
        if rest is not None and len(rest):
            yield out(rest)

    return ordered.mapInPandas(label, T.StructType([*ordered.schema.fields, T.StructField("component", T.IntegerType())]))


def boxes(labelled: DataFrame) -> DataFrame:
    """(tile, component, area, r0, c0, r1, c1, fill) of labelled runs."""
    g = labelled.groupBy("tile", "component").agg(F.sum(F.col("c1") - F.col("c0") + 1).cast("long").alias("area"), F.min("r").alias("r0"), F.min("c0").alias("x0"), F.max("r").alias("r1"), F.max("c1").alias("x1"))
    box = (F.col("r1") - F.col("r0") + 1) * (F.col("x1") - F.col("x0") + 1)
    return g.withColumn("fill", F.bround(F.col("area") / box, 3))


def cells_of_runs(labelled: DataFrame) -> DataFrame:
    return labelled.select("tile", "component", "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def sliding_mean(signal: DataFrame, by: str, extent: int, side: int, stride: int, value: str = "value") -> DataFrame:
    """(by, x, mean): each position's mean over the windows that cover it; the last window ends at the edge."""
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(extent - side, 0) + stride - 1), F.lit(stride)), lambda s: F.least(s, F.lit(max(extent - side, 0)))))
    w = signal.withColumn("w", F.explode(F.filter(starts, lambda s: (s <= F.col("x")) & (F.col("x") < s + side))))
    means = w.groupBy(by, "w").agg(F.avg(value).alias("m"))
    covers = means.withColumn("x", F.explode(F.sequence(F.col("w"), F.least(F.col("w") + side, F.lit(extent)) - 1)))
    return covers.groupBy(by, "x").agg(F.avg("m").alias("mean"))


def place(rows: DataFrame, index: str, width: int) -> DataFrame:
    """``rows`` with their row and column on a grid that the index fills row by row."""
    return rows.withColumn("r", F.floor(F.col(index) / width).cast("int")).withColumn("c", (F.col(index) % width).cast("int"))


def window_starts(extent: int, side: int, stride: int) -> list[int]:
    """Where windows along one axis begin; the last ends at the edge."""
    last = max(extent - side, 0)
    return sorted({min(s, last) for s in range(0, last + stride, stride)})


def sliding_mean_2d(cells: DataFrame, by: str, extent: int, side: int, stride: int, value: str = "value") -> DataFrame:
    """(by, r, c, mean): each cell's mean over the square windows that cover it of the windows' means; the last ones end at the edge."""
    starts = F.array(*[F.lit(s) for s in window_starts(extent, side, stride)])
    hold = lambda at: F.explode(F.filter(starts, lambda s: (s <= F.col(at)) & (F.col(at) < s + side)))
    w = cells.withColumn("wr", hold("r")).withColumn("wc", hold("c"))
    means = w.groupBy(by, "wr", "wc").agg(F.avg(value).alias("m"))
    span = lambda at: F.explode(F.sequence(F.col(at), F.least(F.col(at) + side, F.lit(extent)) - 1))
    covers = means.withColumn("r", span("wr")).withColumn("c", span("wc"))
    return covers.groupBy(by, "r", "c").agg(F.avg("m").alias("mean"))
