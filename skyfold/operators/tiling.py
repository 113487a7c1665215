"""Tiles, markers, batches and merged exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions.geo import overlaps, tile_origins
from skyfold.functions.names import batch_name
from skyfold.operators.stored import running_sums


def tile_grid(images: DataFrame, tile: int, edge: str = "shift") -> DataFrame:
    """(…, row, col, x0, y0, x1, y1, padded) of every tile of images with width and height."""
    g = images.select("*", F.posexplode(tile_origins(F.col("height"), tile, edge)).alias("row", "y0"))
    g = g.select("*", F.posexplode(tile_origins(F.col("width"), tile, edge)).alias("col", "x0"))
    g = g.withColumn("x1", F.least(F.col("x0") + tile, "width")).withColumn("y1", F.least(F.col("y0") + tile, "height"))
    return g.withColumn("padded", (F.col("x0") + tile > F.col("width")) | (F.col("y0") + tile > F.col("height")))


def blobs_on_tiles(blobs: DataFrame, tiles: DataFrame, cell: int) -> DataFrame:
    """Blob and tile pairs of one source whose boxes overlap.

    Both sides are dealt to the square cells that they touch, so the join has an
    equality to hash on; a pair that meets in several cells is taken in the
    first that it shares.
    """

    def dealt(df: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("int"), F.floor((F.col(hi) - 1) / cell).cast("int"))
        d = df.select(*[F.col(c).alias(p + c) for c in df.columns])
        d = d.withColumn(p + "gx", F.explode(span(p + "x0", p + "x1")))
        return d.withColumn(p + "gy", F.explode(span(p + "y0", p + "y1")))

    b, t = dealt(blobs, "b_"), dealt(tiles, "t_")
    j = b.join(t, (F.col("b_source") == F.col("t_source")) & (F.col("b_gx") == F.col("t_gx")) & (F.col("b_gy") == F.col("t_gy")))
    c = F.col
    j = j.filter(overlaps(c("b_x0"), c("b_x1"), c("b_y0"), c("b_y1"), c("t_x0"), c("t_x1"), c("t_y0"), c("t_y1")))
    first_x = F.floor(F.greatest("b_x0", "t_x0") / cell).cast("int") == c("b_gx")
    first_y = F.floor(F.greatest("b_y0", "t_y0") / cell).cast("int") == c("b_gy")
    return j.filter(first_x & first_y).drop("b_gx", "b_gy", "t_gx", "t_gy")


def blobs_on_tile_grid(blobs: DataFrame, images: DataFrame, tile: int, edge: str = "shift") -> DataFrame:
    """``blobs_on_tiles`` of every tile of ``tile_grid`` of images (source, width, height).

    The tiles that a blob's box meets follow from its image's size, so blobs meet
    images, one row each, and a tile is made only where a blob lies on it.
    """
    c = F.col
    j = blobs.select(*[c(x).alias("b_" + x) for x in blobs.columns])
    i = images.select(c("source").alias("t_source"), c("width").alias("__w"), c("height").alias("__h"))
    j = j.join(i, c("b_source") == c("t_source"))

    def met(extent: str, low: str, high: str):
        # Numbers of the first and last tile along an axis that a box can meet; only the last may be shifted.
        at, lo, hi = c(extent), c(low), c(high)
        n = F.floor(at / tile) if edge == "crop" else F.ceil(at / tile)
        last = F.greatest(n.cast("int"), F.lit(0 if edge == "crop" else 1)) - 1
        shifted = (hi > at - tile) if edge == "shift" else F.lit(False)
        k0 = F.greatest(F.floor(lo / tile).cast("int"), F.lit(0))
        k1 = F.when(shifted, last).otherwise(F.least(F.ceil(hi / tile).cast("int") - 1, last))
        return F.explode(F.when(k0 <= k1, F.sequence(k0, k1)))

    def start(extent: str, k: str):
        s = c(k) * tile
        return F.greatest(F.least(s, c(extent) - tile), F.lit(0)) if edge == "shift" else s

    j = j.withColumn("t_row", met("__h", "b_y0", "b_y1")).withColumn("t_col", met("__w", "b_x0", "b_x1"))
    j = j.withColumn("t_x0", start("__w", "t_col")).withColumn("t_y0", start("__h", "t_row"))
    j = j.withColumn("t_x1", F.least(c("t_x0") + tile, "__w")).withColumn("t_y1", F.least(c("t_y0") + tile, "__h")).drop("__w", "__h")
    return j.filter(overlaps(c("b_x0"), c("b_x1"), c("b_y0"), c("b_y1"), c("t_x0"), c("t_x1"), c("t_y0"), c("t_y1")))


def crib(pairs: DataFrame) -> DataFrame:
    """Marker boxes in the coordinates of each tile, unclipped and clipped."""
    c = F.col
    side_x, side_y = c("t_x1") - c("t_x0"), c("t_y1") - c("t_y0")
    local = {"x0": c("b_x0") - c("t_x0"), "y0": c("b_y0") - c("t_y0"), "x1": c("b_x1") - c("t_x0"), "y1": c("b_y1") - c("t_y0")}
    out = pairs.select("*", *[v.alias("marker_" + k) for k, v in local.items()])
    for k, side in (("x0", side_x), ("y0", side_y), ("x1", side_x), ("y1", side_y)):
        out = out.withColumn("clip_" + k, F.greatest(F.lit(0), F.least(side, local[k])))
    return out


def batches(names: DataFrame, size: int, order: str, by: list[str] | None = None) -> DataFrame:
    """Rows numbered in name order, batch number and name, and the number within the batch.

    With ``by`` each group is numbered on its own.  Numbers are running counts over
    ordered ranges, so no task sorts all names or a whole group.
    """
    one = names.withColumn("__one", F.lit(1).cast("long"))
    out = running_sums(one, [F.col(order)], tuple(by or ()), i="__one").drop("__one").withColumn("i", F.col("i") - 1)
    if by:
        out = out.join(names.groupBy(*by).agg(F.count("*").alias("__all")), list(by))
        total = F.col("__all")
    else:
        total = F.lit(names.count())
    out = out.withColumn("batch_no", F.floor(F.col("i") / size).cast("int") + 1)
    out = out.withColumn("batch", batch_name(F.col("batch_no"), F.ceil(total / size))).drop("__all")
    return out.withColumn("image_id", (F.col("i") % size).cast("int"))


def merge_exports(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(export_ord, name, sha, shapes) -> merged (name, sha, shapes, exports) and collisions.

    The earliest export of a name decides its content; equal contents add their
    shapes, others collide and are left out whole.
    """
    first = shapes.groupBy("name").agg(F.min(F.struct("export_ord", "sha")).alias("f"))
    j = shapes.join(first, "name").withColumn("same", F.col("sha") == F.col("f.sha"))
    merged = j.filter("same").groupBy("name", "sha").agg(F.sum("shapes").alias("shapes"), F.count("*").alias("exports"))
    return merged, j.filter("not same").select("export_ord", "name", "sha", "shapes")
