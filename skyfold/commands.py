"""The stages of a survey as functions from paths and options to DataFrames, and a command line over them.

``python -m skyfold index FOLDER OUT`` and the like; each function can be called
by itself.  Pixels are read by whoever makes the feature and pixel tables.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold import sources
from skyfold.functions import names
from skyfold.operators import evaluate, geometry, guards, reports, tiling, triage, vector
from skyfold.operators.stored import stored
from skyfold.sources import metrics, tables


def thumbs(spark: SparkSession, folder: str, done: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Images (path, proxy) that still need a small copy; ``done`` has the proxies that exist."""
    work = sources.list_images(spark, folder).select("path", names.flat_name(F.col("name")).alias("proxy"))
    return work if done is None else triage.work_list(work, done, "proxy", force)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The frame manifest of a folder."""
    return sources.frame_manifest(spark, folder)


def dedup(frames: DataFrame, metres: float | None = None, nth: int | None = None) -> DataFrame:
    """Frames (path, captured_at, lat, lon) thinned by distance or by number, in order of time."""
    one = frames.withColumn("__flight", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    if nth:
        return triage.every_nth(one, nth, ["__flight"], ["captured_at", "path"]).drop("__flight")
    kept = triage.min_spacing(one, metres or 0.0, "__flight", ["captured_at", "path"], "path").select("path")
    return frames.join(kept, "path", "left_semi")


def sheets(frames: DataFrame, columns: int = 6, rows: int = 5) -> DataFrame:
    """Frames with their contact sheet and the cell on it."""
    b = tiling.batches(frames, columns * rows, "path")
    return b.select(*frames.columns, (F.col("batch_no") - 1).alias("page"), F.floor(F.col("image_id") / columns).cast("int").alias("row"), (F.col("image_id") % columns).alias("col"))


def review(actions: DataFrame) -> DataFrame:
    """The decision of each name after all actions (name, ts, event_id, action)."""
    return triage.last_state(actions, "name", ["ts", "event_id"]).withColumnRenamed("state", "decision")


def plan(decisions: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Originals to keep, and kept names without one."""
    return triage.plan(decisions, originals)


def tile(images: DataFrame, marker_cells: DataFrame, side: int = 1024, edge: str = "shift", mode: str = "marked", min_px: int = 200) -> DataFrame:
    """The tile manifest of images (source, width, height) with marker cells (source, r, c)."""
    t = geometry.tiles_to_keep(tiling.tile_grid(images, side, edge), marker_cells, side, mode, min_px)
    stem = F.regexp_replace("source", r"\.[^.]*$", "")
    return t.withColumn("tile", names.tile_name(stem, F.col("row"), F.col("col"))).withColumn("kept", F.col("kept").cast("int"))


def task(tiles: DataFrame, markers: DataFrame) -> DataFrame:
    """Image elements of the annotation task."""
    return tables.task_images(tiles, markers)


def split(tiles: DataFrame, size: int) -> DataFrame:
    """Kept tiles with their batch."""
    return tiling.batches(tiles.filter("kept = 1").select("tile"), size, "tile").select("tile", "batch")


def export(spark: SparkSession, folder: str, pin: str | None = None) -> DataFrame:
    """(path, name, shapes) of the annotated images in the exports of a folder."""
    texts = tables.annotation_kind(tables.zip_members(spark, folder), pin)
    cvat = tables.cvat_rows(texts.filter("kind = 'cvat'"))
    n = sum((F.coalesce(F.size(s), F.lit(0)) for s in sources.SHAPES), F.lit(0))
    one = cvat.select("path", F.substring_index("_name", "/", -1).alias("name"), n.alias("shapes"))
    files = texts.filter("kind = 'coco'").select(F.col("path").alias("file"), F.from_json("text", sources.COCO_SCHEMA).alias("d")).select("file", "d.*")
    return one.union(sources.coco_counts(files).select("file", "name", "shapes"))


def train(rows: DataFrame, path: str, contract: dict, head: str = "logistic"):
    """A head fitted on rows (v, y) and saved with the features that it was fitted on."""
    from pyspark.ml.functions import array_to_vector

    data = vector.balanced_weights(guards.need_rows(rows.filter("y >= 0"), "rows to train on").withColumn("features", array_to_vector("v")), "y")
    model = vector.fit_heads(data, "y", names=(head,))[head]
    guards.save_head(model, contract, path)
    return model


def predict(rows: DataFrame, path: str, contract: dict, kind) -> DataFrame:
    """``rows`` (v) with the score of a saved head as ``p``; refused if the features differ."""
    from pyspark.ml.functions import array_to_vector

    return vector.class_one(guards.load_head(kind, path, contract), rows.withColumn("features", array_to_vector("v"))).drop("features")


def compare(runs: dict[tuple, DataFrame], setting: tuple[str, ...] = ("head", "img_size", "smooth")) -> DataFrame:
    """Scored rows (p, y) by setting as a table of average precision and AUC, the best first."""
    one = {k: evaluate.average_precision(df).crossJoin(evaluate.roc_auc(df)) for k, df in ((k, stored(df)) for k, df in runs.items())}  # one row each
    return reports.settings_table(one, setting, "ap")


def score(cells: DataFrame, gt: DataFrame, side: int, **options) -> DataFrame:
    """The three-level report of scored cells."""
    return reports.three_levels(cells, gt, side, **options)


def report(spark: SparkSession, path: str, as_html: bool = True) -> str:
    """The report of one metrics file, or the comparison of several."""
    m, f = metrics.read_metrics(spark, path)
    if f.select("run").distinct().count() > 1:
        return metrics.comparison_report(reports.compare_runs(m, f), as_html)
    return metrics.run_report(m, f, as_html)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skyfold", description=__doc__.splitlines()[0])
    sub = parser.add_subparsers(dest="command", required=True)
    for name, what in (("thumbs", "images that need a small copy"), ("index", "frame manifest"), ("export", "annotated images"), ("report", "metrics as a page"), ("split", "batches of a manifest"), ("plan", "originals to keep")):
        p = sub.add_parser(name, help=what)
        p.add_argument("source")
        p.add_argument("out")
        p.add_argument("--size", type=int, default=150)
        p.add_argument("--originals")
        p.add_argument("--markdown", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("skyfold").getOrCreate()
    if a.command == "report":
        spark.createDataFrame([(report(spark, a.source, not a.markdown),)], "value string").coalesce(1).write.mode("overwrite").text(a.out)
        return
    make = {
        "thumbs": lambda: thumbs(spark, a.source),
        "index": lambda: index(spark, a.source),
        "export": lambda: export(spark, a.source),
        "split": lambda: split(tables.manifest(spark, a.source), a.size),
        "plan": lambda: plan(tables.decisions(spark, a.source), sources.list_images(spark, a.originals))[0],
    }
    make[a.command]().write.mode("overwrite").option("header", True).csv(a.out)
