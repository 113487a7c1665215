"""Manifests, crib sheets, decisions and annotation tasks: typed readers, and writers whose files read back the same."""

from __future__ import annotations

import io
import json
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold import sources
from skyfold.functions import geo
from skyfold.operators import tiling

MANIFEST = "tile string, source string, row int, col int, x0 int, y0 int, x1 int, y1 int, width int, height int, padded int, kept int, marker_px int, marker_blobs int, batch string"
MARKERS = "source string, blob int, area_px int, x0 int, y0 int, x1 int, y1 int, bbox_w int, bbox_h int, fill double, tiles string"
DECISIONS = "name string, decision string, source string"
CRIB = "tile string, marker_uid string, arrow_colour string, marker_x0 int, marker_y0 int, marker_x1 int, marker_y1 int"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, by column name; columns that the file lacks are null, others are left out, bad values are null."""
    raw = spark.read.option("header", True).csv(path)
    have = {c.lower(): c for c in raw.columns}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return raw.select(*[F.expr(f"try_cast(`{have[n.lower()]}` AS {t})").alias(n) if n.lower() in have else F.lit(None).cast(t).alias(n) for n, t in fields])


def manifest(spark, path) -> DataFrame:
    return read_table(spark, path, MANIFEST)


def markers(spark, path) -> DataFrame:
    """Markers with the names of their tiles as a list."""
    return read_table(spark, path, MARKERS).withColumn("tiles", F.filter(F.split(F.coalesce("tiles", F.lit("")), r"\s+"), lambda t: t != ""))


def decisions(spark, path) -> DataFrame:
    return read_table(spark, path, DECISIONS)


def marker_boxes(crib: DataFrame) -> DataFrame:
    """(tile, boxes): the marker boxes of each tile, by place."""
    box = F.struct(F.col("marker_x0").alias("x0"), F.col("marker_y0").alias("y0"), F.col("marker_x1").alias("x1"), F.col("marker_y1").alias("y1"))
    return crib.groupBy("tile").agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def resolve_images(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path, name, bytes) of images by files, folders and globs; each once, in the order of the patterns that found it first (``found``)."""
    per = [sources.list_images(spark, p).withColumn("found", F.lit(k)) for k, p in enumerate(patterns)]
    return reduce(DataFrame.union, per).groupBy("path").agg(F.min("found").alias("found"), F.first("name").alias("name"), F.first("bytes").alias("bytes"))


def image_index(files: DataFrame, keep: str = "first", without: str | None = None) -> DataFrame:
    """``by_basename`` over the files outside a folder of this name."""
    return sources.by_basename(files.filter(~F.col("path").contains(f"/{without}/")) if without else files, keep)


def collect_tiles(files: DataFrame) -> DataFrame:
    """(name, path, batch) of tiles, loose or in a folder ``batch_NN``; a name in both is taken from its folder."""
    t = files.withColumn("batch", F.nullif(F.regexp_extract("path", r"/(batch_\d+)/[^/]+$", 1), F.lit("")))
    best = F.min(F.struct(F.col("batch").isNull().alias("loose"), "path", "batch"))
    return t.groupBy("name").agg(best.alias("b")).select("name", "b.path", "b.batch")


def stale(existing: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """What earlier runs wrote and this one doesn't keep."""
    return existing.join(kept.select(key).distinct(), key, "left_anti")


def first_names(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in name order, for a trial run."""
    return rows.orderBy(order).limit(n)


# --- annotation files -------------------------------------------------------------------


def zip_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".xml", ".json")) -> DataFrame:
    """(path, member, text) of the members with a suffix in the zips of a folder; its loose files with one are their own member.

    Unreadable zips and members give no rows.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                data = bytes(data)
                if not p.lower().endswith(".zip"):
                    pairs = [(p.rsplit("/", 1)[-1], data)]
                else:
                    try:
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            pairs = [(n, z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith(suffixes)]
                    except zipfile.BadZipFile:
                        continue
                for name, raw in pairs:
                    try:
                        rows.append((p, name, raw.decode("utf-8")))
                    except UnicodeDecodeError:
                        continue
            yield pd.DataFrame(rows, columns=["path", "member", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = reduce(lambda a, b: a | b, [F.lower("path").endswith(s) for s in (".zip", *suffixes)])
    return files.filter(wanted).select("path", "content").mapInPandas(run, "path string, member string, text string")


def annotation_kind(texts: DataFrame, pin: str | None = None) -> DataFrame:
    """``texts`` with ``kind``, cvat or coco, by content; with ``pin`` only files of that kind, else of the kind that comes first by path."""
    sniff = sources.sniff

    @F.pandas_udf("string")
    def kind(texts: pd.Series) -> pd.Series:
        return texts.map(sniff).astype(object)

    t = texts.withColumn("kind", kind("text")).filter("kind IS NOT NULL")
    if pin:
        return t.filter(F.col("kind") == pin)
    first = t.agg(F.min_by("kind", F.struct("path", "member")).alias("__k"))
    return t.join(F.broadcast(first), F.col("kind") == F.col("__k"), "left_semi")  # one row


def cvat_rows(texts: DataFrame) -> DataFrame:
    """Image elements, as ``sources.cvat_images`` reads them, of XML texts with their path."""
    image = "struct<" + sources.CVAT_SCHEMA.replace("<", "\0").replace(", ", ",").replace("\0", "<").replace(" ", ":") + ">"
    parsed = texts.select("path", F.from_xml("text", f"image array<{image}>", {"rowTag": "annotations"}).alias("d"))
    return parsed.select("path", F.explode("d.image").alias("i")).select("path", "i.*")


def wanted_notes(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, image_id, id) of the COCO annotations on wanted images (name)."""
    images = files.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), F.substring_index("i.file_name", "/", -1).alias("name"))
    keep = images.join(wanted, "name", "left_semi").select("file", "image_id")
    return files.select("file", F.explode("annotations").alias("a")).select("file", F.col("a.image_id").alias("image_id"), F.col("a.id").alias("id")).join(keep, ["file", "image_id"], "left_semi")


def with_batch(manifest_rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """A manifest whose kept tiles have the batch (tile, batch) that they are assigned to, others an empty one."""
    rows = manifest_rows.drop("batch").join(assigned.select("tile", "batch"), "tile", "left")
    return rows.withColumn("batch", F.when(F.col("kept") == 1, F.coalesce("batch", F.lit(""))).otherwise(""))


def task_images(tiles: DataFrame, found: DataFrame, colours: DataFrame | None = None) -> DataFrame:
    """Image elements of an annotation task, one for each kept tile that a marker meets, with the markers' clipped boxes.

    ``tiles``: (tile, source, row, col, x0, y0, x1, y1, kept); ``found``: (source, blob,
    x0, y0, x1, y1).  Numbers are running counts in name order.  A tile whose boxes
    all clip to nothing has none, but stays.
    """
    pairs = tiling.crib(tiling.blobs_on_tiles(found, tiles.filter("kept = 1"), 1024))
    c = F.col
    uid = F.concat("b_source", F.lit("#"), c("b_blob").cast("string"))
    if colours is not None:
        pairs = pairs.join(colours.select(c("source").alias("b_source"), c("blob").alias("b_blob"), "arrow_colour"), ["b_source", "b_blob"], "left")
    else:
        pairs = pairs.withColumn("arrow_colour", F.lit("unknown"))
    attribute = lambda n, v: F.struct(F.lit(n).alias("_name"), v.alias("_VALUE"))
    box = F.struct(
        F.lit("marker").alias("_label"), c("clip_x0").alias("_xtl"), c("clip_y0").alias("_ytl"), c("clip_x1").alias("_xbr"), c("clip_y1").alias("_ybr"),
        F.array(attribute("arrow_colour", F.coalesce("arrow_colour", F.lit("unknown"))), attribute("marker_uid", uid)).alias("attribute"),
    )
    solid = (c("clip_x1") > c("clip_x0")) & (c("clip_y1") > c("clip_y0"))
    images = pairs.groupBy(c("t_tile").alias("_name"), (c("t_x1") - c("t_x0")).alias("_width"), (c("t_y1") - c("t_y0")).alias("_height")).agg(F.array_sort(F.collect_list(F.when(solid, box)), lambda a, b: F.when(a["_xtl"] != b["_xtl"], a["_xtl"] - b["_xtl"]).when(a["_ytl"] != b["_ytl"], a["_ytl"] - b["_ytl"]).when(a["attribute"][1]["_VALUE"] < b["attribute"][1]["_VALUE"], -1).otherwise(1)).alias("box"))
    return tiling.batches(images, 1 << 30, "_name").select(c("image_id").alias("_id"), "_name", "_width", "_height", "box")


def batch_images(images: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Image elements by batch: of the combined task, names led by the batch; and of each batch (batch, elements), bare names numbered from 0.

    An earlier prefix of a name doesn't count; images without a batch go.
    """
    base = images.withColumn("_name", F.substring_index("_name", "/", -1)).join(assigned.select(F.col("tile").alias("_name"), "batch"), "_name")
    combined = base.withColumn("_name", F.concat("batch", F.lit("/"), "_name")).drop("batch")
    w = Window.partitionBy("batch").orderBy("_name")  # a batch has at most its size of rows
    return combined.select(*images.columns), base.withColumn("_id", F.row_number().over(w) - 1).select("batch", *images.columns)


def write_task(images: DataFrame, path: str, by: str | None = None) -> None:
    """Image elements as annotation XML, one file a partition, or a folder for each value of ``by``."""
    w = images.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "image").option("declaration", "version=\"1.0\" encoding=\"UTF-8\"")
    (w.partitionBy(by) if by else w).save(path)


def label_schema(plant: str) -> str:
    """The labels of a task as JSON: the marker's box and the plant's polygon with their attributes."""
    pick = lambda name, values, default: {"name": name, "input_type": "select", "mutable": True, "values": values, "default_value": default}
    free = lambda name, mutable: {"name": name, "input_type": "text", "mutable": mutable, "values": [""], "default_value": ""}
    colours = ["blue", "pink", "blank"]
    marker = {"name": "marker", "type": "rectangle", "attributes": [pick("arrow_colour", [*colours, "unknown"], "blank"), free("arrow_deg", True), free("marker_uid", False)]}
    leaf = {"name": plant, "type": "polygon", "attributes": [free("marker_uid", True), pick("class", [*colours, "unsure"], "unsure"), {"name": "partial", "input_type": "checkbox", "mutable": True, "values": ["false"], "default_value": "false"}]}
    return json.dumps([marker, leaf], indent=1)


def write_tiles(rows: DataFrame, path: str, dry_run: bool = False) -> int:
    """The tile manifest sorted by source, row and column; a dry run only counts."""
    if dry_run:
        return rows.count()
    sources.write_manifest(rows, path, ["source", "row", "col"])
    return -1


def write_markers(rows: DataFrame, path: str) -> None:
    """The marker table, each source's largest first; lists of tiles become words."""
    flat = rows.withColumn("tiles", F.array_join("tiles", " ")) if dict(rows.dtypes).get("tiles", "").startswith("array") else rows
    flat.orderBy("source", F.desc("area_px"), "blob").write.mode("overwrite").option("header", True).csv(path)


def write_frames(frames: DataFrame, path: str) -> tuple[int, int]:
    """The frame manifest as CSV; how many frames there are and how many have a position."""
    sources.write_manifest(frames, path, ["path"])
    n = frames.agg(F.count("*").alias("n"), F.count_if(geo.known(F.col("lat")) & geo.known(F.col("lon"))).alias("located")).first()
    return n["n"], n["located"]


def write_batches(files: DataFrame, path: str) -> None:
    """(batch, name, content) as files' rows in a folder for each batch; batches of an earlier, larger split go."""
    files.write.mode("overwrite").partitionBy("batch").parquet(path)


# --- training sets -------------------------------------------------------------------


def yolo_rows(rings: DataFrame, cls: int = 0) -> tuple[DataFrame, DataFrame]:
    """Label lines (tile, inst, line) of rings (tile, inst, ring, width, height), and one row with how many rings collapsed."""
    unit = rings.withColumn("unit", geo.clip_normalise(F.col("ring"), F.col("width"), F.col("height")))
    kept = unit.filter("unit IS NOT NULL").select("tile", "inst", sources.yolo_line(F.lit(cls), F.col("unit")).alias("line"))
    return kept, unit.agg(F.count_if(F.col("unit").isNull()).alias("dropped"))


def pixels_of(labels: DataFrame, width: int, height: int) -> DataFrame:
    """Rings of the unit square in pixels."""
    return labels.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"))))


def split_counts(tiles: DataFrame, rings: DataFrame) -> DataFrame:
    """(split, frames, tiles, polygons) of tiles (tile, frame, split) and their rings."""
    n = rings.groupBy("tile").agg(F.count("*").alias("n"))
    j = tiles.join(n, "tile", "left").groupBy("split", "frame").agg(F.count("*").alias("t"), F.coalesce(F.sum("n"), F.lit(0)).alias("p"))
    return j.groupBy("split").agg(F.count("*").alias("frames"), F.sum("t").alias("tiles"), F.sum("p").alias("polygons"))


def write_yolo(tiles: DataFrame, rings: DataFrame, path: str, class_name: str, facts: dict) -> dict:
    """Label lines under labels/split/tile, and the texts of data.yaml and split.json, which are also returned."""
    lines, dropped = yolo_rows(rings)
    placed = lines.join(tiles.select("tile", "split"), "tile")
    placed.repartition("split", "tile").sortWithinPartitions("split", "tile", "inst").select("split", F.regexp_replace("tile", r"\.[^.]*$", "").alias("stem"), "line").write.mode("overwrite").partitionBy("split", "stem").text(f"{path}/labels")
    counts = {r["split"]: {k: r[k] for k in ("frames", "tiles", "polygons")} for r in split_counts(tiles, rings).collect()}
    yaml = f"path: {path}\ntrain: images/train\nval: images/val\nnc: 1\nnames:\n  0: {class_name}\n"
    about = json.dumps({**facts, "data": {"class": class_name, **counts, "polygons_dropped": dropped.first()["dropped"]}}, indent=1)
    spark = tiles.sparkSession
    for name, text in (("data.yaml", yaml), ("split.json", about)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    return {"data.yaml": yaml, "split.json": about}
