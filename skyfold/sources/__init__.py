"""Readers and writers of survey files, each a DataFrame with a fixed schema."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.functions.geo import parse_points

#: Image extensions, and the shape elements of an annotation file.
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")
SHAPES = ("polygon", "box", "mask", "polyline", "points", "ellipse", "cuboid")
FRAME_SCHEMA = "path string, name string, bytes long, width int, height int, captured_at timestamp, exif_error string, lat double, lon double, alt double"
CVAT_SCHEMA = "_id long, _name string, _width int, _height int, " + ", ".join(f"{s} array<struct<_label:string,_points:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double>>" for s in SHAPES)
COCO_SCHEMA = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint>>, categories array<struct<id:bigint,name:string>>"


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, bytes) of image files at any depth, without hidden ones; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    f = files.withColumn("name", F.substring_index("path", "/", -1))
    ext = F.lower(F.substring_index("name", ".", -1))
    return f.filter(ext.isin(*IMAGES) & ~F.col("name").startswith(".")).select("path", "name", "bytes")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """One path a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter(F.length("path") > 0)


def by_basename(files: DataFrame, keep: str = "first") -> DataFrame:
    """One path for each base name: the first or last in path order."""
    return files.groupBy("name").agg((F.min if keep == "first" else F.max)("path").alias("path"))


def first_of_each(paths: DataFrame, key: str, order: str) -> DataFrame:
    """Duplicates removed, the first in order kept."""
    w = Window.partitionBy(key).orderBy(order)
    return paths.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


# --- EXIF -------------------------------------------------------------------


def _ifd(data: bytes, base: int, at: int, order: str) -> dict:
    """The entries of a TIFF directory: tag -> value."""
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    out = {}
    (n,) = struct.unpack_from(order + "H", data, base + at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, base + at + 2 + 12 * k)
        length = size.get(kind, 1) * count
        pos = base + at + 10 + 12 * k
        if length > 4:
            pos = base + struct.unpack_from(order + "I", data, pos)[0]
        raw = data[pos : pos + length]
        if len(raw) < length:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("latin-1")
        elif kind in (3, 4, 9):
            out[tag] = struct.unpack(order + f"{count}{ {3: 'H', 4: 'I', 9: 'i'}[kind] }", raw)
        elif kind in (5, 10):
            v = struct.unpack(order + f"{2 * count}{'I' if kind == 5 else 'i'}", raw)
            out[tag] = [a / b if b else float("nan") for a, b in zip(v[::2], v[1::2])]
        else:
            out[tag] = raw
    return out


def read_exif(data: bytes) -> dict:
    """Size, time and position from a JPEG's headers; pixels are not decoded."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out: dict = {"width": None, "height": None, "time": None, "lat": None, "lon": None, "alt": None}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            break
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = struct.unpack(">HH", body[1:5])
            break
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            order = "<" if body[6:8] == b"II" else ">"
            main = _ifd(body, 6, struct.unpack_from(order + "I", body, 10)[0], order)
            sub = _ifd(body, 6, main[0x8769][0], order) if 0x8769 in main else {}
            out["time"] = sub.get(0x9003) or main.get(0x0132)
            if 0x8825 in main:
                g = _ifd(body, 6, main[0x8825][0], order)
                for name, ref, val in (("lat", 1, 2), ("lon", 3, 4)):
                    if val in g and len(g[val]) == 3:
                        d = g[val][0] + g[val][1] / 60 + g[val][2] / 3600
                        out[name] = round(-d if str(g.get(ref, "")).upper() in ("S", "W") else d, 7)
                if 6 in g:
                    out["alt"] = round(g[6][0], 2)
        if marker == 0xDA:
            break
        at += 2 + length
    return out


def frame_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The frames of a folder; a file that can't be read keeps its row, with the error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.filter(F.lower(F.substring_index("path", ".", -1)).isin("jpg", "jpeg"))

    def run(batches):
        for pdf in batches:
            rows = []
            for path, size, data in zip(pdf["path"], pdf["length"], pdf["content"]):
                try:
                    x, error = read_exif(bytes(data)), None
                except Exception as e:  # noqa: BLE001 one bad frame must not end the pass
                    x, error = {}, f"{type(e).__name__}: {e}"
                when = pd.to_datetime(x.get("time"), format="%Y:%m:%d %H:%M:%S", errors="coerce")
                rows.append((path, path.rsplit("/", 1)[-1], size, x.get("width"), x.get("height"), None if pd.isna(when) else when, error, x.get("lat"), x.get("lon"), x.get("alt")))
            out = pd.DataFrame(rows, columns=["path", "name", "bytes", "width", "height", "captured_at", "exif_error", "lat", "lon", "alt"])
            yield out.astype({"width": "Int32", "height": "Int32", "captured_at": "datetime64[us]", "lat": "float64", "lon": "float64", "alt": "float64"})

    return files.select("path", "length", "content").mapInPandas(run, FRAME_SCHEMA)


# --- annotations -------------------------------------------------------------------


def cvat_images(spark: SparkSession, path: str) -> DataFrame:
    """The image elements of annotation XML files."""
    return spark.read.format("xml").option("rowTag", "image").schema(CVAT_SCHEMA).load(path)


def zipped_texts(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """(path, member, text): the first member with the suffix in each zip; unreadable zips give none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        member = next((n for n in sorted(z.namelist()) if n.lower().endswith(suffix)), None)
                        if member:
                            rows.append((p, member, z.read(member).decode("utf-8")))
                except (zipfile.BadZipFile, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, text string")


def polygons(images: DataFrame, label: str | None = None) -> DataFrame:
    """(tile, inst, label, ring, width, height) of polygons with three points or more."""
    p = images.select(F.col("_name").alias("tile"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.posexplode("polygon").alias("inst", "p"))
    p = p.select("tile", "inst", F.col("p._label").alias("label"), parse_points(F.col("p._points")).alias("ring"), "width", "height").filter(F.size("ring") >= 3)
    return p.filter(F.col("label") == label) if label else p


def shape_counts(images: DataFrame) -> DataFrame:
    """(name, shapes) over all kinds of shape; names that repeat are summed."""
    n = sum((F.coalesce(F.size(s), F.lit(0)) for s in SHAPES), F.lit(0))
    return images.groupBy(F.substring_index("_name", "/", -1).alias("name")).agg(F.sum(n).alias("shapes"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COCO_SCHEMA).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def coco_counts(files: DataFrame) -> DataFrame:
    """(file, name, shapes): annotations of each image, none included."""
    images = files.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), F.substring_index("i.file_name", "/", -1).alias("name"))
    notes = files.select("file", F.explode("annotations").alias("a")).groupBy("file", F.col("a.image_id").alias("image_id")).agg(F.count("*").alias("shapes"))
    return images.join(notes, ["file", "image_id"], "left").select("file", "name", F.coalesce("shapes", F.lit(0)).alias("shapes"))


def merge_coco(files: DataFrame) -> DataFrame:
    """(file, image_id, new_id, name): ids that are unique over all files."""
    i = files.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("name"))
    return i.withColumn("new_id", F.dense_rank().over(Window.orderBy("file", "image_id")))


def sniff(text: str) -> str | None:
    """``cvat``, ``coco`` or None, by content."""
    head = text.lstrip()[:4000]
    if head.startswith("<"):
        return "cvat" if "<annotations" in head else None
    try:
        x = json.loads(text)
    except ValueError:
        return None
    return "coco" if isinstance(x, dict) and {"images", "annotations"} <= x.keys() else None


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, cls, ring) of label lines with three points or more, in the unit square."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("t")).filter(F.size("t") >= 7)
    ring = F.transform(F.sequence(F.lit(1), F.size("t") - 2, F.lit(2)), lambda i: F.struct(F.col("t")[i].cast("double").alias("x"), F.col("t")[i + 1].cast("double").alias("y")))
    return t.select("file", F.col("t")[0].cast("int").alias("cls"), ring.alias("ring"))


def yolo_line(cls, ring):
    """A label line from a class and a ring in the unit square."""
    return F.concat_ws(" ", cls.cast("string"), F.array_join(F.flatten(F.transform(ring, lambda p: F.array(p["x"].cast("string"), p["y"].cast("string")))), " "))


def write_text(df: DataFrame, path: str, by: str | None = None) -> None:
    """One string column as text files, in a folder for each value of ``by``."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def write_manifest(df: DataFrame, path: str, order: list[str]) -> None:
    """A sorted CSV with a header; ranges of the order are written in parallel."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)
