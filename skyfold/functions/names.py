"""Names of frames, tiles and markers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat_name(path: Column) -> Column:
    """A relative path as one unique file name: no extension, separators as ``__``, then .jpg."""
    stem = F.regexp_replace(path, r"\.[^./\\]*$", "")
    return F.concat(F.regexp_replace(stem, r"[/\\]", "__"), F.lit(".jpg"))


def tile_name(stem: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_r%d_c%d.jpg", stem, row, col)


def source_of(tile: Column) -> Column:
    """The frame of a tile: all before the last ``_r``, or the whole name without one."""
    return F.when(F.instr(tile, "_r") > 0, F.regexp_extract(tile, r"(?s)^(.*)_r", 1)).otherwise(tile)


def marker_uid(stem: Column, blob: Column) -> Column:
    return F.concat(stem, F.lit("#"), blob.cast("string"))


def batch_name(number: Column, count: Column) -> Column:
    """``batch_NN``, padded to two digits or as many as the count of batches has."""
    width = F.greatest(F.lit(2), F.length(count.cast("string")))
    return F.concat(F.lit("batch_"), F.lpad(number.cast("string"), width, F.lit("0")))


def metric_label(name: Column, labels: dict[str, str] | None = None) -> Column:
    out = F.replace(name, F.lit("_"), F.lit(" "))
    for k, v in (labels or {}).items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def three_places(value: Column) -> Column:
    """A number with three decimals, ties to the even one, or n/a."""
    tie = F.abs(value * 2000 % 2) == 1
    return F.when(value.isNotNull(), F.format_string("%.3f", F.when(tie, F.bround(value.cast("double"), 3)).otherwise(value.cast("double")))).otherwise(F.lit("n/a"))


def shown(value: Column, kind: str) -> Column:
    """A value as a report shows it: numbers with three decimals, truth as yes or no, else as text."""
    if kind in ("double", "float"):
        return three_places(value)
    if kind == "boolean":
        return F.when(value, "yes").when(~value, "no").otherwise("n/a")
    return F.coalesce(value.cast("string"), F.lit("n/a"))
