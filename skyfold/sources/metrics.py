"""Metrics files: JSON in and out, and reports of one run or several as HTML, Markdown or fixed-width text."""

from __future__ import annotations

import datetime
import html as markup
import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sections of a metrics file.
LEVELS = ("mean", "std", "patch", "mask", "instance")
FACTS = ("config", "data", "run")
LABELS = {
    "ap": "AP (mAP, one class)", "auc": "ROC AUC", "f1": "F1", "precision": "Precision", "recall": "Recall", "mean_iou": "Mean IoU",
    "mean_dice": "Mean Dice", "mAP_50_95": "mAP@[.50:.95]", "AP_50": "AP@0.50", "AP_75": "AP@0.75",
}


def provenance(folder: str = ".") -> dict[str, str | None]:
    """Today's date and the folder's short commit, None without one."""
    try:
        commit = subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        commit = None
    return {"date": datetime.date.today().isoformat(), "commit": commit}


def read_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metrics files as (run, level, metric, value) and (run, section, name, value); a run is its file's path.

    Values that are no numbers, and levels or sections that a file lacks, have no rows.
    """
    maps = "map<string,string>"
    schema = "pipeline string, " + ", ".join(f"`{s}` {maps}" for s in (*LEVELS, *FACTS))
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("run"), F.from_json("value", schema).alias("d"))
    part = lambda s, names: files.select("run", F.lit(s).alias(names[0]), F.explode(f"d.{s}").alias(names[1], "value"))
    metrics = None
    for s in LEVELS:
        one = part(s, ("level", "metric")).withColumn("value", F.expr("try_cast(value AS double)")).filter("value IS NOT NULL")
        metrics = one if metrics is None else metrics.union(one)
    facts = files.select("run", F.lit("run").alias("section"), F.lit("pipeline").alias("name"), F.col("d.pipeline").alias("value")).filter("value IS NOT NULL")
    for s in FACTS:
        facts = facts.union(part(s, ("section", "name")).filter("value IS NOT NULL"))
    return metrics, facts


def metrics_json(metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """(run, json): each run's file, from the tables of ``read_metrics``."""
    per = lambda df, s, k, kind: df.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(kind) == s, F.struct(F.col(k).alias("key"), "value"))))).alias("__" + s))
    out = facts.filter((F.col("section") == "run") & (F.col("name") == "pipeline")).groupBy("run").agg(F.max("value").alias("pipeline"))
    rest = facts.filter(~((F.col("section") == "run") & (F.col("name") == "pipeline")))
    for s in LEVELS:
        out = out.join(per(metrics.filter(F.col("level") == s), s, "metric", "level"), "run", "left")
    for s in FACTS:
        out = out.join(per(rest.filter(F.col("section") == s), s, "name", "section"), "run", "left")
    fields = [F.col("pipeline"), *[F.col("__" + s).alias(s) for s in (*LEVELS, *FACTS)]]
    return out.select(F.col("run").alias("of"), F.to_json(F.struct(*fields)).alias("json")).withColumnRenamed("of", "run")


def write_metrics(metrics: DataFrame, facts: DataFrame, path: str) -> None:
    """Every run's file as JSON text, in a folder for each run number."""
    metrics_json(metrics, facts).select(F.col("json").alias("value"), F.xxhash64("run").cast("string").alias("run")).write.mode("overwrite").partitionBy("run").text(path)


def as_text(value) -> str:
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:.3f}"
    return "n/a" if value is None else str(value)


def label(name: str) -> str:
    return LABELS.get(name, name.replace("_", " "))


class Page:
    """Headings, sentences and tables, written as HTML or Markdown."""

    def __init__(self, as_html: bool):
        self.html, self.parts = as_html, []

    def heading(self, text: str, depth: int = 2) -> None:
        self.parts.append(f"<h{depth}>{markup.escape(text)}</h{depth}>" if self.html else "#" * depth + " " + text)

    def say(self, text: str) -> None:
        self.parts.append(f"<p>{markup.escape(text)}</p>" if self.html else text)

    def table(self, head: list[str], rows: list[list]) -> None:
        rows = [[as_text(x) for x in r] for r in rows]
        if self.html:
            row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{markup.escape(c)}</{tag}>" for c in cells) + "</tr>"
            self.parts.append("<table>" + row(head, "th") + "".join(row(r, "td") for r in rows) + "</table>")
        else:
            row = lambda cells: "| " + " | ".join(cells) + " |"
            self.parts.append("\n".join([row(head), row(["---"] * len(head)), *map(row, rows)]))

    def text(self) -> str:
        return ("" if self.html else "\n\n").join(self.parts)


def run_report(metrics: DataFrame, facts: DataFrame, as_html: bool = True) -> str:
    """A report of one run: settings, data, cross-validated means with their spread, and each level of a single split."""
    m = {(r.level, r.metric): r.value for r in metrics.collect()}
    f = {(r.section, r.name): r.value for r in facts.collect()}
    page = Page(as_html)
    page.heading(f.get(("run", "pipeline")) or "pipeline")
    page.say(f"Run {f.get(('run', 'date')) or 'unknown date'} at commit {f.get(('run', 'commit')) or 'unknown'}.")
    for section, title, head in (("config", "Configuration", "Setting"), ("data", "Data", "Measure")):
        rows = [[k.replace("_", " "), v] for (s, k), v in sorted(f.items()) if s == section]
        if rows:
            page.heading(title, 3)
            page.table([head, "Value"], rows)
    folded = [[label(k), v, m.get(("std", k))] for (s, k), v in sorted(m.items()) if s == "mean"]
    if folded:
        page.heading("Results, cross validated", 3)
        page.table(["Metric", "Mean", "Std"], folded)
    for level in ("patch", "mask", "instance"):
        rows = [[label(k), v] for (s, k), v in sorted(m.items()) if s == level]
        if rows:
            page.heading(f"{level.title()} level", 3)
            page.table(["Metric", "Value"], rows)
    return page.text()


def comparison_report(compared: DataFrame, as_html: bool = True) -> str:
    """A table with a row for each run of ``reports.compare_runs``."""
    rows = [r.asDict() for r in compared.orderBy("run").drop("run").collect()]
    page = Page(as_html)
    page.heading("Pipeline comparison")
    page.say("n/a stands for a level that a run does not report, not for a score of zero.")
    page.table(list(rows[0]) if rows else [], [list(r.values()) for r in rows])
    return page.text()


def fixed_width(rows: DataFrame) -> str:
    """A small table as text with padded columns."""
    data = [r.asDict() for r in rows.collect()]
    head = rows.columns
    cells = [head, *[[as_text(r[c]) for c in head] for r in data]]
    width = [max(len(r[k]) for r in cells) for k in range(len(head))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(r, width)) for r in cells)


def comparison_json(rows: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in rows.collect()], indent=1, default=str)
