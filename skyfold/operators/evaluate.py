"""Scores: patch, mask and instance metrics, matching and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions.names import three_places
from skyfold.operators.stored import ordered_parts, running_sums

IOU_STEPS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def by_score(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Running counts (p, tp, fp) down the distinct scores."""
    return by_counts(scored.groupBy(F.col(p).alias("p")).agg(F.sum(y).cast("long").alias("pos"), F.count("*").alias("n")))


def by_counts(g: DataFrame) -> DataFrame:
    """``by_score`` of counts (p, pos, n) of the distinct scores."""
    return running_sums(g, [F.desc("p")], tp="pos", seen="n").withColumn("fp", F.col("seen") - F.col("tp"))


def pr_curve(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    n_pos = scored.agg(F.sum(y).cast("long").alias("k")).first()["k"] or 0
    return by_score(scored, y, p).select("p", "pos", "n", "tp", "fp", ratio(F.col("tp"), F.col("seen")).alias("precision"), ratio(F.col("tp"), F.lit(n_pos)).alias("recall"), F.lit(n_pos).alias("n_pos"))


def average_precision(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Sum of precision times the step of recall over distinct scores."""
    c = pr_curve(scored, y, p)
    return c.agg(F.sum(F.when(F.col("n_pos") > 0, F.col("precision") * F.col("pos") / F.col("n_pos"))).alias("ap"))


def roc_auc(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Share of (positive, negative) pairs in order, ties half; null with one class only."""
    c = by_score(scored, y, p).withColumn("neg", F.col("n") - F.col("pos"))
    s = c.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2.0).alias("won"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return s.select(F.try_divide(F.col("won"), (F.col("np") * F.col("nn")).cast("double")).alias("auc"))


def ap_of_counts(curve: DataFrame) -> DataFrame:
    """``average_precision`` of running counts (p, pos, n, tp, seen)."""
    s = curve.agg(F.sum(ratio(F.col("tp"), F.col("seen")) * F.col("pos")).alias("s"), F.sum("pos").alias("k"))
    return s.select(F.try_divide(F.col("s"), F.col("k").cast("double")).alias("ap"))


def auc_of_counts(curve: DataFrame) -> DataFrame:
    """``roc_auc`` of running counts (p, pos, n, tp, seen)."""
    c = curve.withColumn("neg", F.col("n") - F.col("pos"))
    s = c.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2.0).alias("won"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return s.select(F.try_divide(F.col("won"), F.col("np").cast("double") * F.col("nn").cast("double")).alias("auc"))


def at_threshold(scored: DataFrame, t: float, y: str = "y", p: str = "p") -> DataFrame:
    hit = F.col(p) >= t
    s = scored.agg(F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"), F.count_if(~hit & (F.col(y) == 1)).alias("fn"), F.count("*").alias("n"))
    return rates(s)


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and prevalence of counts (tp, fp, fn, n)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"), ratio(tp + fn, F.col("n")).alias("prevalence"))


def threshold_sweep(scored: DataFrame, steps: int = 101, lo: float = 0.01, hi: float = 0.99, y: str = "y", p: str = "p") -> DataFrame:
    """(k, t, tp, fp, fn, f1) of evenly spaced thresholds, from one count for each slot between them."""
    ts = [lo + (hi - lo) * k / (steps - 1) for k in range(steps)]
    slot = F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: t <= F.col(p)))  # thresholds that are met
    h = scored.groupBy(slot.alias("s")).agg(F.sum(y).cast("long").alias("pos"), F.count("*").alias("n"))
    every = scored.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(ts)], "k int, t double")
    total = Window.partitionBy()
    met = every.join(h, F.col("s") >= F.col("k"), "left").groupBy("k", "t").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("seen"))
    all_pos = h.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("x")).first()["x"]
    met = met.withColumn("fp", F.col("seen") - F.col("tp")).withColumn("fn", F.lit(all_pos) - F.col("tp"))
    return met.select("k", "t", "tp", "fp", "fn", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1")).withColumn("best", F.max("f1").over(total) == F.col("f1"))


def best_f1(scored: DataFrame, **kw) -> DataFrame:
    """The lowest threshold of the highest F1."""
    return threshold_sweep(scored, **kw).agg(F.max(F.struct("f1", (-F.col("k")).alias("o"), "t")).alias("m")).select(F.col("m.t").alias("threshold"), F.col("m.f1").alias("f1"))


def mask_scores(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(tile, inter, n_pred, n_gt, iou, dice) of tiles where either mask has a cell."""
    cells = pred.select("tile", "r", "c", F.lit(1).alias("p"), F.lit(0).alias("g")).union(gt.select("tile", "r", "c", F.lit(0), F.lit(1)))
    cells = cells.groupBy("tile", "r", "c").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    t = cells.groupBy("tile").agg(F.sum(F.col("p") * F.col("g")).alias("inter"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gt"))
    return t.withColumn("iou", ratio(F.col("inter"), F.col("n_pred") + F.col("n_gt") - F.col("inter"))).withColumn("dice", ratio(2 * F.col("inter"), F.col("n_pred") + F.col("n_gt")))


def run_scores(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """``mask_scores`` of merged runs (tile, r, c0, c1): no cell is made."""
    from skyfold.operators.grid import shared_cells

    size = lambda runs, name: runs.groupBy("tile").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias(name))
    t = size(pred, "n_pred").join(size(gt, "n_gt"), "tile", "full").join(shared_cells(pred, gt, ["tile"]).withColumnRenamed("n", "inter"), "tile", "left")
    t = t.na.fill(0, ["inter", "n_pred", "n_gt"]).select("tile", "inter", "n_pred", "n_gt")
    return t.withColumn("iou", ratio(F.col("inter"), F.col("n_pred") + F.col("n_gt") - F.col("inter"))).withColumn("dice", ratio(2 * F.col("inter"), F.col("n_pred") + F.col("n_gt")))


def instance_pairs(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(tile, pred, gt, iou) of predicted and true instances (tile, inst, r, c) that share a cell."""
    p, g = pred.select("tile", F.col("inst").alias("pred"), "r", "c"), gt.select("tile", F.col("inst").alias("gt"), "r", "c")
    inter = p.join(g, ["tile", "r", "c"]).groupBy("tile", "pred", "gt").agg(F.count("*").alias("i"))
    sp, sg = p.groupBy("tile", "pred").agg(F.count("*").alias("np")), g.groupBy("tile", "gt").agg(F.count("*").alias("ng"))
    j = inter.join(sp, ["tile", "pred"]).join(sg, ["tile", "gt"])
    return j.select("tile", "pred", "gt", (F.col("i") / (F.col("np") + F.col("ng") - F.col("i"))).alias("iou"))


def greedy_hits(preds: DataFrame, pairs: DataFrame, steps=IOU_STEPS) -> DataFrame:
    """(tile, pred, conf, hits array): for each threshold whether the prediction claims a true instance.

    In a tile predictions go by falling confidence, then number; each takes the
    unclaimed instance of largest overlap, the lower number on ties, and claims it if the
    overlap reaches the threshold.
    """
    rows = preds.join(pairs, ["tile", "pred"], "left").groupBy("tile", "pred", "conf").agg(F.sort_array(F.collect_list(F.when(F.col("gt").isNotNull(), F.struct((-F.col("iou")).alias("neg"), "gt")))).alias("g"))
    tiles = rows.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("neg"), "pred", "g"))).alias("p"))

    def run(batches):
        for pdf in batches:
            out = []
            for tile, ps in zip(pdf["tile"], pdf["p"]):
                claimed = [set() for _ in steps]
                for x in ps:
                    hits = []
                    for k, t in enumerate(steps):
                        best = next((y for y in x["g"] if y["gt"] not in claimed[k]), None)
                        hit = best is not None and -best["neg"] >= t
                        if hit:
                            claimed[k].add(best["gt"])
                        hits.append(hit)
                    out.append((tile, x["pred"], -x["neg"], hits))
            yield pd.DataFrame(out, columns=["tile", "pred", "conf", "hits"])

    kind = dict(preds.dtypes)
    return tiles.mapInPandas(run, f"tile {kind['tile']}, pred {kind['pred']}, conf double, hits array<boolean>")


def interpolated_ap(hits: DataFrame, n_gt: int, points: int = 101, by: tuple = ()) -> DataFrame:
    """(by…, ap): mean over recall points of the best precision at that recall or more; rows (by…, tile, pred, conf, hit).

    Ties in confidence go by tile and prediction.  NaN without true instances; 0
    without predictions, where there are no groups.
    """
    spark = hits.sparkSession
    groups = hits.select(*by).distinct() if by else spark.range(1).select()
    if not n_gt:
        return groups.withColumn("ap", F.lit(float("nan")))
    one = hits.withColumn("h", F.col("hit").cast("long")).withColumn("one", F.lit(1).cast("long"))
    run = running_sums(one, [F.desc("conf"), F.asc("tile"), F.asc("pred")], by, tp="h", seen="one")
    # A row counts for the highest recall point that it reaches, and so for all below.
    q = F.expr(f"int(tp * {points - 1} div {int(n_gt)})")
    at = run.groupBy(*by, q.alias("q")).agg(F.max(F.col("tp") / F.col("seen")).alias("prec"))
    best = F.max("prec").over(Window.partitionBy(*by).orderBy(F.desc("q")))  # at most `points` rows a group
    every = groups.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    env = every.join(at, [*by, "q"], "left").withColumn("env", F.coalesce(best, F.lit(0.0)))
    return env.groupBy(*by).agg(F.avg("env").alias("ap"))


def ap_of_bits(hits: DataFrame, n_gt: int, steps: int, by: str = "job", points: int = 101) -> DataFrame:
    """(by, k, ap): ``interpolated_ap`` of each bit k of ``bits``, rows (by, tile, pred, conf, bits); no row where no prediction hits.

    All thresholds rank predictions alike, so they are ranked once.  Between hits
    precision only falls: rows that hit are enough, with their rank among all.
    """
    parts = ordered_parts(hits.select(by, "tile", "pred", "conf", "bits"), F.col(by), F.desc("conf"), F.asc("tile"), F.asc("pred"))
    bit = [F.getbit("bits", F.lit(k)).cast("long") for k in range(steps)]
    names = [f"__t{k}" for k in range(steps)] + ["__seen"]
    sums = [F.sum(b) for b in bit] + [F.count("*")]
    totals = parts.groupBy("__p", by).agg(*[x.alias(n) for x, n in zip(sums, names)])
    before = Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("__p", by, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias("b" + n) for n in names])
    here = Window.partitionBy("__p", by).orderBy(F.desc("conf"), F.asc("tile"), F.asc("pred")).rowsBetween(Window.unboundedPreceding, 0)
    run = parts.select("__p", by, "bits", *[x.over(here).alias(n) for x, n in zip(sums, names)]).filter("bits != 0")
    run = run.join(totals, ["__p", by])
    each = F.array(*[F.struct(F.lit(k).alias("k"), b.alias("h"), (F.col(n) + F.col("b" + n)).alias("tp")) for k, (b, n) in enumerate(zip(bit, names))])
    run = run.select(by, (F.col("__seen") + F.col("b__seen")).alias("seen"), F.explode(each).alias("x")).filter("x.h = 1").select(by, "x.k", "x.tp", "seen")
    q = F.expr(f"int(tp * {points - 1} div {int(n_gt)})")
    at = run.groupBy(by, "k", q.alias("q")).agg(F.max(F.col("tp") / F.col("seen")).alias("prec"))
    best = F.max("prec").over(Window.partitionBy(by, "k").orderBy(F.desc("q")))  # at most `points` rows a group
    every = at.select(by, "k").distinct().withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    env = every.join(at, [by, "k", "q"], "left").withColumn("env", F.coalesce(best, F.lit(0.0)))
    return env.groupBy(by, "k").agg(F.avg("env").alias("ap"))


def confusion(rows: DataFrame, y: str, yhat: str) -> DataFrame:
    return rows.groupBy(F.col(y).alias("truth"), F.col(yhat).alias("predicted")).agg(F.count("*").alias("n"))


def long_metrics(wide: DataFrame, run: Column, level: str) -> DataFrame:
    """(run, level, metric, value) of the numeric columns of a table of runs."""
    names = [c for c, t in wide.dtypes if t in ("double", "float", "int", "bigint")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return wide.select(run.alias("run"), F.lit(level).alias("level"), F.explode(pairs).alias("m")).select("run", "level", "m.metric", "m.value")


def side_by_side(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row a run with three decimals or n/a for each metric."""
    g = metrics.groupBy("run").agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    return g.select("run", *[three_places(F.col(n)).alias(n) for n in names])


def table_text(rows: list[dict], html: bool = False) -> str:
    """A small report table as HTML or Markdown."""
    if not rows:
        return ""
    head = list(rows[0])
    if html:
        line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"
        return "<table>" + line(head, "th") + "".join(line(r.values(), "td") for r in rows) + "</table>"
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *(line(r.values()) for r in rows)])


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(share, value): exact quantiles, linear between neighbours; null without rows.

    Distinct values are counted, and running counts over ordered ranges find the two
    neighbours of each: no task holds all values.
    """
    g = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    run = running_sums(g, [F.asc("__v")], upto="__n")
    n = run.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    out = rows.sparkSession.createDataFrame([(float(s), max(n - 1, 0) * float(s)) for s in shares], "share double, at double")
    out = out.withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    near = (F.col("upto") > F.col("low")) & (F.col("upto") - F.col("__n") <= F.col("high"))
    j = run.join(F.broadcast(out), near)  # as many rows as shares
    inside = lambda k: F.max(F.when((F.col("upto") > F.col(k)) & (F.col("upto") - F.col("__n") <= F.col(k)), F.col("__v")))
    both = j.groupBy("share", "at", "low").agg(inside("low").alias("a"), inside("high").alias("b"))
    both = out.join(both.drop("at", "low"), "share", "left")
    return both.select("share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("low"))).alias(value))
