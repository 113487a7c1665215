"""Rings, markers, files, guards, commands and reports against brute force, round trips and hand-made cases."""

import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import skyfold
from skyfold import commands, sources, streaming
from skyfold.functions import geo, names
from skyfold.operators import evaluate as ev
from skyfold.operators import geometry, grid, guards, reports, tiling, vector
from skyfold.sources import metrics, tables

XML = """<?xml version="1.0"?><annotations><image id="0" name="in/a_r0_c0.jpg" width="64" height="64">
<polygon label="plant" points="1,1;9,1;9,9"/><box label="marker" xtl="1" ytl="2" xbr="3" ybr="4"/></image><image id="1" name="b.jpg" width="64" height="64"/></annotations>"""
COCO = {"images": [{"id": 1, "file_name": "x/c.jpg"}, {"id": 2, "file_name": "d.jpg"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 1}, {"id": 6, "image_id": 1, "category_id": 1}], "categories": []}


def inside(ring, x, y):
    n, odd = len(ring), False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if min(y1, y2) <= y <= max(y1, y2) and min(x1, x2) - 1e-12 <= x <= max(x1, x2) + 1e-12 and abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) < 1e-9:
            return True
        if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return n >= 3 and odd


def ring_rows(spark, rings):
    return spark.createDataFrame([("t", k, [Row(x=float(x), y=float(y)) for x, y in r], 20, 20) for k, r in enumerate(rings)], f"tile string, inst int, ring {geometry.RING}, width int, height int")


def test_ring_cells(spark):
    rng = random.Random(5)
    rings = [[(rng.randint(-8, 96) / 4, rng.randint(-8, 96) / 4) for _ in range(rng.randint(3, 7))] for _ in range(40)] + [[(1, 1), (5, 1)], [(2, 2), (6, 2), (6, 5), (2, 5)]]
    got = {}
    for r in geometry.span_cells(geometry.ring_spans(ring_rows(spark, rings), ["tile", "inst"], 20), ["tile", "inst"]).collect():
        got.setdefault(r.inst, set()).add((r.r, r.c))
    for k, ring in enumerate(rings):
        assert got.get(k, set()) == ({(y, x) for y in range(20) for x in range(20) if inside(ring, x, y)} if len(ring) >= 3 else set()), k
    assert len(got[41]) == 20
    cells = spark.createDataFrame([("t", 2, 2), ("t", 3, 3), ("u", 2, 2)], "tile string, r int, c int")
    boxes = spark.createDataFrame([("t", 2, 2, 2, 2)], "tile string, x0 int, y0 int, x1 int, y1 int")
    assert {(r.tile, r.r) for r in geometry.erase_boxes(cells, boxes).collect()} == {("t", 3), ("u", 2)}


def peucker(line, tol):
    if len(line) < 3:
        return line
    (ax, ay), (bx, by) = line[0], line[-1]
    n = math.hypot(bx - ax, by - ay)
    off = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / n if n else math.hypot(x - ax, y - ay) for x, y in line[1:-1]]
    k = max(range(len(off)), key=lambda i: off[i])
    return peucker(line[: k + 2], tol)[:-1] + peucker(line[k + 1 :], tol) if off[k] > tol else [line[0], line[-1]]


def test_simplify(spark):
    rng = random.Random(6)
    rings = [[(20 + (8 + rng.random() * t) * math.cos(a / 30 * 6.283), 20 + (8 + rng.random() * t) * math.sin(a / 30 * 6.283)) for a in range(30)] for t in (0.1, 1, 4, 8)]
    for ring in rings:
        for tol in (0.2, 1.0, 3.0):
            k = min(range(30), key=lambda i: sum(ring[i]))
            p = ring[k:] + ring[:k]
            j = max(range(30), key=lambda i: sum(p[i]))
            want = peucker(p[: j + 1], tol)[:-1] + peucker(p[j:] + p[:1], tol)[:-1]
            got = geometry.thin_ring(np.array(ring), tol)
            assert np.allclose(got, want if len(want) >= 3 else ring)
            turned = geometry.thin_ring(np.roll(np.array(ring), 7, axis=0), tol)
            assert len(want) < 3 or np.allclose(got, turned)
    assert len(geometry.thin_ring(np.array(rings[0]), 0)) == 30
    out = geometry.simplify(ring_rows(spark, rings), 1.0).collect()
    assert all(3 <= len(r.ring) < 30 for r in out[:2])


def test_bearing(spark):
    rows = []
    for k, turn in enumerate((0, 90, 200)):  # a shaft with a flared head, turned
        for i in range(200):
            x = i / 4
            w = 0.5 if x < 37 else 12 * (50 - x) / 13
            for s in (-1, 0, 1):
                a = math.radians(turn)
                rows.append((k, x * math.cos(a) - s * w * math.sin(a), x * math.sin(a) + s * w * math.cos(a)))
    rows += [(9, float(i), 0.0) for i in range(100)] + [(8, 1.0, 1.0)]
    got = {r.k: r.bearing for r in geometry.bearings(spark.createDataFrame(rows, "k int, x double, y double"), "k").collect()}
    for k, turn in enumerate((0, 90, 200)):
        assert abs((got[k] - turn + 180) % 360 - 180) < 1.0
    assert got[9] is None and got[8] is None


def test_markers(spark):
    px = [("t", r, c, 240, 10) for r in range(5, 15) for c in range(5, 15) if (r, c) != (9, 9)] + [("t", 0, 0, 250, 5)] + [("t", 17, c, 250, 90) for c in range(20)]
    found, cells = geometry.detect_markers(spark.createDataFrame(px, "tile string, r int, c int, v int, s int"), 20, open_by=1, close_by=2, min_area=50)
    b = found.collect()
    assert len(b) == 1 and (b[0].area, b[0].x0, b[0].x1, b[0].fill) == (100, 5, 14, 1.0) and cells.count() == 100
    tiles = tiling.tile_grid(spark.createDataFrame([("t", 20, 20)], "source string, width int, height int"), 8, "shift")
    kept = {(r.row, r.col): (r.marker_px, r.kept) for r in geometry.tiles_to_keep(tiles, cells.withColumnRenamed("tile", "source"), 8, min_px=30).collect()}
    assert kept[(0, 0)] == (9, False) and kept[(1, 1)] == (49, True) and sum(n for n, _ in kept.values()) >= 100
    assert all(r.kept for r in geometry.tiles_to_keep(tiles, cells.withColumnRenamed("tile", "source"), 8, mode="all").collect())


def test_merged_runs(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 4), rng.randint(0, 9), c0, min(19, c0 + rng.randint(0, 6))) for c0 in (rng.randint(0, 19) for _ in range(150))]
    spans = spark.createDataFrame(rows, "tile int, r int, c0 int, c1 int")
    cells = spans.select("tile", "r", F.explode(F.sequence("c0", "c1")).alias("c")).distinct()
    merged = grid.merged_runs(spans, ["tile"], 20)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, grid.runs(cells, ["tile"]).select("tile", "r", "c0", "c1").collect()))
    assert sorted(map(tuple, grid.components_of_runs(merged).collect())) == sorted(map(tuple, grid.components(cells).collect()))
    half = merged.filter("tile < 3"), grid.merged_runs(spans.filter("c0 % 2 = 0"), ["tile"], 20)
    c = lambda m: m.select("tile", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    key = lambda df: sorted((r.tile, r.inter, r.n_pred, r.n_gt) for r in df.collect())
    assert key(ev.run_scores(*half)) == key(ev.mask_scores(c(half[0]), c(half[1])))


def square(tile, inst, r, c, n):
    return [(tile, inst, y, x) for y in range(r, r + n) for x in range(c, c + n)]


def test_perfect_and_constant_predictors(spark):
    """A perfect predictor scores near 1 at every level, a constant one the share of positives."""
    rng = random.Random(0)
    gt = [x for t in range(6) for k in range(2) for x in square(t, k, 2 + 14 * k, rng.randint(2, 20), rng.randint(5, 9))]
    truth = spark.createDataFrame(gt, "tile int, inst int, r int, c int").cache()
    every = spark.range(6).select(F.col("id").cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("c"))
    cells = every.join(truth.select("tile", "r", "c", F.lit(1).alias("y")).distinct(), ["tile", "r", "c"], "left").select("tile", "r", "c", F.coalesce("y", F.lit(0)).alias("y"))
    conf = truth.select("tile", F.col("inst").alias("pred")).distinct().withColumn("conf", F.lit(0.9))
    good = {(r.level, r.metric): r.value for r in reports.combined_score(cells.withColumn("p", F.col("y").cast("double")), truth, conf, truth, 32, 0.5, 4, 0).collect()}
    assert good[("patch", "ap")] > 0.99 and good[("mask", "mean_iou")] > 0.99 and good[("instance", "native_mAP_50_95")] > 0.95
    assert abs(good[("instance", "percent_of_achievable")] - 100) < 1e-6
    flat = {(r.level, r.metric): r.value for r in reports.three_levels(cells.withColumn("p", F.lit(0.5)), truth, 32, 0.5, 4, 0).collect()}
    assert abs(flat[("patch", "ap")] - flat[("patch", "prevalence")]) < 0.05
    none = reports.instance_map(reports.instance_ap(truth.limit(0), conf.limit(0), truth)).first()
    assert none.mAP_50_95 == 0.0 and none.n_pred == 0
    empty = reports.instance_map(reports.instance_ap(truth, conf, truth.limit(0))).first()
    assert math.isnan(empty.mAP_50_95) and empty.n_gt == 0


def greedy(preds, gts, t):
    taken, hits = set(), []
    for _, p in sorted(preds, key=lambda x: -x[0]):
        best, at = 0.0, None
        for k, g in enumerate(gts):
            iou = len(p & g) / len(p | g)
            if k not in taken and iou > best:
                best, at = iou, k
        if at is not None and best >= t:
            taken.add(at)
        hits.append(at is not None and best >= t)
    return hits


def test_matching_by_brute_force(spark):
    rng = random.Random(3)
    p, g, conf = [], [], []
    for t in range(12):
        for k in range(5):
            p += square(t, k, rng.randint(0, 6), rng.randint(0, 6), rng.randint(2, 6))
            g += square(t, k, rng.randint(0, 6), rng.randint(0, 6), rng.randint(2, 6))
            conf.append((t, k, round(rng.random(), 3)))
    kind = "tile int, inst int, r int, c int"
    pred, gt, cf = spark.createDataFrame(p, kind), spark.createDataFrame(g, kind), spark.createDataFrame(conf, "tile int, pred int, conf double")
    got = {(r.tile, r.pred): r.hits for r in ev.greedy_hits(cf, ev.instance_pairs(pred, gt)).collect()}
    cells = lambda rows, t, k: {(r, c) for a, b, r, c in rows if (a, b) == (t, k)}
    for t in range(12):
        ranked = sorted([(s, k) for a, k, s in conf if a == t], reverse=True)
        for j, step in enumerate(ev.IOU_STEPS):
            hits = greedy([(s, cells(p, t, k)) for s, k in ranked], [cells(g, t, k) for k in range(5)], step)
            assert [got[(t, k)][j] for _, k in ranked] == hits


def test_clusters(spark):
    rows = [(0, c, c == 1 or (c == 0 and i < 1), [float(c), 1.0]) for c in range(3) for i in range(4)] + [(1, 2, False, [1.0, 0.0])]
    p = spark.createDataFrame(rows, "tile int, cluster int, gt boolean, v array<double>")
    pick = {r.tile: (r.cluster, r.iou) for r in reports.oracle_pick(p).collect()}
    assert pick[0] == (1, 0.8) and pick[1] == (2, 0.0)
    means = reports.cluster_means(p)
    near = reports.centroid_pick(means, reports.mean_direction(means.filter("cluster = 2")))
    assert {r.tile: r.cluster for r in near.collect()} == {0: 2, 1: 2}
    a = reports.agreement(reports.oracle_pick(p), near).first()
    assert (a.agree, a.tiles, a.first_chose, a.second_chose) == (1, 2, [1, 2], [2])


# --- files -------------------------------------------------------------------


def test_images(spark, tmp_path):
    for n in ("a.JPG", "b.webp", "c.bmp", "d.txt", ".e.jpg", "batch_01/f.jpg", "g/a.JPG"):
        f = tmp_path / n
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"x")
    found = sources.list_images(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["a.JPG", "a.JPG", "b.webp", "c.bmp", "f.jpg"]
    first = {r.name: r.path for r in sources.by_basename(found).collect()}
    last = {r.name: r.path for r in sources.by_basename(found, "last").collect()}
    assert first["a.JPG"].endswith(f"{tmp_path.name}/a.JPG") and last["a.JPG"].endswith("g/a.JPG")
    out = tables.image_index(found, "last", without="g")
    assert [r.path for r in out.filter("name = 'a.JPG'").collect()][0].endswith(f"{tmp_path.name}/a.JPG")
    twice = tables.resolve_images(spark, [str(tmp_path / "g"), str(tmp_path), str(tmp_path / "b.webp")]).collect()
    assert len(twice) == 5 and {r.found for r in twice if r.path.endswith("g/a.JPG")} == {0}
    tiles = {r.name: r.batch for r in tables.collect_tiles(found).collect()}
    assert tiles["f.jpg"] == "batch_01" and tiles["b.webp"] is None
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.JPG\n\n  x y.jpg \n")
    assert [r.path for r in sources.path_list(spark, str(tmp_path / "list.txt")).collect()] == [f"{tmp_path}/a.JPG", "x y.jpg"]
    assert commands.thumbs(spark, str(tmp_path)).filter("proxy = 'b.jpg'").count() == 1


def test_exports(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("annotations.xml", XML)
        z.writestr("note.txt", "no")
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    (tmp_path / "two.json").write_text(json.dumps(COCO))
    got = tables.zip_members(spark, str(tmp_path))
    assert sorted(r.member for r in got.collect()) == ["annotations.xml", "two.json"]
    assert {r.kind for r in tables.annotation_kind(got).collect()} == {"cvat"}
    assert {r.kind for r in tables.annotation_kind(got, "coco").collect()} == {"coco"}
    rows = {r._name: r for r in tables.cvat_rows(got.filter("member LIKE '%xml'")).collect()}
    assert rows["in/a_r0_c0.jpg"].polygon[0]._points == "1,1;9,1;9,9" and rows["b.jpg"]._width == 64
    assert {r.name: r.shapes for r in commands.export(spark, str(tmp_path)).collect()} == {"a_r0_c0.jpg": 2, "b.jpg": 0}
    assert {r.name: r.shapes for r in commands.export(spark, str(tmp_path), "coco").collect()} == {"c.jpg": 2, "d.jpg": 0}


def test_tables(spark, tmp_path):
    t = tiling.tile_grid(spark.createDataFrame([("a", 40, 20), ("b", 20, 20)], "source string, width int, height int"), 20, "pad")
    t = t.withColumn("tile", names.tile_name(F.col("source"), F.col("row"), F.col("col"))).withColumn("kept", F.lit(1))
    assert tables.write_tiles(t, str(tmp_path / "none"), dry_run=True) == 3 and not (tmp_path / "none").exists()
    tables.write_tiles(t.withColumn("padded", F.col("padded").cast("int")), str(tmp_path / "m"))
    back = tables.manifest(spark, str(tmp_path / "m"))
    assert [r.tile for r in back.collect()] == ["a_r0_c0.jpg", "a_r0_c1.jpg", "b_r0_c0.jpg"] and back.filter("batch IS NOT NULL").count() == 0 and dict(back.dtypes)["x0"] == "int"
    m = spark.createDataFrame([("a", 1, 5, 1, 1, 4, 4, ["r0_c0"]), ("a", 2, 9, 18, 2, 23, 5, ["r0_c0", "r0_c1"])], "source string, blob int, area_px int, x0 int, y0 int, x1 int, y1 int, tiles array<string>")
    tables.write_markers(m, str(tmp_path / "k"))
    k = tables.markers(spark, str(tmp_path / "k")).collect()
    assert [r.blob for r in k] == [2, 1] and k[0].tiles == ["r0_c0", "r0_c1"]
    images = tables.task_images(t, m)
    tables.write_task(images, str(tmp_path / "x"))
    read = {r._name: r for r in sources.cvat_images(spark, str(tmp_path / "x")).collect()}
    assert {n: len(r.box) for n, r in read.items()} == {"a_r0_c0.jpg": 2, "a_r0_c1.jpg": 1} and read["a_r0_c1.jpg"].box[0]._xtl == 0.0 and sorted(r._id for r in read.values()) == [0, 1]
    given = spark.createDataFrame([("a_r0_c0.jpg", "batch_01"), ("a_r0_c1.jpg", "batch_02")], "tile string, batch string")
    combined, each = tables.batch_images(images.withColumn("_name", F.concat(F.lit("old/"), "_name")), given)
    assert sorted(r._name for r in combined.collect()) == ["batch_01/a_r0_c0.jpg", "batch_02/a_r0_c1.jpg"]
    tables.write_task(each, str(tmp_path / "y"), "batch")
    assert sources.cvat_images(spark, str(tmp_path / "y" / "batch=batch_02")).first()._name == "a_r0_c1.jpg"
    assert {x["name"] for x in json.loads(tables.label_schema("plant"))} == {"marker", "plant"}
    boxes = spark.createDataFrame([("t", 1, 2, 3, 4), ("t", 0, 0, 1, 1)], "tile string, marker_x0 int, marker_y0 int, marker_x1 int, marker_y1 int")
    assert [b.x0 for b in tables.marker_boxes(boxes).first().boxes] == [0, 1]
    f = spark.createDataFrame([("p", 1.0, 2.0), ("q", None, float("nan"))], "path string, lat double, lon double")
    assert tables.write_frames(f, str(tmp_path / "f")) == (2, 1)


def test_label_files_round_trip(spark, tmp_path):
    rings = ring_rows(spark, [[(1, 2), (7.3, 2), (5, 9.1)], [(-3, -3), (-1, -3), (-2, -1)]])
    tiles = spark.createDataFrame([("t", "f", "train")], "tile string, frame string, split string")
    texts = tables.write_yolo(tiles, rings.withColumn("tile", F.lit("t")), str(tmp_path / "set"), "plant", {"config": {"seed": 0}})
    about = json.loads(texts["split.json"])["data"]
    assert about["polygons_dropped"] == 1 and about["train"] == {"frames": 1, "tiles": 1, "polygons": 2} and "0: plant" in texts["data.yaml"]
    back = tables.pixels_of(sources.yolo_labels(spark, str(tmp_path / "set" / "labels" / "split=train" / "stem=t")), 20, 20).collect()
    assert len(back) == 1 and np.allclose([(p.x, p.y) for p in back[0].ring], [(1, 2), (7.3, 2), (5, 9.1)])


def test_metrics_files(spark, tmp_path):
    runs = [
        {"pipeline": "probe", "run": {"date": "2024-05-01", "commit": "abc"}, "config": {"backbone": "b16", "img_size": 512}, "mean": {"ap": 0.75, "f1": 0.5}, "std": {"ap": 0.1}, "folds": [1]},
        {"pipeline": "seg", "run": {"date": "2024-05-02"}, "patch": {"ap": 0.5, "f1": 0.25}, "mask": {"mean_iou": 0.125}, "instance": {"mAP_50_95": 0.0625, "per_iou": {"0.5": 1}}},
    ]
    for k, r in enumerate(runs):
        (tmp_path / f"{k}.json").write_text(json.dumps(r, indent=1))
    m, f = metrics.read_metrics(spark, str(tmp_path))
    c = {r.pipeline: r.asDict() for r in reports.compare_runs(m, f).collect()}
    assert c["probe"] | {"run": 0} == {"run": 0, "pipeline": "probe", "backbone": "b16", "img_size": "512", "AP": "0.750", "F1": "0.500", "IoU": "n/a", "mAP": "n/a", "date": "2024-05-01"}
    assert (c["seg"]["AP"], c["seg"]["IoU"], c["seg"]["mAP"], c["seg"]["backbone"]) == ("0.500", "0.125", "0.062", "?")
    metrics.write_metrics(m, f, str(tmp_path / "out"))
    again, facts = metrics.read_metrics(spark, str(tmp_path / "out" / "*"))
    key = lambda df: sorted((r[1], r[2], r[3]) for r in df.collect())
    assert key(again) == key(m) and key(facts) == key(f)
    one = commands.report(spark, str(tmp_path / "0.json"), as_html=False)
    assert "## probe" in one and "| AP (mAP, one class) | 0.750 | 0.100 |" in one
    both = commands.report(spark, str(tmp_path / "*.json"))
    assert "<td>probe</td>" in both and "<td>n/a</td>" in both
    table = reports.compare_runs(m, f).select("pipeline", "AP").orderBy("pipeline")
    assert metrics.fixed_width(table).splitlines()[1].split() == ["probe", "0.750"] and json.loads(metrics.comparison_json(table))[1]["AP"] == "0.500"
    assert set(metrics.provenance()) == {"date", "commit"}


# --- functions, guards, streams and commands -------------------------------------------------------------------


def test_small_functions(spark):
    v = spark.createDataFrame([("10", "30", "0", "S"), ("1", "x", "0", "N")], "a string, b string, c string, r string").select(geo.dms_to_degrees(F.col("a"), F.col("b"), F.col("c"), F.col("r")).alias("d")).collect()
    assert v[0].d == -10.5 and math.isnan(v[1].d)
    s = spark.createDataFrame([(0.0625,), (0.0635,), (None,), (2.5,)], "x double").select(names.three_places(F.col("x")).alias("s"), geo.approximate_pixels(F.col("x"), F.lit(256.0)).alias("p")).collect()
    assert [r.s for r in s] == ["0.062", "0.064", "n/a", "2.500"] and [r.p for r in s] == [16, 16, None, 640]
    assert spark.range(1).select(names.shown(F.lit(True), "boolean").alias("s")).first().s == "yes"
    w = spark.range(1).select(geo.crop_window(F.lit(2), F.lit(99), 10, F.lit(50), F.lit(60)).alias("w")).first().w
    assert (w.x0, w.y0, w.x1, w.y1) == (0, 40, 20, 60)
    assert guards.family_defaults("dinov2")["patch"] == 14
    with pytest.raises(ValueError):
        guards.family_defaults("none")
    assert grid.window_starts(32, 12, 6) == [0, 6, 12, 18, 20] and grid.window_starts(8, 12, 6) == [0]
    assert skyfold.patch_metrics is ev.at_threshold and "report" in skyfold.__all__


def test_half_even_split(spark):
    rows = spark.range(10).withColumnRenamed("id", "g")
    size = lambda share: vector.group_split(rows, "g", share, rounding="half_even").filter("split = 'val'").count()
    assert [size(s) for s in (0.01, 0.25, 0.35, 0.45)] == [1, 2, 4, 4]
    with pytest.raises(ValueError):
        vector.group_split(rows, "g", 1.0)
    assert vector.seeded_sample(rows, "g", 0.25).count() == 2


def test_heads_keep_their_contract(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.5] + rng.normal(scale=0.5, size=300) > 0).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    contract = {"patch": 16, "family": "dinov3"}
    commands.train(rows, str(tmp_path / "head"), contract)
    s = commands.predict(rows, str(tmp_path / "head"), contract, LogisticRegressionModel)
    p = np.array([r.p for r in s.orderBy("id").collect()])
    assert ((p > 0.5) == y).mean() > 0.9
    # The same objective by Newton's method: balanced weights, ridge 1 / n of their mean.
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    a, beta = np.hstack([x, np.ones((300, 1))]), np.zeros(4)
    ridge = np.array([1, 1, 1, 0]) / 300
    for _ in range(50):
        q = 1 / (1 + np.exp(-a @ beta))
        g = a.T @ (w * (q - y)) / w.sum() + ridge * beta
        beta -= np.linalg.solve((a * (w * q * (1 - q))[:, None]).T @ a / w.sum() + np.diag(ridge), g)
    model = guards.load_head(LogisticRegressionModel, str(tmp_path / "head"), contract)
    assert np.allclose([*model.coefficients, model.intercept], beta, atol=2e-3)
    with pytest.raises(ValueError, match="patch"):
        guards.load_head(LogisticRegressionModel, str(tmp_path / "head"), {"patch": 14})
    with pytest.raises(ValueError, match="no rows"):
        commands.train(rows.limit(0), str(tmp_path / "none"), contract)


def test_kmeans_takes_the_tightest_start(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(loc=(6 * (k % 4), 6 * (k // 4)), scale=0.3, size=(30, 2)) for k in range(8)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.cluster for r in vector.kmeans(rows, 8).collect()}
    lab = np.array([got[i] for i in range(240)])
    cost = sum(((x[lab == k] - x[lab == k].mean(0)) ** 2).sum() for k in set(lab))
    best = sum(((x[30 * k : 30 * k + 30] - x[30 * k : 30 * k + 30].mean(0)) ** 2).sum() for k in range(8))
    assert len(set(lab)) == 8 and cost <= best * 1.001


def test_files_are_built_once(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"))
    rows(0, 5).coalesce(1).write.parquet(str(tmp_path / "in"))
    build = lambda: streaming.build_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "k long", lambda s: s.withColumn("twice", F.col("k") * 2))
    assert build() == 5 and build() == 0
    rows(5, 7).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert build() == 2
    assert sorted(r.twice for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8, 10, 12]


def test_commands(spark):
    f = spark.createDataFrame([(f"a/{i}.jpg", f"2024-01-01 00:00:0{i}", -20.0 + i * 0.0001, 146.0) for i in range(8)], "path string, captured_at string, lat double, lon double")
    assert commands.dedup(f, nth=3).count() == 3 and commands.dedup(f, metres=25.0).count() == 3
    page = {r.path: (r.page, r.row, r.col) for r in commands.sheets(f, 2, 2).collect()}
    assert page["a/0.jpg"] == (0, 0, 0) and page["a/3.jpg"] == (0, 1, 1) and page["a/4.jpg"] == (1, 0, 0)
    acts = spark.createDataFrame([("x", 1, 1, "keep"), ("x", 2, 2, "keep"), ("y", 1, 3, "skip")], "name string, ts int, event_id int, action string")
    assert {r.name: r.decision for r in commands.review(acts).collect()} == {"x": "undecided", "y": "skip"}
    cells = spark.createDataFrame([("s.jpg", r, c) for r in range(10) for c in range(10)], "source string, r int, c int")
    t = commands.tile(spark.createDataFrame([("s.jpg", 32, 32)], "source string, width int, height int"), cells, 16, min_px=50)
    assert {r.tile: r.kept for r in t.collect()} == {"s_r0_c0.jpg": 1, "s_r0_c1.jpg": 0, "s_r1_c0.jpg": 0, "s_r1_c1.jpg": 0}
    assert [r.batch for r in commands.split(t, 10).collect()] == ["batch_01"]
    found = spark.createDataFrame([("s.jpg", 1, 0, 0, 10, 10)], "source string, blob int, x0 int, y0 int, x1 int, y1 int")
    assert commands.task(t, found).first()._name == "s_r0_c0.jpg"
    runs = {("a", 1): spark.createDataFrame([(0.9, 1), (0.1, 0)], "p double, y int"), ("b", 1): spark.createDataFrame([(0.1, 1), (0.9, 0)], "p double, y int")}
    assert [(r.head, r.ap) for r in commands.compare(runs, ("head", "size")).orderBy("place").collect()] == [("a", 1.0), ("b", 0.5)]
