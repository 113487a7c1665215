"""Hand-made cases and properties of the survey operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold import sources
from skyfold.functions import geo, names
from skyfold.operators import evaluate as ev
from skyfold.operators import grid, tiling, triage, vector
from skyfold.streaming import next_state, triage_states


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_names(spark):
    assert one(spark, names.flat_name(F.lit("a/b/c.JPG"))) == "a__b__c.jpg"
    assert one(spark, names.source_of(F.lit("x_r1_r2_c3.jpg"))) == "x_r1"
    assert one(spark, names.source_of(F.lit("plain"))) == "plain"
    assert one(spark, names.three_places(F.lit(None).cast("double"))) == "n/a"


@pytest.mark.parametrize("edge,want", [("shift", [0, 4, 6]), ("pad", [0, 4, 8]), ("crop", [0, 4])])
def test_tile_origins(spark, edge, want):
    assert one(spark, geo.tile_origins(F.lit(10), 4, edge)) == want


def test_clip_normalise(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-5, 0), (-1, 0), (20, 0), (20, 20))])
    got = one(spark, geo.clip_normalise(ring, F.lit(10), F.lit(10)))
    assert [(p.x, p.y) for p in got] == [(0, 0), (1, 0), (1, 1)]


def test_min_spacing_keeps_unlocated_and_ignores_nan(spark):
    df = spark.createDataFrame([(1, 1, float("nan"), 0.0), (2, 1, 0.0, 0.0), (3, 1, 0.0, 0.0001), (4, 1, 0.0, 0.001), (5, 1, None, None)], "id long, f int, lat double, lon double")
    got = {r.id for r in triage.min_spacing(df, 50.0, "f", ["id"], "id").collect()}
    assert got == {1, 2, 4, 5}


def test_last_state(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9), i, rng.choice(["keep", "skip", "undo"])) for i in range(200)]
    want = {}
    for n, _, a in rows:
        want[n] = next_state(want.get(n), a)
    df = spark.createDataFrame(rows, "name int, i int, action string")
    got = {r.name: r.state for r in triage.last_state(df, "name", ["i"]).collect()}
    assert got == {n: s or "undecided" for n, s in want.items()}


def test_streamed_states_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"n{rng.randint(0, 5)}", i, rng.choice(["keep", "skip", "undo"])) for i in range(120)]
    for k in range(3):
        part = spark.createDataFrame(rows[k * 40 : k * 40 + 40], "name string, event_id int, action string").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        out = []
        q = triage_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
        q.awaitTermination(60)
        seen = dict(seen if k else {}, **{r.name: r.state for r in out})
    want = {}
    for n, _, a in rows:
        want[n] = next_state(want.get(n), a)
    assert seen == {n: s or "undecided" for n, s in want.items()}


def brute_components(cells):
    left, out = set(cells), []
    for start in sorted(cells):
        if start in left:
            todo, comp = [start], set()
            left.discard(start)
            while todo:
                t, r, c = todo.pop()
                comp.add((t, r, c))
                for x in ((t, r + 1, c), (t, r - 1, c), (t, r, c + 1), (t, r, c - 1)):
                    if x in left:
                        left.discard(x)
                        todo.append(x)
            out.append(frozenset(comp))
    return set(out)


def test_components_and_morphology(spark):
    rng = np.random.default_rng(1)
    cells = {(int(t), int(r), int(c)) for t in range(6) for r in range(12) for c in range(12) if rng.random() < 0.55}
    df = spark.createDataFrame(sorted(cells), "tile int, r int, c int")
    got = {}
    for x in grid.cells_of_runs(grid.components(df)).collect():
        got.setdefault((x.tile, x.component), set()).add((x.tile, x.r, x.c))
    assert {frozenset(v) for v in got.values()} == brute_components(cells)
    near = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    for border in (False, True):
        inside = lambda r, c: 0 <= r < 12 and 0 <= c < 12
        want = {(t, r, c) for t in range(6) for r in range(12) for c in range(12) if all(((t, r + a, c + b) in cells) if inside(r + a, c + b) else border for a, b in near)}
        assert {tuple(x) for x in grid.erode(df, 1, 12, border).collect()} == want
    want = {(t, r + a, c + b) for t, r, c in cells for a, b in near if 0 <= r + a < 12 and 0 <= c + b < 12}
    assert {(x.tile, x.r, x.c) for x in grid.dilate(df, 1, 12).collect()} == want


def test_average_precision_with_ties(spark):
    s = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    assert ev.average_precision(s).first().ap == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert ev.roc_auc(s).first().auc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert ev.roc_auc(s.filter("y = 1")).first().auc is None


def test_greedy_matching(spark):
    preds = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)], "tile int, pred int, conf double")
    pairs = spark.createDataFrame([(1, 1, 1, 0.6), (1, 2, 1, 0.9), (1, 2, 2, 0.55)], "tile int, pred int, gt int, iou double")
    got = {r.pred: r.hits for r in ev.greedy_hits(preds, pairs, [0.5, 0.7]).collect()}
    assert got == {1: [True, False], 2: [True, True], 3: [False, False]}


def test_interpolated_ap_brute(spark):
    rng = random.Random(2)
    rows = [(i, 0, round(rng.random(), 2), rng.random() < 0.4) for i in range(80)]
    n_gt = 40
    order = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    tp, curve = 0, []
    for k, r in enumerate(order, 1):
        tp += r[3]
        curve.append((tp / n_gt, tp / k))
    want = sum(max((p for rec, p in curve if rec >= q / 100 - 1e-12), default=0) for q in range(101)) / 101
    df = spark.createDataFrame(rows, "tile int, pred int, conf double, hit boolean")
    assert ev.interpolated_ap(df, n_gt).first().ap == pytest.approx(want)
    assert np.isnan(ev.interpolated_ap(df, 0).first().ap)


def test_splits(spark):
    df = spark.range(200).select((F.col("id") % 17).alias("g"))
    s = {r.g: r.split for r in vector.group_split(df, "g", 0.3).collect()}
    assert sum(v == "val" for v in s.values()) == 6 and len(s) == 17
    f = vector.group_folds(df, "g", 4).collect()
    load = [sum(r.n for r in f if r.fold == k) for k in range(4)]
    assert len(f) == 17 and max(load) - min(load) <= max(r.n for r in f)


def test_batches(spark):
    df = spark.range(205).select(F.format_string("t%04d", "id").alias("name"))
    got = tiling.batches(df, 100, "name").orderBy("name").collect()
    assert [r.batch for r in got][::100] == ["batch_01", "batch_02", "batch_03"] and got[204].image_id == 4


def jpeg(lat=None):
    import struct

    body = b""
    if lat is not None:
        gps = struct.pack("<H", 4)
        data_at = 8 + 2 + 12 + 4 + 2 + 48 + 4
        rational = lambda d: struct.pack("<6I", d, 1, 30, 1, 0, 1)
        gps += struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, data_at) + struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack("<HHII", 4, 5, 3, data_at + 24) + struct.pack("<I", 0)
        main = struct.pack("<H", 1) + struct.pack("<HHII", 0x8825, 4, 1, 8 + 2 + 12 + 4) + struct.pack("<I", 0)
        tiff = b"II*\0" + struct.pack("<I", 8) + main + gps + rational(lat) + rational(146)
        body = b"Exif\0\0" + tiff
        body = b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + body + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 5460, 8192, 1) + b"\0\0\0" + b"\xff\xd9"


def test_frame_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jpg").write_bytes(jpeg(20))
    (tmp_path / "sub" / "b.JPG").write_bytes(jpeg())
    (tmp_path / "c.jpg").write_bytes(b"junk")
    got = {r.name: r for r in sources.frame_manifest(spark, str(tmp_path)).collect()}
    assert got["a.jpg"].lat == -20.5 and got["a.jpg"].lon == 146.5 and got["a.jpg"].width == 8192
    assert got["b.JPG"].lat is None and got["b.JPG"].height == 5460
    assert got["c.jpg"].exif_error and got["c.jpg"].width is None


def test_annotation_files(spark, tmp_path):
    xml = '<annotations><image id="0" name="d/t_r0_c0.jpg" width="10" height="10"><polygon label="w" points="0,0;4,0;4,4"/><polygon label="w" points="1,1;2,2"/><box label="m" xtl="1" ytl="1" xbr="2" ybr="2"/></image><image id="1" name="e.jpg" width="10" height="10"></image></annotations>'
    (tmp_path / "a.xml").write_text(xml)
    images = sources.cvat_images(spark, str(tmp_path / "a.xml"))
    assert {(r.name, r.shapes) for r in sources.shape_counts(images).collect()} == {("t_r0_c0.jpg", 3), ("e.jpg", 0)}
    p = sources.polygons(images).collect()
    assert len(p) == 1 and len(p[0].ring) == 3
    (tmp_path / "c.json").write_text('{"images":[{"id":1,"file_name":"x/y.jpg"},{"id":2,"file_name":"z.jpg"}],"annotations":[{"id":1,"image_id":1}],"categories":[]}')
    assert {(r.name, r.shapes) for r in sources.coco_counts(sources.coco(spark, str(tmp_path / "c.json"))).collect()} == {("y.jpg", 1), ("z.jpg", 0)}
    assert [sources.sniff(xml), sources.sniff("{bad"), sources.sniff('{"images":[],"annotations":[]}')] == ["cvat", None, "coco"]
    (tmp_path / "l.txt").write_text("0 0.1 0.1 0.5 0.1 0.5 0.5\n0 0.1 0.2\n")
    y = sources.yolo_labels(spark, str(tmp_path / "l.txt"))
    assert [len(r.ring) for r in y.collect()] == [3]
    assert y.select(sources.yolo_line(F.col("cls"), F.col("ring")).alias("t")).first().t == "0 0.1 0.1 0.5 0.1 0.5 0.5"


def test_head_comparison_has_all_heads(spark):
    from skyfold.plans import catalogue

    got = {r.head: r.ap for r in catalogue.queries()["head_comparison"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"logistic", "logistic_strong", "svc", "mlp", "forest"} and all(0 < x <= 1 for x in got.values())
