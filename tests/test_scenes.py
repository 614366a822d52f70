"""Moved boxes, devkit files, table functions, suppression in rounds and drawn augmentations against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.functions import tables as table_functions
from boxloom.operators import grids, kernels, location, masks, nms, placement, sampling
from boxloom.sources import devkit, readers, writers

GT = "image_id long, gt_id long, label long, x1 double, y1 double, x2 double, y2 double"


def boxes_of(rng, images, most, w=300, h=200, whole=False):
    out = []
    for image in range(images):
        for k in range(rng.randrange(most + 1)):
            x, y = rng.randrange(w - 20), rng.randrange(h - 20)
            bw, bh = rng.randrange(2, 80), rng.randrange(2, 80)
            x2, y2 = x + bw + (0 if whole else rng.random()), y + bh + (0 if whole else rng.random())
            out.append((image, 100 * image + k, k % 3, float(x), float(y), float(min(x2, w - 1)), float(min(y2, h - 1))))
    return out


def common(a, b):
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


# ------------------------------------------------------------------ A13, A14


def test_shifted_boxes(spark):
    rng = random.Random(2)
    gts = boxes_of(rng, 40, 9)
    gts += [(90, 9000 + k, 1, 10.0, 10.0, 60.0, 60.0) for k in range(12)]  # ties: all on one place
    gts += [(91, 9100 + k, 1, 60.0 * k, 0.0, 60.0 * k + 58, 199.0) for k in range(5)]  # a full image: hardly any place
    gts += [(92, 9200, 1, 0.0, 0.0, 300.0, 200.0), (93, 9300, 1, 5.0, 5.0, 5.0, 9.0)]  # as large as the image; no area
    sizes = {i: (300, 200) for i in {g[0] for g in gts}}
    want = {}
    for image in sizes:
        mine = sorted(g[1:] for g in gts if g[0] == image)
        flagged = {g[0] for g in mine if placement.draw(3, "move", image, g[0])[0] < 0.5 * 2**32}
        place = [(g[0], False, g[2:]) for g in mine if g[0] not in flagged]
        for i, _, *b in mine:
            if i not in flagged:
                continue
            w, h = min(int(b[2]), 300) - int(b[0]), min(int(b[3]), 200) - int(b[1])
            if w >= 300 or h >= 200:
                continue
            for attempt in range(10):
                d = placement.draw(3, "place", image, i, attempt)
                a = (d[0] % (300 - w), d[1] % (200 - h))
                a = (*a, a[0] + w, a[1] + h)
                div = lambda p, q: p / q if q > 0 else 0.0
                bad = any(div(c, area(a) + area(o) - c) > 0.05 or div(c, area(a)) > 0.1 or div(c, area(o)) > 0.1 for _, _, o in place for c in [common(a, o)])
                if not bad:
                    place.append((i, True, a))
                    break
        want |= {(image, i): (moved, tuple(map(float, b))) for i, moved, b in place}
    images = spark.createDataFrame([(i, *s) for i, s in sizes.items()], "image_id long, width int, height int")
    got = placement.shift_gts(images, spark.createDataFrame(gts, GT), 3, rate=0.5).collect()
    assert {(r.image_id, r.gt_id): (r.moved, (r.x1, r.y1, r.x2, r.y2)) for r in got} == want
    assert any(m for m, _ in want.values()) and len(want) < len(gts)  # some moved, some dropped
    assert placement.shift_gts(images, spark.createDataFrame(gts, GT).limit(0), 3).count() == 0


def test_pasted_boxes(spark):
    rng = random.Random(4)
    own = boxes_of(rng, 40, 4, 120, 100)
    roi = boxes_of(rng, 36, 12, 300, 200, whole=True)
    own += [(50, 5000, 1, 0.0, 0.0, 120.0, 100.0), (51, 5100, 1, 1.0, 1.0, 1.0, 8.0)]
    images = [(i, 300, 200) for i in range(39)] + [(50, 300, 200), (51, 120, 90)]
    want, cw, ch = Counter(), 120, 100
    for image, w, h in images:
        mine, around = sorted(g[1:] for g in own if g[0] == image), sorted(g[1:] for g in roi if g[0] == image)
        rows = [(i, "kept", tuple(b)) for i, _, *b in mine]
        d = placement.draw(5, "paste", image)
        if d[0] < 0.7 * 2**32 and (mine or around):
            nx, ny = (d[1] % (w - cw) if w > cw else 0), (d[2] % (h - ch) if h > ch else 0)
            win = (nx, ny, nx + cw, ny + ch)
            place = [(i, "roi", (max(b[0] - nx, 0), max(b[1] - ny, 0), min(b[2] - nx, cw), min(b[3] - ny, ch))) for i, _, *b in around if area(b) > 0 and common(win, b) / area(b) > 0.5]
            for i, _, *b in mine:
                bw, bh = int(b[2]) - int(b[0]), int(b[3]) - int(b[1])
                if bw >= cw or bh >= ch:
                    continue
                for attempt in range(10):
                    e = placement.draw(5, "paste", image, i, attempt)
                    a = (e[0] % (cw - bw), e[1] % (ch - bh))
                    a = (*a, a[0] + bw, a[1] + bh)
                    if not place or not all(area(o) > 0 and common(a, o) / area(o) > 0.05 for _, _, o in place):
                        place.append((i, "pasted", a))
                        break
            rows = place or rows
        want.update((image, i, kind, tuple(map(float, b))) for i, kind, b in rows)
    table = spark.createDataFrame(images, "image_id long, width int, height int")
    got = placement.paste_gts(table, spark.createDataFrame(own, GT), spark.createDataFrame(roi, GT), (cw, ch), 5, rate=0.7).collect()
    assert Counter((r.image_id, r.gt_id, r.kind, (r.x1, r.y1, r.x2, r.y2)) for r in got) == want
    assert {k for _, _, k, _ in want} == {"kept", "roi", "pasted"}


def test_crop_keeps_images_without_truths_whole(spark):
    images = spark.createDataFrame([(1, 100, 80), (2, 100, 80)], "image_id long, width int, height int")
    gts = spark.createDataFrame([(2, 5, 1, 10.0, 10.0, 30.0, 30.0)], GT)
    crops, boxes = placement.min_iou_crop(images, gts, 1)
    assert {r.image_id: r.px1 for r in crops.collect()}[1] is None and boxes.count() == 1


# ------------------------------------------------------------------ A11


def test_location_targets_by_writing_maps(spark):
    """Maps written truth after truth, as the definition says."""
    rng = random.Random(6)
    gts = boxes_of(rng, 6, 60, 200, 150)
    feats, strides = [(52, 64), (26, 32), (13, 16), (7, 8), (4, 4)], (8, 16, 32, 64, 128)
    want = {}
    for image in range(6):
        target, weight, near = ([np.full(s, v) for s in feats] for v in (0.0, -1.0, 0.0))
        for _, _, _, *b in sorted(g for g in gts if g[0] == image):
            lv = int(np.clip(np.floor(np.log2(np.sqrt((b[2] - b[0] + 1) * (b[3] - b[1] + 1))) - np.log2(32.0) + 0.5), 0, 4))

            def cut(k, r, b=b):
                q, (h, w) = [v / strides[k] for v in b], feats[k]
                c = [np.round((1 - r) * q[0] + r * q[2]), np.round((1 - r) * q[1] + r * q[3]), np.round(r * q[0] + (1 - r) * q[2]), np.round(r * q[1] + (1 - r) * q[3])]
                x1, y1, x2, y2 = (int(np.clip(v, 0, (w if i % 2 == 0 else h) - 1)) for i, v in enumerate(c))
                return slice(y1, y2 + 1), slice(x1, x2 + 1)

            target[lv][cut(lv, 0.4)] = 1
            weight[lv][cut(lv, 0.25)] = 0
            weight[lv][cut(lv, 0.4)] = 1
            for k in (lv - 1, lv + 1):
                if 0 <= k < 5:
                    near[k][cut(k, 0.25)] = 1
        for k in range(5):
            weight[k][(weight[k] < 0) & (near[k] > 0)] = 0
            for r, c in zip(*np.nonzero((weight[k] >= 0) | (target[k] > 0)), strict=True):
                want[image, k, int(r), int(c)] = (int(target[k][r, c]), float(weight[k][r, c]))
    got = location.location_targets(spark.createDataFrame(gts, GT), feats).collect()
    assert {(r.image_id, r.level, r.row, r.col): (r.target, r.weight) for r in got} == want
    assert (1, 0.0) in want.values()  # a later ring over an earlier centre
    assert location.location_factor(feats, 3) == 3 * sum(h * w for h, w in feats) / 200


# ------------------------------------------------------------------ K7


def _xml(boxes):
    obj = "".join(
        f"<object><name>{n}</name><pose>x</pose><truncated>0</truncated><difficult>{d}</difficult><bndbox><xmin>{a}</xmin><ymin>{b}</ymin><xmax>{c}</xmax><ymax>{e}</ymax></bndbox></object>"
        for n, d, a, b, c, e in boxes
    )
    return f"<annotation><folder>f</folder><size><width>60</width><height>50</height></size>{obj}</annotation>"


def test_devkit_from_files(spark, tmp_path):
    files = {
        "VOC2007": {"a": [("cat", 0, 1, 2, 11, 12), ("dog", 1, 3, 4, 9, 9)], "b": [("dog", 0, 5, 5, 8, 8)], "same": [("cat", 0, 1, 1, 2, 2)], "t": [("cat", 1, 2, 2, 4, 4)]},
        "VOC2012": {"same": [("dog", 0, 7, 7, 9, 9)], "e": [("cat", 0, 6, 6, 7, 7)]},
    }
    lists = {"VOC2007": {"train": ["a", "same"], "val": ["b"], "test": ["t"], "cat_train": ["a"]}, "VOC2012": {"train": ["same", "gone"]}}  # no val list in 2012, no file for gone
    for year, anns in files.items():
        (tmp_path / year / "Annotations").mkdir(parents=True)
        (tmp_path / year / "ImageSets/Main").mkdir(parents=True)
        for name, boxes in anns.items():
            (tmp_path / year / "Annotations" / f"{name}.xml").write_text(_xml(boxes))
        for split, names in lists[year].items():
            (tmp_path / year / "ImageSets/Main" / f"{split}.txt").write_text("".join(f"{n} \n" for n in names))
    got = devkit.convert_voc(spark, str(tmp_path), str(tmp_path / "out"), ["cat", "dog"])
    rows = {(r.dataset, r.split, r.filename): (r.bboxes, r.labels, r.bboxes_ignore, r.labels_ignore) for r in got.collect()}
    a = ([[0.0, 1.0, 10.0, 11.0]], [1], [[2.0, 3.0, 8.0, 8.0]], [2])
    assert rows["voc07", "train", "VOC2007/JPEGImages/a.jpg"] == a == rows["voc0712", "train", "VOC2007/JPEGImages/a.jpg"]
    assert rows["voc0712", "train", "VOC2007/JPEGImages/same.jpg"][1] == [1] and rows["voc0712", "train", "VOC2012/JPEGImages/same.jpg"][1] == [2]
    assert {k[:2] for k in rows} == {("voc07", "train"), ("voc07", "val"), ("voc07", "test"), ("voc12", "train"), ("voc0712", "train")}  # val of both years: one list is missing
    assert len(rows) == 8
    # what is converted again replaces its own splits only
    only = devkit.annotations(devkit.read_lists(spark, str(tmp_path)).where("split = 'test'"), devkit.read_annotations(spark, str(tmp_path)), ["cat", "dog"])
    devkit.write_annotations(only, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


# ------------------------------------------------------------------ U5


def test_table_functions(spark):
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM anchors(96, 64)").collect()
    want = grids.anchor_grid(spark, 96, 64).select("anchor_idx", "level", "x1", "y1", "x2", "y2").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    images = spark.createDataFrame([(1, 700, 500), (2, 800, 800), (3, 1700, 900), (4, None, 10)], "image_id long, width int, height int")
    tiles = spark.sql("SELECT image_id, t.* FROM {i}, LATERAL tiles(width, height, 800, 600) t", i=images)
    plan = grids.tile_plan(images.where("width IS NOT NULL"), (800, 800), (600, 600)).select("image_id", "tile_idx", "x", "y")
    assert sorted(map(tuple, tiles.collect())) == sorted(map(tuple, plan.collect()))


# ------------------------------------------------------------------ N1


@pytest.mark.parametrize("cell", [None, 15.0, 400.0])
def test_suppression_in_rounds(spark, cell):
    """Cells smaller than a box, and one for all; ties in score, repeated boxes and ids, several keys."""
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        x, y = rng.randrange(300), rng.randrange(200)
        rows.append((i % 2, f"k{i % 3}", i - i % 2 * (i % 50 == 1), rng.randrange(20) / 20, float(x), float(y), float(x + rng.randrange(1, 40)), float(y + rng.randrange(1, 40)), "more"))
    rows += [(0, "k0", 9000 + i, 0.5, 5.0, 5.0, 25.0, 25.0, "equal") for i in range(40)]
    rows = sorted({r[:3]: r for r in rows}.values())  # one row an id and key: equal ones have no order
    d = spark.createDataFrame(rows, "image_id long, name string, det_id long, score double, x1 double, y1 double, x2 double, y2 double, note string")
    got = nms.nms_in_rounds(d, ["image_id", "name"], 0.3, cell=cell)
    want = []
    for key in {r[:2] for r in rows}:
        mine = sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[3], r[2]))
        want += [mine[i] for i in kernels.nms(np.array([r[4:8] for r in mine]), 0.3)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == d.columns


def test_one_dense_image_over_many_tasks(spark):
    rng = np.random.RandomState(3)
    n = 60_000
    x, y = rng.randint(0, 4000, (2, n))
    w, h = rng.randint(20, 90, (2, n))
    t = np.c_[np.zeros(n), np.arange(n), rng.randint(0, 500, n) / 500, x, y, x + w, y + h]
    import pandas as pd

    d = spark.createDataFrame(pd.DataFrame(t, columns=["image_id", "det_id", "score", "x1", "y1", "x2", "y2"]).astype({"image_id": "int64", "det_id": "int64"}))
    got = {r.det_id for r in nms.nms(d, ["image_id"], 0.5, engine="rounds").select("det_id").collect()}
    order = np.lexsort((t[:, 1], -t[:, 2]))
    assert got == {int(t[order[i], 1]) for i in kernels.nms(t[order, 3:], 0.5)}


# ------------------------------------------------------------------ D13, G13, G14, G25, F6, U1


def test_replacement_has_no_group_of_its_own(spark):
    images = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "image_id long, flag int")
    got = {r.image_id: r.replacement for r in sampling.replacement(images.where("image_id <> 1"), images).collect()}
    assert got == {2: 1, 3: None}  # the only image of its group has none


def test_drawn_augmentations(spark):
    t = spark.range(4000).withColumn("w", F.lit(100.0)).withColumn("h", F.lit(50.0))
    t = t.withColumns({"x1": F.lit(10.0), "y1": F.lit(5.0), "x2": F.lit(30.0), "y2": F.lit(20.0)})
    b = G.expand_box(G.box(), F.col("w"), F.col("h"), 7, F.col("id"))
    t = t.select(
        "id", G.flip_flag(3, 0.3, F.col("id")).alias("flip"), G.pick_scale(5, [(1333, 800), (1000, 600)], F.col("id")).alias("one"),
        G.pick_scale(5, [(1333, 640), (1333, 800)], F.col("id"), mode="range").alias("between"), G.pick_scale(5, [(1000, 500)], F.col("id"), ratio_range=(0.5, 1.5)).alias("times"), *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), b, strict=True)],
    ).toPandas()
    assert 0.27 < t.flip.mean() < 0.33
    assert {tuple(r) for r in t.one} == {(1333, 800), (1000, 600)} and 0.45 < (t.one.map(lambda r: r[0]) == 1333).mean() < 0.55
    short = t.between.map(lambda r: r[1])
    assert short.min() >= 640 and short.max() <= 800 and short.nunique() > 100
    ratio = t.times.map(lambda r: r[0]) / 1000
    assert ratio.min() >= 0.499 and ratio.max() <= 1.5 and 0.9 < ratio.mean() < 1.1
    assert ((t.x2 - t.x1) == 20).all() and ((t.y2 - t.y1) == 15).all()  # moved, never resized
    same = t.x1 == 10
    assert 0.45 < same.mean() < 0.6 and (t.x1 >= 10).all() and (t.x1 <= 10 + 300).all() and (t.y1 <= 5 + 150).all()


def test_names_of_data_sets(spark, tmp_path):
    assert readers.resolve_dataset("pascal_voc") == "voc" and readers.resolve_dataset("vid") == "imagenet_vid"
    assert {k: len(readers.class_names(spark, k)) for k in ("voc07", "ms_coco", "ilsvrc_vid", "WDIERFace", "cityscapes")} == {"voc07": 20, "ms_coco": 80, "ilsvrc_vid": 30, "WDIERFace": 1, "cityscapes": 8}
    (tmp_path / "names.txt").write_text("accordion\n airplane \n\nzebra\n")
    assert readers.class_names(spark, "ilsvrc_det", str(tmp_path / "names.txt")) == ["accordion", "airplane", "zebra"]
    for bad in ("nothing", "det"):
        with pytest.raises(ValueError):
            readers.class_names(spark, bad)


def test_rois_there_and_back(spark):
    dets = spark.createDataFrame([(7, 1, 1.0, 2.0, 3.0, 4.0), (9, 2, 5.0, 6.0, 7.0, 8.0)], "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double")
    images = spark.createDataFrame([(9, 0), (7, 1)], "image_id long, batch_ind int")
    rois = writers.to_rois(dets, images)
    assert {r.det_id: r.batch_ind for r in rois.collect()} == {1: 1, 2: 0}
    assert sorted(map(tuple, writers.from_rois(rois, images).select(*dets.columns).collect())) == sorted(map(tuple, dets.collect()))


def test_score_tiles_calls_a_detector_once_a_task(spark):
    """Batches of at most the asked-for size; the detector is made in the task."""
    import pandas as pd

    def make():
        made = []

        def predict(p):
            made.append(len(p))
            return pd.DataFrame({"tile_idx": p["tile_idx"], "size": len(p), "calls": len(made)})

        return predict

    tiles = spark.range(50).select(F.col("id").alias("tile_idx")).repartition(3)
    got = masks.score_tiles(tiles, make, "tile_idx long, size int, calls int", batch_size=8).toPandas()
    assert sorted(got.tile_idx) == list(range(50)) and got["size"].max() == 8 and got.calls.max() >= 2
