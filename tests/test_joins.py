"""Joins of truths with fixed tables, tiles and windows: against plain loops, and which side of a join goes where."""

import math
import random

import numpy as np
import pytest

from boxloom.operators import assign, grids, pairs, placement

GT = "image_id long, gt_id long, label long, x1 double, y1 double, x2 double, y2 double"


def boxes_of(seed, images, n, w=300, h=300, most=90, lowest=-20):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.randrange(lowest, w), rng.randrange(lowest, h)
        out.append((k % images, k, k % 3, float(x), float(y), x + rng.randrange(most) + rng.choice([0.0, 0.5]), y + rng.randrange(most) + 0.0))
    return out


@pytest.fixture()
def stored(spark, tmp_path):
    """A table as one parquet file: its size is known to Spark, and what is made of it may look small."""

    def store(rows, schema, name="t"):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return store


def broadcasts(df):
    """What stands below each broadcast of the physical plan before it runs."""
    lines = df.select("*")._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-|")) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if x.lstrip(" :+-|").startswith("BroadcastExchange"):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


# ------------------------------------------------------------------ J6, A9


def test_point_targets_broadcast_the_grid_and_never_the_truths(spark, stored):
    """Truths over borders of blocks, beside the grid, without area and of equal area; a truth has many cells, so its rows are not to be collected."""
    gts = boxes_of(3, 5, 150) + [(7, 900 + k, k % 2, 100.0, 100.0, 160.0, 150.0) for k in range(4)] + [(7, 910, 1, 120.0, 120.0, 120.0, 140.0), (7, 911, 1, 5000.0, 0.0, 5100.0, 90.0), (8, 920, 2, 0.0, 0.0, 300.0, 280.0)]
    feats, strides, ranges = [(40, 40), (20, 20), (10, 10)], [8, 16, 32], [(-1.0, 50.0), (50.0, 120.0), (120.0, 1e8)]
    want, idx = {}, 0
    for (h, w), s, (lo, hi) in zip(feats, strides, ranges, strict=True):
        for row in range(h):
            for col in range(w):
                x, y = col * s + s // 2, row * s + s // 2
                for image, i, label, *b in gts:
                    d = (x - b[0], y - b[1], b[2] - x, b[3] - y)
                    if min(d) > 0 and lo <= max(d) <= hi:
                        m = ((b[2] - b[0] + 1) * (b[3] - b[1] + 1), i, label, *d)
                        want[image, idx] = min(m, want.get((image, idx), m))
                idx += 1
    got = assign.fcos_targets(grids.point_grid(spark, feats, strides, half_shift=True), stored(gts, GT), ranges)
    assert {(r.image_id, r.point_idx): (r.gt_id, r.label, r.l, r.t, r.r, r.b) for r in got.collect()} == {k: m[1:] for k, m in want.items()}
    assert got.count() == len(want)
    below = broadcasts(got)
    assert len(below) == 1 and "parquet" not in below[0]


# ------------------------------------------------------------------ J4, A12


def plan(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def test_anchor_bags_make_no_row_per_pair(spark):
    """The query joins nothing: a truth overlaps some 3,000 anchors, of which 50 are kept."""
    from boxloom.plans import catalogue

    assert "Join" not in plan(catalogue.queries()["j4_a12_anchor_bags"](spark, "/root/testdata/sf0.001"))


def test_best_anchors_are_the_bags_of_all_pairs(spark):
    """Truths beside the tile, inside out, repeated, smaller than a pixel, as large as the tile, with fewer than k anchors; ties at rank k."""
    gts = boxes_of(5, 3, 60, 200, 200) + [(5, 700, 1, -900.0, 0.0, -850.0, 40.0), (5, 701, 1, 60.0, 60.0, 30.0, 30.0), (5, 702, 1, 64.25, 64.25, 64.5, 64.5), (5, 703, 1, 0.0, 0.0, 199.0, 199.0)]
    gts += [(6, 710, 1, 20.0, 20.0, 60.0, 70.0)] * 2 + [(6, 711, 1, -28.0, -28.0, -20.0, -22.0), (6, 711, 1, 90.0, 90.0, 130.0, 150.0), (6, 712, 0, None, 0.0, 9.0, 9.0)]
    anchors, g = grids.anchor_grid(spark, 200, 200, (8, 16, 32)), spark.createDataFrame(gts, GT)
    for k, thr in ((50, 0.6), (7, 0.3)):
        want = assign.anchor_bags(pairs.anchor_pairs(anchors, g), k, thr).select("image_id", "gt_id", "anchor_idx", "iou", "prob", "rank")
        got = assign.best_anchors(anchors, g, k, thr)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    counts = {r.gt_id: r["count"] for r in got.groupBy("gt_id").count().collect()}
    assert 0 < counts.get(711, 0) <= 7 and not {700, 701, 712} & set(counts) and counts[710] == 7


def test_an_anchor_index_forgets_ranges_but_no_anchor(spark, monkeypatch):
    monkeypatch.setattr(assign.AnchorIndex, "HELD", 40)
    rng = np.random.default_rng(1)
    xy = rng.integers(0, 300, (2, 200)).astype(float)
    boxes = np.concatenate([xy, xy + rng.integers(1, 120, (2, 200))])
    index = assign.AnchorIndex(np.arange(200) * 3, boxes)
    for _, _, _, *b in boxes_of(2, 1, 40) * 2:
        ids, v = index.overlaps(np.array(b))
        w, h = (np.minimum(boxes[2 + i], b[2 + i]) - np.maximum(boxes[i], b[i]) + 1 for i in (0, 1))
        assert ids.tolist() == (np.flatnonzero((w > 0) & (h > 0)) * 3).tolist() and (v > 0).all()
        assert index.held == sum(map(len, index.seen.values()))


# ------------------------------------------------------------------ J10


def test_crop_windows_are_no_rows_and_no_table_of_images_is_broadcast(spark):
    from boxloom.plans import catalogue

    p = plan(catalogue.queries()["j10_min_iou_crop"](spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in p and "explode" not in p and p.count("MapInArrow") == 1


def first_window(image, width, height, truths, seed, min_ious):
    """The accepted window, by trying all in order."""
    modes = [1.0, *min_ious, 0.0]
    for mode in range(placement.ROUNDS):
        pick = placement.draw(seed, "mode", image, mode)[0] % len(modes)
        if pick == 0:
            return None
        for trial in range(placement.TRIALS):
            u = [v / 2**32 for v in placement.draw(seed, image, mode, trial)]
            w, h = (0.3 + (1 - 0.3) * u[0]) * width, (0.3 + (1 - 0.3) * u[1]) * height
            if not w * 0.5 <= h <= w * 2:
                continue
            left, top = u[2] * (width - w), u[3] * (height - h)
            p = [float(math.floor(v)) for v in (left, top, left + w, top + h)]
            least, some = 1.0, False
            for b in truths:
                if None in b:
                    least = 0.0  # overlaps nothing, has no centre
                    continue
                inter = max(min(p[2], b[2]) - max(p[0], b[0]) + 1, 0) * max(min(p[3], b[3]) - max(p[1], b[1]) + 1, 0)
                under = (p[2] - p[0] + 1) * (p[3] - p[1] + 1) + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - inter
                least = min(least, inter / under if under else 0.0)
                some |= p[0] < (b[0] + b[2]) / 2 < p[2] and p[1] < (b[1] + b[3]) / 2 < p[3]
            if some and least >= modes[pick]:
                return (mode, trial, *p)
    return None


def test_crops_by_trying_every_window(spark):
    """Images of several sizes; one large truth, so that overlaps asked for are met; a truth without corners; more truths than are held against a window at once."""
    rng = random.Random(8)
    images = [(i, rng.choice([90, 200]), rng.choice([80, 150])) for i in range(60)] + [(70, 100, 80), (71, 100, 80), (72, 200, 150), (73, 200, 150)]
    gts = []
    for i, w, h in images[:60]:
        gts += [(i, 100 * i, 0, 2.0, 3.0, w - 5.0, h - 4.0)] if i % 2 else [(b[0] + i, 100 * i + b[1], *b[2:]) for b in boxes_of(i, 1, 1 + i % 4, w - 20, h - 20, 40, 0)]
    gts += [(71, 7100, 0, 2.0, 2.0, 95.0, 75.0), (71, 7101, 0, None, 2.0, 95.0, 75.0)]  # image 70 has none
    few = [(10.0, 10.0, 190.0, 140.0), (20.0, 5.0, 180.0, 149.0), (0.0, 0.0, 150.0, 149.0)]
    gts += [(k, 100 * k + j, 0, *few[j % 3]) for k, n in ((72, 3), (73, 2 * placement._PIECE + 7)) for j in range(n)]
    crops, boxes = placement.min_iou_crop(spark.createDataFrame(images, "image_id long, width int, height int"), spark.createDataFrame(gts, GT), 5, (0.1, 0.3, 0.5))
    want = {i: first_window(i, w, h, sorted({g[3:] for g in gts if g[0] == i}, key=str), 5, (0.1, 0.3, 0.5)) if i != 70 else None for i, w, h in images}
    got = {r.image_id: None if r.round is None else tuple(r)[1:] for r in crops.collect()}
    assert got == want and len({w[0] for w in want.values() if w}) > 2 and None in want.values()
    n = {r.image_id: r["count"] for r in boxes.groupBy("image_id").count().collect()}
    for i, p in want.items():
        assert n.get(i, 0) == sum(p is None or None not in g and p[2] < (g[3] + g[5]) / 2 < p[4] and p[3] < (g[4] + g[6]) / 2 < p[5] for g in gts if g[0] == i)
    assert boxes.columns == [*[c for c in GT.replace(" long", "").replace(" double", "").split(", ") if c[0] not in "xy"], "x1", "y1", "x2", "y2"]


# ------------------------------------------------------------------ J8


def test_tiles_and_truths_are_never_broadcast(spark):
    from boxloom.plans import catalogue

    assert "Broadcast" not in plan(catalogue.queries()["j8_truths_to_tiles"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.9])
def test_truths_in_every_tile_that_covers_them(spark, stored, share):
    """Tiles that overlap or stick out of small images; truths across cells, beside the image, larger than a tile, without area, inside out, of exactly the share asked for."""
    images = [(0, 300, 300), (1, 170, 90), (2, 40, 220), (3, 100, 80), (4, 1000, 900)]
    gts = boxes_of(4, 5, 150, 300, 300, 130, -60) + [(3, 800, 0, 0.0, 0.0, 200.0, 80.0), (3, 801, 0, 50.0, 10.0, 150.0, 60.0), (3, 802, 0, 90.0, 0.0, 190.0, 40.0), (4, 803, 0, 100.0, 80.0, 200.0, 160.0)]
    gts += [(4, 804, 0, 7.0, 7.0, 7.0, 90.0), (4, 805, 0, 90.0, 90.0, 20.0, 30.0), (9, 806, 0, 1.0, 1.0, 9.0, 9.0), (0, 807, 0, None, 1.0, 9.0, 9.0), (4, 808, 0, 99.9, 79.9, 100.1, 80.1)]
    tiles = grids.tile_plan(spark.createDataFrame(images, "image_id long, width int, height int"), (100, 80), (60, 80))
    got = pairs.gts_to_tiles(tiles, stored(gts, GT), (100, 80), share)
    assert not broadcasts(got)
    want = []
    for t in tiles.collect():
        for image, i, _, *b in gts:
            if image != t.image_id or None in b:
                continue
            w, h = max(min(b[2], t.x + 100.0) - max(b[0], t.x), 0), max(min(b[3], t.y + 80.0) - max(b[1], t.y), 0)
            if w * h / max((b[2] - b[0]) * (b[3] - b[1]), 1e-6) > share:
                want.append((image, t.tile_idx, i, *[min(max(v - o, 0.0), n) for v, o, n in zip(b, (t.x, t.y) * 2, (100.0, 80.0) * 2, strict=True)]))
    assert sorted((r.image_id, r.tile_idx, r.gt_id, r.x1, r.y1, r.x2, r.y2) for r in got.collect()) == sorted(want) and len(want) > 10
