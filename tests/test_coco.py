"""The COCO protocol in bits: all twelve numbers, and the error breakdown under every view, against plain loops."""

import random
from statistics import fmean

import pytest

from boxloom.operators import coco, match, metrics

DET = "image_id long, label long, det_id long, score double, x1 double, y1 double, x2 double, y2 double"
GT = "image_id long, label long, gt_id long, is_ignore boolean, is_crowd boolean, x1 double, y1 double, x2 double, y2 double"
SUPER = {1: "a", 2: "a", 3: "b", 4: "b", 5: "b"}


@pytest.fixture(scope="module")
def boxes():
    r = random.Random(11)
    gts, dets = [], []
    for i in range(150):
        side = r.choice([12, 25, 60, 90, 150])
        x, y, w, h = r.randrange(200), r.randrange(200), r.randrange(side // 2, side + 1), r.randrange(side // 2, side + 1)
        gts.append((i % 11, 1 + i % 4, i, i % 17 == 4, i % 19 == 6, float(x), float(y), float(x + w), float(y + h)))
        for j in range(5):
            k = [v + r.randrange(-side // 6 - 1, side // 6 + 2) for v in (x, y, x + w, y + h)]
            label = 1 + (i % 4 if j < 3 else r.randrange(5))
            dets.append((i % 11, label, 5 * i + j, r.randrange(1, 12) / 12, float(k[0]), float(k[1]), float(max(k[2], k[0] + 1)), float(max(k[3], k[1] + 1))))
    dets.append((50, 1, 9000, 0.9, 1.0, 1.0, 9.0, 9.0))
    gts.append((51, 1, 9010, False, False, 1.0, 1.0, 9.0, 9.0))
    return dets, gts


@pytest.fixture(scope="module")
def tables(spark, boxes):
    return spark.createDataFrame(boxes[0], DET), spark.createDataFrame(boxes[1], GT)


def area(q):
    return (q[2] - q[0]) * (q[3] - q[1])


def overlap(d, t, crowd):
    w, h = min(d[2], t[2]) - max(d[0], t[0]), min(d[3], t[3]) - max(d[1], t[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (area(d) if crowd else area(d) + area(t) - w * h)


def seen_as(gts, label, view):
    """Truths of one label under a view: (id, image, counts not, crowd, box)."""
    for t in gts:
        own = t[1] == label
        if own or view == "any" or (view == "super" and SUPER[t[1]] == SUPER[label]):
            yield t[2], t[0], t[3] or t[4] or not own, t[4] or not own, t[5:]


def outcomes(boxes, label, view, thr, lo, hi, most):
    """((-score, det_id), rank, hit) of the counted detections of a label, over all images, and the number of its truths."""
    out, truths = [], list(seen_as(boxes[1], label, view))
    for image in {d[0] for d in boxes[0]}:
        ign = lambda t: t[2] or not lo <= area(t[4]) <= hi
        mine, held = sorted((t for t in truths if t[1] == image), key=lambda t: (ign(t), t[0])), set()
        for rank, d in enumerate(sorted((d for d in boxes[0] if d[0] == image and d[1] == label), key=lambda d: (-d[3], d[2]))[:most]):
            best, own = None, min(thr, 1 - 1e-10)
            for t in mine:
                if t[0] in held and not t[3]:
                    continue
                if best and not ign(best) and ign(t):
                    break
                o = overlap(d[4:], t[4], t[3])
                if o >= own:
                    best, own = t, o
            if best:
                held.add(best[0])
            if not (ign(best) if best else not lo <= area(d[4:]) <= hi):
                out.append(((-d[3], d[2]), rank, bool(best)))
    return sorted(out), sum(not t[2] and lo <= area(t[4]) <= hi for t in truths)


def curve(boxes, label, view, thr, name, most=100):
    """Precision at 101 recalls, or None without truths."""
    rows, n = outcomes(boxes, label, view, thr, *match.AREAS[name], most)
    if not n:
        return None
    tp, points = 0, []
    for k, (_, _, hit) in enumerate(rows):
        tp += hit
        points.append((tp / n, tp / (k + 1)))
    return [max((p for r, p in points if r >= k / 100 - 1e-9), default=0.0) for k in range(101)]


def recall(boxes, label, thr, name, most):
    rows, n = outcomes(boxes, label, "own", thr, *match.AREAS[name], 100)
    return sum(hit for _, rank, hit in rows if rank < most) / n if n else None


def test_twelve_numbers(boxes, tables):
    got = {r.metric: r.value for r in metrics.coco_metrics(*tables).collect()}
    labels = sorted({t[1] for t in boxes[1]})
    mean = lambda x: fmean(v for v in x if v is not None)
    each = lambda thrs, name: mean(fmean(c) for t in thrs for k in labels if (c := curve(boxes, k, "own", t, name)))
    ths = match.IOU_THRS
    want = {"AP": each(ths, "all"), "AP50": each([0.5], "all"), "AP75": each([0.75], "all"), "APs": each(ths, "small"), "APm": each(ths, "medium"), "APl": each(ths, "large")}
    for name, size, most in (("AR1", "all", 1), ("AR10", "all", 10), ("AR100", "all", 100), ("ARs", "small", 100), ("ARm", "medium", 100), ("ARl", "large", 100)):
        want[name] = mean(recall(boxes, k, t, size, most) for t in ths for k in labels)
    assert set(got) == set(want)
    for name in want:
        assert got[name] == pytest.approx(want[name], abs=1e-9), name


@pytest.mark.parametrize("parts", ["1", "8"])
def test_error_breakdown(spark, boxes, tables, parts):
    cats = spark.createDataFrame(list(SUPER.items()), "label long, supercategory string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.label, r.area, r.type): r.value for r in coco.coco_error_breakdown(*tables, cats).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for name in match.AREAS:
        for label in SUPER:  # label 5 has detections and no truths
            zero = [0.0] * 101
            ps = [curve(boxes, label, v, t, name) or zero for v, t in (("own", 0.75), ("own", 0.5), ("own", 0.1), ("super", 0.1), ("any", 0.1))]
            ps += [[float(p > 0) for p in ps[4]], [1.0] * 101]
            want |= {(label, name, kind): fmean(p) for kind, p in zip(coco.TYPES, ps, strict=True)}
        want |= {(None, name, kind): fmean(want[label, name, kind] for label in SUPER) for kind in coco.TYPES}
    assert set(got) == set(want)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert got[1, "all", "Loc"] < got[1, "all", "Sim"] < got[1, "all", "Oth"]  # the views differ on these boxes
