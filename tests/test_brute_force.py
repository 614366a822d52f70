"""Steps that no SQL states, against plain loops over a small table with ties, repeats, crowds and ignored truths."""

import random

import pytest

from boxloom.operators import match, metrics, nms

DET = "image_id long, label long, det_id long, score double, x1 double, y1 double, x2 double, y2 double"
GT = "image_id long, label long, gt_id long, is_ignore boolean, is_crowd boolean, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def boxes():
    r = random.Random(5)
    gts, dets = [], []
    for i in range(60):
        x, y, w, h = r.randrange(90), r.randrange(90), r.randrange(2, 60), r.randrange(2, 60)
        gts.append((i % 7, i % 2, i, i % 9 == 4, i % 13 == 6, float(x), float(y), float(x + w), float(y + h)))
        for j in range(4):
            k = [v + r.randrange(-5, 6) for v in (x, y, x + w, y + h)]
            dets.append((i % 7, i % 2 if j else 1 - i % 2, 4 * i + j, r.randrange(1, 9) / 10, float(k[0]), float(k[1]), float(max(k[2], k[0] + 1)), float(max(k[3], k[1] + 1))))
    dets.append((50, 0, 900, 0.5, 1.0, 1.0, 9.0, 9.0))  # an image without truths
    gts.append((51, 0, 901, False, False, 1.0, 1.0, 9.0, 9.0))  # and one without detections
    return dets, gts


@pytest.fixture(scope="module")
def tables(spark, boxes):
    return spark.createDataFrame(boxes[0], DET), spark.createDataFrame(boxes[1], GT)


def iou(a, b, off=1.0, crowd=False):
    w = min(a[2], b[2]) - max(a[0], b[0]) + off
    h = min(a[3], b[3]) - max(a[1], b[1]) + off
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda q: (q[2] - q[0] + off) * (q[3] - q[1] + off)
    under = area(a) if crowd else area(a) + area(b) - w * h
    return w * h / under if under else 0.0


def grouped(rows, keys):
    out = {}
    for r in rows:
        out.setdefault(r[:keys], []).append(r)
    return out


def by_score(dets):
    return sorted(dets, key=lambda d: (-d[3], d[2]))


@pytest.mark.parametrize("method", ["linear", "gaussian", "greedy"])
def test_soft_nms(boxes, tables, method):
    import math

    exp = {}
    for (image, label), group in grouped(boxes[0], 2).items():
        live = [[d[3], d] for d in by_score(group)]
        while live:
            top = max(s for s, _ in live)
            at = next(i for i, (s, _) in enumerate(live) if s == top)
            if top < 0.05:
                break
            _, d = live.pop(at)
            exp[image, label, d[2]] = round(top, 9)
            for e in live:
                o = iou(d[4:], e[1][4:])
                e[0] *= {"linear": 1 - o if o > 0.3 else 1, "gaussian": math.exp(-o * o / 0.5), "greedy": 0 if o > 0.3 else 1}[method]
            live = [e for e in live if e[0] >= 0.05]
    got = nms.soft_nms(tables[0], ["image_id", "label"], 0.3, method, 0.5, 0.05).collect()
    assert {(r.image_id, r.label, r.det_id): round(r.score, 9) for r in got} == exp


def test_match_imagenet(boxes, tables):
    truths, exp = grouped(boxes[1], 2), {}
    for key, group in grouped(boxes[0], 2).items():
        mine, taken = truths.get(key, []), set()
        for d in by_score(group):
            best, own = None, -1.0
            for t in mine:
                w, h = t[7] - t[5] + 1, t[8] - t[6] + 1
                o = iou(d[4:], t[5:])
                if t[2] not in taken and o >= min(w * h / ((w + 10) * (h + 10)), 0.5) and o > own:
                    best, own = t, o
            if best:
                taken.add(best[2])
            exp[d[2]] = (int(bool(best) and not best[3]), int(not best))
    got = match.match_imagenet(*tables).collect()
    assert {r.det_id: (r.tp, r.fp) for r in got} == exp


def test_match_imagenet_by_area(boxes, tables):
    """Each range by itself: truths outside it count for nothing, detections outside it without a truth neither."""
    ranges, truths, exp = [(0.0, 1e10), (0.0, 900.0), (900.0, 1e10)], grouped(boxes[1], 2), {}
    area = lambda b: (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
    for k, (lo, hi) in enumerate(ranges):
        for key, group in grouped(boxes[0], 2).items():
            taken = set()
            for d in by_score(group):
                best, own = None, -1.0
                for t in truths.get(key, []):
                    w, h = t[7] - t[5] + 1, t[8] - t[6] + 1
                    o = iou(d[4:], t[5:])
                    if t[2] not in taken and o >= min(w * h / ((w + 10) * (h + 10)), 0.5) and o > own:
                        best, own = t, o
                if best:
                    taken.add(best[2])
                exp[k, d[2]] = (int(bool(best) and not best[3] and lo <= area(best[5:]) < hi), int(not best and lo <= area(d[4:]) < hi))
    got = match.match_imagenet(*tables, area_ranges=ranges).collect()
    assert {(r.range_idx, r.det_id): (r.tp, r.fp) for r in got} == exp


def recall_pairs(boxes, num, usable=lambda t: True):
    """(gt_id, iou): the best pair left over, again and again, among an image's ``num`` best proposals."""
    dets, out = grouped(boxes[0], 1), {}
    for key, mine in grouped([t for t in boxes[1] if usable(t)], 1).items():
        props = by_score(dets.get(key, []))[:num]
        pairs = sorted((-iou(t[5:], p[4:]), i, j) for i, t in enumerate(mine) for j, p in enumerate(props))
        out |= {t[2]: 0.0 for t in mine}
        rows, cols = set(), set()
        for o, i, j in pairs:
            if i not in rows and j not in cols:
                rows.add(i)
                cols.add(j)
                out[mine[i][2]] = -o
    return out


def test_match_recall(boxes, tables):
    got = {(r.gt_id, r.num): round(r.iou, 9) for r in match.match_recall(tables[1], tables[0], [3, 100]).collect()}
    assert got == {(g, n): round(o, 9) for n in (3, 100) for g, o in recall_pairs(boxes, n).items()}


def test_recalls(boxes, tables):
    thrs, exp = (0.3, 0.5, 0.7), {}
    for n in (3, 100):
        o = list(recall_pairs(boxes, n, lambda t: not t[3] and not t[4]).values())
        each = [sum(v >= t for v in o) / len(o) for t in thrs]
        exp |= {(n, t): round(e, 9) for t, e in zip(thrs, each, strict=True)} | {(n, None): round(sum(each) / 3, 9)}
    got = metrics.eval_recalls(tables[1], tables[0], [3, 100], thrs).collect()
    assert {(r.num, r.thr): round(r.recall, 9) for r in got} == exp


def coco_rows(boxes, thr, lo, hi, most=100):
    """det_id -> (label, score, matched, ignored), by the protocol's own loop: truths that count first, and none after them if one is held."""
    truths, out = grouped(boxes[1], 2), {}
    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    for key, group in grouped(boxes[0], 2).items():
        ign = lambda t: t[3] or t[4] or not lo <= area(t[5:]) <= hi
        mine, held = sorted(truths.get(key, []), key=ign), set()  # a stable sort
        for d in by_score(group)[:most]:
            best, own = None, min(thr, 1 - 1e-10)
            for t in mine:
                if t[2] in held and not t[4]:
                    continue
                if best and not ign(best) and ign(t):
                    break
                o = iou(d[4:], t[5:], 0.0, t[4])
                if o >= own:
                    best, own = t, o
            if best:
                held.add(best[2])
            out[d[2]] = (key[1], d[3], bool(best), ign(best) if best else not lo <= area(d[4:]) <= hi)
    return out


@pytest.mark.parametrize("area", ["all", "small", "medium"])
def test_match_coco(boxes, tables, area):
    got = match.match_coco(*tables, iou_thrs=(0.5, 0.75), areas={area: match.AREAS[area]}).collect()
    for thr in (0.5, 0.75):
        exp = {d: (m, i) for d, (_, _, m, i) in coco_rows(boxes, thr, *match.AREAS[area]).items()}
        assert {r.det_id: (r.matched, r.ignored) for r in got if r.thr == thr} == exp


def coco_ap(boxes, thr, area):
    """Mean over the labels of the precision at 101 recalls."""
    lo, hi = match.AREAS[area]
    rows, out = coco_rows(boxes, thr, lo, hi), {}
    for label in {t[1] for t in boxes[1]}:
        n = sum(t[1] == label and not t[3] and not t[4] and lo <= (t[7] - t[5]) * (t[8] - t[6]) <= hi for t in boxes[1])
        if not n:
            continue
        tp = fp = 0
        curve = []
        for _, (_, _, hit, _) in sorted(((-v[1], d), v) for d, v in rows.items() if v[0] == label and not v[3]):
            tp, fp = tp + hit, fp + (not hit)
            curve.append((tp / n, tp / (tp + fp)))
        out[label] = sum(max((p for r, p in curve if r >= k / 100 - 1e-9), default=0.0) for k in range(101)) / 101
    return out


def test_coco_metrics(boxes, tables):
    got = {r.metric: r.value for r in metrics.coco_metrics(*tables).collect()}
    mean = lambda x: sum(x) / len(x)
    for name, thrs, area in [("AP", match.IOU_THRS, "all"), ("AP50", [0.5], "all"), ("AP75", [0.75], "all"), ("APs", match.IOU_THRS, "small"), ("APm", match.IOU_THRS, "medium")]:
        assert got[name] == pytest.approx(mean([v for t in thrs for v in coco_ap(boxes, t, area).values()]), abs=1e-9), name
    own = {r.label: r.ap100 for r in metrics.coco_classwise(*tables).collect()}
    for label in own:
        assert own[label] == pytest.approx(100 * mean([coco_ap(boxes, t, "all")[label] for t in match.IOU_THRS]), abs=1e-7)
