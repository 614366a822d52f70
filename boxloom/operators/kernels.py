"""Small numpy kernels for steps whose outcome depends on the order of earlier decisions. No Spark here."""

from __future__ import annotations

import numpy as np


def iou_one(b: np.ndarray, rest: np.ndarray, offset: float = 1.0) -> np.ndarray:
    w = np.maximum(np.minimum(b[2], rest[:, 2]) - np.maximum(b[0], rest[:, 0]) + offset, 0)
    h = np.maximum(np.minimum(b[3], rest[:, 3]) - np.maximum(b[1], rest[:, 1]) + offset, 0)
    inter = w * h
    union = (b[2] - b[0] + offset) * (b[3] - b[1] + offset) + (rest[:, 2] - rest[:, 0] + offset) * (rest[:, 3] - rest[:, 1] + offset) - inter
    return np.where(union != 0, inter / np.where(union == 0, 1, union), 0.0)


def nms(boxes: np.ndarray, thr: float, offset: float = 1.0, ge: bool = False) -> np.ndarray:
    """Kept row numbers; ``boxes`` (n, 4) come in the order of decision."""
    live, keep = np.arange(len(boxes)), []
    while len(live):
        i, live = live[0], live[1:]
        keep.append(i)
        over = iou_one(boxes[i], boxes[live], offset)
        live = live[over < thr] if ge else live[over <= thr]
    return np.array(keep, np.int64)


def soft_nms(boxes: np.ndarray, scores: np.ndarray, thr: float, method: str, sigma: float, min_score: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, decayed scores) in the order of selection."""
    s, live, keep, out = scores.astype(float).copy(), np.arange(len(boxes)), [], []
    while len(live):
        k = int(np.argmax(s[live]))
        i = live[k]
        if s[i] < min_score:
            break
        keep.append(i)
        out.append(s[i])
        live = np.delete(live, k)
        over = iou_one(boxes[i], boxes[live])
        if method == "linear":
            s[live] *= np.where(over > thr, 1 - over, 1.0)
        elif method == "gaussian":
            s[live] *= np.exp(-(over * over) / sigma)
        else:
            s[live] *= np.where(over > thr, 0.0, 1.0)
        live = live[s[live] >= min_score]
    return np.array(keep, np.int64), np.array(out)


def vote(boxes: np.ndarray, thr: float) -> np.ndarray:
    """Leader of each row: rows come by score, a leader takes all free rows over the threshold."""
    lead = np.full(len(boxes), -1)
    for i in range(len(boxes)):
        if lead[i] < 0:
            free = np.flatnonzero(lead < 0)
            lead[free[iou_one(boxes[i], boxes[free]) > thr]] = i
            lead[i] = i
    return lead


def match_imagenet(dets: np.ndarray, gts: np.ndarray, ignore: np.ndarray, thr: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tp, fp) of detections by score. Boxes start one pixel earlier; small truths have a smaller threshold. ``within``: whether a
    detection without a truth counts."""
    tp, fp = np.zeros(len(dets), int), np.zeros(len(dets), int)
    within = np.ones(len(dets), bool) if within is None else within
    if not len(gts):
        return tp, within.astype(int)
    g, d = gts - 1.0, dets - 1.0
    w, h = g[:, 2] - g[:, 0] + 1, g[:, 3] - g[:, 1] + 1
    need = np.minimum(w * h / ((w + 10) * (h + 10)), thr)
    taken = np.zeros(len(g), bool)
    for i in range(len(d)):
        over = np.where(taken, -1.0, iou_one(d[i], g))
        over[over < need] = -1.0
        j = int(np.argmax(over))
        if over[j] >= 0:
            taken[j] = True
            tp[i] = int(not ignore[j])
        else:
            fp[i] = int(within[i])
    return tp, fp


def coco_overlaps(dets: np.ndarray, gts: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """(dets, truths) IoU without the +1 rule; against a crowd, over the detection's own area."""
    w = np.maximum(np.minimum(dets[:, None, 2], gts[None, :, 2]) - np.maximum(dets[:, None, 0], gts[None, :, 0]), 0)
    h = np.maximum(np.minimum(dets[:, None, 3], gts[None, :, 3]) - np.maximum(dets[:, None, 1], gts[None, :, 1]), 0)
    own = ((dets[:, 2] - dets[:, 0]) * (dets[:, 3] - dets[:, 1]))[:, None]
    under = np.where(crowd[None, :], own, own + ((gts[:, 2] - gts[:, 0]) * (gts[:, 3] - gts[:, 1]))[None, :] - w * h)
    return np.where(under > 0, w * h / np.where(under > 0, under, 1), 0.0)


def match_coco(over: np.ndarray, ignore: np.ndarray, crowd: np.ndarray, thr: float) -> np.ndarray:
    """Matched truth of each detection (by score), or -1. Counted truths come first; a crowd can match again and again."""
    out = np.full(len(over), -1)
    if not over.shape[1]:
        return out
    free = np.ones(over.shape[1], bool)
    need = min(thr, 1 - 1e-10)
    possible = over >= need
    for i in np.flatnonzero(possible.any(1)):
        for kind in (~ignore, ignore):
            ok = np.flatnonzero(possible[i] & kind & (free | crowd))
            if len(ok):  # the last of equal overlaps, as each one that is no worse replaces the one before
                best = over[i, ok]
                j = ok[len(ok) - 1 - int(np.argmax(best[::-1]))]
                free[j] = False
                out[i] = j
                break
    return out


def match_coco_all(over: np.ndarray, present: np.ndarray, ignore: np.ndarray, crowd: np.ndarray, need: np.ndarray) -> np.ndarray:
    """(k, dets) matched truth or -1, as :func:`match_coco`, for k combinations together: ``present`` and ``ignore`` are (k, truths)."""
    n, g = over.shape
    out = np.full((len(need), n), -1)
    if not g:
        return out
    every, free = np.arange(len(need)), np.ones((len(need), g), bool)
    counted, rest = present & ~ignore, present & ignore
    for i in np.flatnonzero((over >= need.min()).any(1)):
        possible = (over[i] >= need[:, None]) & (free | crowd)
        for kind in (counted, rest):
            ok = possible & kind
            some = ok.any(1) & (out[:, i] < 0)
            if some.any():  # the last of equal overlaps, as each one that is no worse replaces the one before
                j = g - 1 - np.where(ok, over[i], -1.0)[:, ::-1].argmax(1)
                out[some, i] = j[some]
        taken = every[out[:, i] >= 0]
        free[taken, out[taken, i]] = False
    return out


def match_recall(over: np.ndarray) -> np.ndarray:
    """IoU that each truth (row) gets when the best remaining pair is taken again and again."""
    a, out = over.astype(float).copy(), np.zeros(len(over))
    for _ in range(min(a.shape)) if a.size else ():
        i, j = np.unravel_index(int(np.argmax(a)), a.shape)
        if a[i, j] < 0:
            break
        out[i] = a[i, j]
        a[i, :], a[:, j] = -1, -1
    return out
