"""Boxes that move: crops drawn by trial, boxes shifted or pasted to drawn places. Draws come from md5 of ids, so retries change nothing."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import box
from boxloom.operators.groups import per_group

XY = ["x1", "y1", "x2", "y2"]
MIN_IOUS = (0.1, 0.3, 0.5, 0.7, 0.9)
TRIALS = 50
#: Modes that an image may draw; with seven modes, one image in 500 has drawn no "whole" by then and stays whole.
ROUNDS = 40
ATTEMPTS = 10
_UNIT = float(1 << 32)
#: Truths that are held against the windows of a round at once.
_PIECE = 20_000


def draw(*ids) -> tuple[int, ...]:
    """Four whole numbers below 2^32: the md5 of the ids."""
    h = hashlib.md5(":".join(map(str, ids)).encode()).hexdigest()
    return tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


# ------------------------------------------------------------------ crops by trial


def _windows(seed: int, image: int, mode: int, width: float, height: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(trials, px1..py2 as columns) of one mode that an image has drawn: whole corners, sides of at least ``least`` of the image's, between half and twice as high as wide."""
    head = f"{seed}:{image}:{mode}:"
    u = np.frombuffer(b"".join([hashlib.md5(f"{head}{k}".encode()).digest() for k in range(TRIALS)]), ">u4").reshape(TRIALS, 4) / _UNIT  # as draw()
    w, h = (least + (1 - least) * u[:, 0]) * width, (least + (1 - least) * u[:, 1]) * height
    left, top = u[:, 2] * (width - w), u[:, 3] * (height - h)
    at = np.flatnonzero((h >= w * 0.5) & (h <= w * 2))
    return at, np.floor(np.stack([left, top, left + w, top + h], 1)[at])


def _overlaps(p: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of windows (rows) with boxes (columns), corners inclusive, in the arithmetic of :func:`boxloom.functions.geometry.iou`; 0 where it has none."""
    p = p[:, :, None]
    w = np.maximum(np.minimum(p[:, 2], b[2]) - np.maximum(p[:, 0], b[0]) + 1, 0.0)
    h = np.maximum(np.minimum(p[:, 3], b[3]) - np.maximum(p[:, 1], b[1]) + 1, 0.0)
    inter = w * h
    under = (p[:, 2] - p[:, 0] + 1) * (p[:, 3] - p[:, 1] + 1) + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - inter
    v = np.divide(inter, under, out=np.zeros(inter.shape), where=under != 0)
    return np.where(np.isnan(v), 0.0, v)


def first_crops(images: DataFrame, gts: DataFrame, seed: int = 0, min_ious: Sequence[float] = MIN_IOUS, min_crop_size: float = 0.3) -> DataFrame:
    """(image_id, round, trial, px1, py1, px2, py2) of every image: the window that :func:`min_iou_crop` takes, nulls where the image stays whole.

    A round draws one mode: leave the image whole, or one of the least overlaps (0 among them) with ``TRIALS`` windows. Rounds go on to the first
    "whole". Windows are tried in the order (round, trial) and no further than to the accepted one, so they are never rows; the truths of an image are one group.
    """
    modes = (1.0, *min_ious, 0.0)

    def run(g):
        image, width, height = int(g["image_id"][0]), float(g["width"][0]), float(g["height"][0])
        b = np.stack([g[c] for c in XY]).astype(float)
        pieces = [b[:, k : k + _PIECE] for k in range(0, b.shape[1], _PIECE)]
        for mode in range(ROUNDS):
            pick = draw(seed, "mode", image, mode)[0] % len(modes)
            if pick == 0:
                return None
            trials, p = _windows(seed, image, mode, width, height, min_crop_size)
            some = np.zeros(len(p), bool)
            for q in pieces:
                cx, cy = (q[0] + q[2]) / 2, (q[1] + q[3]) / 2
                some |= ((cx > p[:, 0:1]) & (cy > p[:, 1:2]) & (cx < p[:, 2:3]) & (cy < p[:, 3:4])).any(1)
            trials, p = trials[some], p[some]
            for q in pieces if modes[pick] > 0 else ():  # no overlap is below 0
                if len(p):
                    good = (_overlaps(p, q) >= modes[pick]).all(1)
                    trials, p = trials[good], p[good]
            if len(p):
                return [np.array([v]) for v in (image, mode, int(trials[0]), *p[0].tolist())]
        return None

    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sizes = images.select("image_id", *[F.col(c).cast("double").alias(c) for c in ("width", "height")])
    rows = gts.select(F.col("image_id"), *[F.col(c).cast("double").alias(c) for c in XY]).repartition(n, "image_id").join(sizes.repartition(n, "image_id").hint("merge"), "image_id")
    first = per_group(rows.withColumn("image_id", F.col("image_id").cast("long")), ["image_id"], [], run, "image_id long, round int, trial int, px1 double, py1 double, px2 double, py2 double")
    return images.select("image_id").join(first.hint("merge"), "image_id", "left")


def to_crops(gts: DataFrame, crops: DataFrame) -> DataFrame:
    """``gts`` whose centre lies inside the window of their image, clipped to it and moved to it, with its round and trial; all truths of whole images as they are."""
    p = box("p")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = (cx > p.x1) & (cy > p.y1) & (cx < p.x2) & (cy < p.y2)
    j = gts.join(crops.hint("merge"), "image_id").where(F.col("px1").isNull() | inside)
    moved = {}
    for a, lo, hi in (("x1", "px1", "px2"), ("y1", "py1", "py2"), ("x2", "px1", "px2"), ("y2", "py1", "py2")):
        v = F.greatest(F.col(a), F.col(lo)) if a[1] == "1" else F.least(F.col(a), F.col(hi))
        moved[a] = F.when(F.col(lo).isNull(), F.col(a)).otherwise(v - F.col(lo))
    return j.select(*[c for c in gts.columns if c not in XY], *[v.alias(k) for k, v in moved.items()], "round", "trial")


def min_iou_crop(images: DataFrame, gts: DataFrame, seed: int = 0, min_ious: Sequence[float] = MIN_IOUS, min_crop_size: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(crops, boxes): the first window of an image, in the order (round, trial), that overlaps every box at least as asked for and holds a box's centre.

    crops: image_id, round, trial, px1.., nulls where the image stays whole (its mode, or no window accepted). boxes: the truths whose centre lies
    inside, clipped to the window and moved to it; all truths of whole images. An image without truths stays whole. ``images``:
    image_id, width, height. Each of the two finds the windows when it is run.
    """
    crops = first_crops(images, gts, seed, min_ious, min_crop_size)
    return crops, to_crops(gts, crops).drop("round", "trial")


# ------------------------------------------------------------------ boxes moved one after the other


def _areas(b: np.ndarray) -> np.ndarray:
    return np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0])
    h = np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1])
    return np.maximum(w, 0) * np.maximum(h, 0)


def _share(part: np.ndarray, whole) -> np.ndarray:
    return np.where(whole > 0, part / np.where(whole > 0, whole, 1), 0.0)


def is_free(a: np.ndarray, boxes: np.ndarray, iou_max: float, cov_max: float) -> bool:
    """Whether box ``a`` touches none of ``boxes`` too much: overlap, or share of either box; no +1 rule, an empty box has no share."""
    if not len(boxes):
        return True
    inter, own, other = _common(a, boxes), _areas(a[None])[0], _areas(boxes)
    worst = lambda x: float(x.max())
    return worst(_share(inter, own + other - inter)) <= iou_max and worst(_share(inter, own)) <= cov_max and worst(_share(inter, other)) <= cov_max


def shift_gts(images: DataFrame, gts: DataFrame, seed: int = 0, rate: float = 0.2, iou_max: float = 0.05, cov_max: float = 0.1) -> DataFrame:
    """image_id, gt_id, label, moved, box: each truth is drawn with ``rate`` to be moved to a place of its own size where it touches no box.

    Places are drawn up to ``ATTEMPTS`` times, one truth after the other by gt_id, against the truths that stay and those already placed. One that
    finds no place, or is as large as the image, is dropped. Moved boxes have whole coordinates. ``images``: image_id, width, height. The truths of an image
    are one group; an image without truths has no row.
    """

    def run(g):
        image, w, h = int(g["image_id"][0]), int(g["width"][0]), int(g["height"][0])
        b = np.stack([g[c] for c in XY], 1).astype(float)
        ids = g["gt_id"].tolist()
        drawn = np.array([draw(seed, "move", image, i)[0] < rate * _UNIT for i in ids])
        place, at = b[~drawn], np.flatnonzero(~drawn).tolist()
        for k in np.flatnonzero(drawn).tolist():
            x1, y1, x2, y2 = (int(v) for v in b[k])
            bw, bh = min(x2, w) - max(x1, 0), min(y2, h) - max(y1, 0)
            for attempt in range(ATTEMPTS if 0 <= bw < w and 0 <= bh < h else 0):
                d = draw(seed, "place", image, ids[k], attempt)
                left, top = d[0] % (w - bw), d[1] % (h - bh)
                a = np.array([left, top, left + bw, top + bh], float)
                if is_free(a, place, iou_max, cov_max):
                    place = np.concatenate([place, a[None]])
                    at.append(k)
                    break
        at = np.array(at, np.int64)
        return [g["image_id"][at], g["gt_id"][at], g["label"][at], drawn[at], *place.T] if len(at) else None

    rows = gts.select("image_id", "gt_id", F.col("label").cast("long").alias("label"), *XY).join(images.select("image_id", "width", "height"), "image_id")
    return per_group(rows, ["image_id"], [F.asc("gt_id")], run, "image_id long, gt_id long, label long, moved boolean, x1 double, y1 double, x2 double, y2 double")


def paste_gts(images: DataFrame, gts: DataFrame, roi_gts: DataFrame, crop: tuple[int, int], seed: int = 0, rate: float = 0.5, min_coverage: float = 0.5, cov_max: float = 0.05) -> DataFrame:
    """image_id, gt_id, label, kind, box: the truths of an image pasted into another crop of its region.

    With ``rate`` an image is redrawn: a window of size ``crop`` at a drawn place of its region (``images``: image_id, width, height of the region) keeps the
    region's truths (``roi_gts``) that it covers by more than ``min_coverage``, moved and clipped (kind ``roi``). Then each of the image's own truths (``gts``, in
    the crop's coordinates) by gt_id is drawn a place up to ``ATTEMPTS`` times and set down unless it covers every box so far by more than ``cov_max`` (kind
    ``pasted``); one without a place, or as large as the crop, is dropped. An image that is not drawn, or ends up without boxes, keeps its own (kind ``kept``).
    """
    cw, ch = crop

    def run(g):
        image, w, h = int(g["image_id"][0]), int(g["width"][0]), int(g["height"][0])
        b = np.stack([g[c] for c in XY], 1).astype(float)
        own, roi = np.flatnonzero(g["source"] == 0), np.flatnonzero(g["source"] == 1)
        kept = [g["image_id"][own], g["gt_id"][own], g["label"][own], np.full(len(own), "kept", object), *b[own].T] if len(own) else None
        d = draw(seed, "paste", image)
        if d[0] >= rate * _UNIT:
            return kept
        nx, ny = (d[1] % (w - cw) if w > cw else 0), (d[2] % (h - ch) if h > ch else 0)
        window = np.array([nx, ny, nx + cw, ny + ch], float)
        at = roi[_share(_common(window, b[roi]), _areas(b[roi])) > min_coverage]
        place = np.clip(b[at] - np.array([nx, ny, nx, ny]), 0, np.array([cw, ch, cw, ch]))
        rows, kinds = at.tolist(), ["roi"] * len(at)
        for k in own.tolist():
            x1, y1, x2, y2 = (int(v) for v in b[k])
            bw, bh = x2 - x1, y2 - y1
            for attempt in range(ATTEMPTS if 0 <= bw < cw and 0 <= bh < ch else 0):
                e = draw(seed, "paste", image, int(g["gt_id"][k]), attempt)
                left, top = e[0] % (cw - bw), e[1] % (ch - bh)
                a = np.array([left, top, left + bw, top + bh], float)
                if not len(place) or not (_share(_common(a, place), _areas(place)) > cov_max).all():
                    place = np.concatenate([place, a[None]])
                    rows.append(k)
                    kinds.append("pasted")
                    break
        if not rows:
            return kept
        rows = np.array(rows, np.int64)
        return [g["image_id"][rows], g["gt_id"][rows], g["label"][rows], np.array(kinds, object), *place.T]

    one = lambda t, s: t.select("image_id", "gt_id", F.col("label").cast("long").alias("label"), F.lit(s).alias("source"), *XY)
    both = one(gts, 0).unionByName(one(roi_gts, 1)).join(images.select("image_id", "width", "height"), "image_id")
    return per_group(both, ["image_id"], [F.asc("source"), F.asc("gt_id")], run, "image_id long, gt_id long, label long, kind string, x1 double, y1 double, x2 double, y2 double")
