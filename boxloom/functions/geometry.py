"""Box geometry as Column expressions. A box is any four columns in the order x1, y1, x2, y2.

Corners are inclusive pixels (``offset=1``: width = x2 - x1 + 1) unless a function says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", source: Column | None = None) -> Box:
    """The box in the columns (or fields of a struct) prefix + x1, y1, x2, y2."""
    get = (lambda n: source[n]) if source is not None else F.col
    return Box(*[get(prefix + n) for n in ("x1", "y1", "x2", "y2")])


def named(b: Box, prefix: str = "") -> list[Column]:
    return [c.alias(prefix + n) for c, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)]


def area(b: Box, offset: int = 1) -> Column:
    return (b.x2 - b.x1 + offset) * (b.y2 - b.y1 + offset)


def intersection(a: Box, b: Box, offset: int = 1) -> Column:
    w = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + offset, F.lit(0.0))
    h = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1) + offset, F.lit(0.0))
    return w * h


def iou(a: Box, b: Box, mode: str = "iou", offset: int = 1) -> Column:
    """Intersection over union, or over the area of ``a`` (mode 'iof'); 0 where that is 0."""
    inter = intersection(a, b, offset)
    under = area(a, offset) if mode == "iof" else area(a, offset) + area(b, offset) - inter
    return F.coalesce(F.try_divide(inter, F.nullif(under, F.lit(0.0))), F.lit(0.0))


def coverage(window: Box, b: Box, eps: float = 1e-6) -> Column:
    """Share of ``b`` inside the window, without the +1 rule."""
    return intersection(window, b, 0) / F.greatest(area(b, 0), F.lit(eps))


def xyxy2xywh(b: Box, offset: int = 1) -> list[Column]:
    return [b.x1, b.y1, b.x2 - b.x1 + offset, b.y2 - b.y1 + offset]


def xywh2xyxy(x: Column, y: Column, w: Column, h: Column, offset: int = 1) -> Box:
    return Box(x, y, x + w - offset, y + h - offset)


def bbox2delta(prop: Box, gt: Box, means=(0.0,) * 4, stds=(1.0,) * 4) -> list[Column]:
    pw, ph, gw, gh = prop.x2 - prop.x1 + 1, prop.y2 - prop.y1 + 1, gt.x2 - gt.x1 + 1, gt.y2 - gt.y1 + 1
    raw = [((gt.x1 + gt.x2) - (prop.x1 + prop.x2)) / 2 / pw, ((gt.y1 + gt.y2) - (prop.y1 + prop.y2)) / 2 / ph, F.ln(gw / pw), F.ln(gh / ph)]
    return [(d - m) / s for d, m, s in zip(raw, means, stds, strict=True)]


def _clip(c: Column, top: Column | float | None) -> Column:
    return c if top is None else F.least(F.greatest(c, F.lit(0.0)), top if isinstance(top, Column) else F.lit(float(top)))


def clip_box(b: Box, w, h, inner: int = 1) -> Box:
    """To [0, w - inner] and [0, h - inner]."""
    top = lambda v: None if v is None else v - inner
    return Box(_clip(b.x1, top(w)), _clip(b.y1, top(h)), _clip(b.x2, top(w)), _clip(b.y2, top(h)))


def delta2bbox(roi: Box, delta: Sequence[Column], means=(0.0,) * 4, stds=(1.0,) * 4, max_w=None, max_h=None, wh_ratio_clip: float = 16 / 1000) -> Box:
    dx, dy, dw, dh = (d * s + m for d, m, s in zip(delta, means, stds, strict=True))
    most = abs(math.log(wh_ratio_clip))
    dw, dh = (F.greatest(F.least(d, F.lit(most)), F.lit(-most)) for d in (dw, dh))
    pw, ph = roi.x2 - roi.x1 + 1, roi.y2 - roi.y1 + 1
    gw, gh = pw * F.exp(dw), ph * F.exp(dh)
    gx, gy = (roi.x1 + roi.x2) * 0.5 + pw * dx, (roi.y1 + roi.y2) * 0.5 + ph * dy
    return clip_box(Box(gx - gw * 0.5 + 0.5, gy - gh * 0.5 + 0.5, gx + gw * 0.5 - 0.5, gy + gh * 0.5 - 0.5), max_w, max_h)


def class_delta(deltas: Column, label: Column) -> list[Column]:
    """The four deltas of the label from a class-wise array (label 0 first)."""
    part = F.slice(deltas, label * 4 + 1, F.lit(4))
    return [F.element_at(part, i) for i in range(1, 5)]


def distance2bbox(x: Column, y: Column, left: Column, top: Column, right: Column, bottom: Column, max_w=None, max_h=None) -> Box:
    return clip_box(Box(x - left, y - top, x + right, y + bottom), max_w, max_h)


def flip_box(b: Box, w: Column, h: Column, direction: str = "horizontal") -> Box:
    if direction == "horizontal":
        return Box(w - b.x2 - 1, b.y1, w - b.x1 - 1, b.y2)
    if direction == "vertical":
        return Box(b.x1, h - b.y2 - 1, b.x2, h - b.y1 - 1)
    raise ValueError(f"unknown direction {direction!r}")


def _either(flag: Column, a: Box, b: Box) -> Box:
    return Box(*[F.when(flag, p).otherwise(q) for p, q in zip(a, b, strict=True)])


def map_box(b: Box, img_w: Column, scale: Column, flip: Column) -> Box:
    """To the test scale: times scale, then mirrored at the scaled width ``img_w``."""
    s = Box(*[c * scale for c in b])
    return _either(flip, flip_box(s, img_w, img_w), s)


def map_box_back(b: Box, img_w: Column, scale: Column, flip: Column) -> Box:
    f = _either(flip, flip_box(b, img_w, img_w), b)
    return Box(*[c / scale for c in f])


def rescale_size(w: Column, h: Column, long_max: float, short_max: float) -> tuple[Column, Column, Column]:
    """(new width, new height, factor) of a resize that keeps the ratio."""
    f = F.least(F.lit(float(long_max)) / F.greatest(w, h), F.lit(float(short_max)) / F.least(w, h))
    return F.floor(w * f + 0.5), F.floor(h * f + 0.5), f


def resize_box(b: Box, sx: Column, sy: Column, new_w, new_h) -> Box:
    return clip_box(Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy), new_w, new_h)


def pad_shape(w: Column, h: Column, size: tuple[int, int] | None = None, divisor: int | None = None) -> tuple[Column, Column]:
    if size:
        return F.lit(size[0]), F.lit(size[1])
    return tuple((F.ceil(v / F.lit(float(divisor))) * divisor).cast("long") for v in (w, h))


def roi_level(b: Box, finest_scale: int = 56, num_levels: int = 4) -> Column:
    lvl = F.floor(F.log2(F.sqrt(area(b)) / finest_scale + 1e-6))
    return F.least(F.greatest(lvl, F.lit(0)), F.lit(num_levels - 1)).cast("int")


def roi_rescale(b: Box, factor: float) -> Box:
    cx, cy, w, h = (b.x1 + b.x2) * 0.5, (b.y1 + b.y2) * 0.5, (b.x2 - b.x1 + 1) * factor, (b.y2 - b.y1 + 1) * factor
    return Box(cx - w * 0.5 + 0.5, cy - h * 0.5 + 0.5, cx + w * 0.5 - 0.5, cy + h * 0.5 - 0.5)


def centerness(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.sqrt(F.least(left, right) / F.greatest(left, right) * (F.least(top, bottom) / F.greatest(top, bottom)))


def calc_region(b: Box, ratio: float, w=None, h=None) -> Box:
    """The central part of a box, rounded half to even."""
    lo = lambda p, q: F.bround((1 - ratio) * p + ratio * q)
    r = Box(lo(b.x1, b.x2), lo(b.y1, b.y2), F.bround(ratio * b.x1 + (1 - ratio) * b.x2), F.bround(ratio * b.y1 + (1 - ratio) * b.y2))
    return clip_box(r, w, h)


def points2bbox(pts: Column, method: str = "minmax", y_first: bool = True, transfer=(0.0, 0.0)) -> Box:
    """The box of a flat array of point coordinates: minmax, partial_minmax (first 4 points) or moment."""
    pick = lambda odd: F.filter(pts, lambda _, i: i % 2 == odd)
    ys, xs = (pick(0), pick(1)) if y_first else (pick(1), pick(0))
    if method == "partial_minmax":
        ys, xs = F.slice(ys, 1, 4), F.slice(xs, 1, 4)
    if method != "moment":
        return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = lambda a: total(a) / F.size(a)
    dev = lambda a: F.sqrt(total(F.transform(a, lambda v: (v - mean(a)) * (v - mean(a)))) / (F.size(a) - 1))
    hx, hy = dev(xs) * math.exp(transfer[0]), dev(ys) * math.exp(transfer[1])
    return Box(mean(xs) - hx, mean(ys) - hy, mean(xs) + hx, mean(ys) + hy)


def reppoints_decode(b: Box, x: Column, y: Column, stride: Column, w, h) -> Box:
    return clip_box(Box(b.x1 * stride + x, b.y1 * stride + y, b.x2 * stride + x, b.y2 * stride + y), w, h, 0)


def fovea_decode(x: Column, y: Column, stride: Column, base: Column, p: Sequence[Column], w, h) -> Box:
    raw = Box(stride * x - base * F.exp(p[0]), stride * y - base * F.exp(p[1]), stride * x + base * F.exp(p[2]), stride * y + base * F.exp(p[3]))
    return clip_box(raw, w, h)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def softmax(arr: Column) -> Column:
    # the greatest score and the sum are worked out once, outside the lambda of the entries
    e = lambda top: F.transform(arr, lambda v: F.exp(v - top))
    over = lambda x: F.transform(x, lambda y: F.transform(y["e"], lambda v: v / y["sum"]))
    exps = F.transform(F.array(F.array_max(arr)), e)
    sums = F.transform(exps, lambda x: F.struct(x.alias("e"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v).alias("sum")))
    return F.element_at(over(sums), 1)


def shift_box(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


# ------------------------------------------------------------------ choices reproducible by hash


def hash_unit(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) from the ids: the same under retries and any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1_000_003)) / F.lit(1_000_003.0)


def flip_flag(seed: int, ratio: float, *ids: Column) -> Column:
    return hash_unit(seed, *ids) < ratio


def pick_scale(seed: int, scales: Sequence[tuple[int, int]], *ids: Column, mode: str = "value", ratio_range=None) -> Column:
    """struct(long, short): one of ``scales``, a size between two of them, or the one scale times a drawn ratio."""
    u, v = hash_unit(seed, *ids), hash_unit(seed + 1, *ids)
    if ratio_range:
        lo, hi = ratio_range
        r = u * (hi - lo) + lo
        return F.struct(F.floor(r * scales[0][0]).cast("int").alias("long"), F.floor(r * scales[0][1]).cast("int").alias("short"))
    if mode == "range":
        ls, ss = sorted(max(s) for s in scales), sorted(min(s) for s in scales)
        draw = lambda x, a, b: (F.lit(a) + F.floor(x * (b - a + 1))).cast("int")
        return F.struct(draw(u, ls[0], ls[-1]).alias("long"), draw(v, ss[0], ss[-1]).alias("short"))
    all_ = F.array(*[F.struct(F.lit(max(s)).alias("long"), F.lit(min(s)).alias("short")) for s in scales])
    return F.element_at(all_, (F.floor(u * len(scales)) + 1).cast("int"))


def expand_box(b: Box, w: Column, h: Column, seed: int, *ids: Column, ratio_range=(1, 4), prob: float = 0.5) -> Box:
    """Boxes on a canvas enlarged by a drawn ratio, the image at a drawn place of it."""
    r = hash_unit(seed, *ids) * (ratio_range[1] - ratio_range[0]) + ratio_range[0]
    left, top = F.floor(hash_unit(seed + 1, *ids) * (w * r - w)), F.floor(hash_unit(seed + 2, *ids) * (h * r - h))
    on = hash_unit(seed + 3, *ids) < prob
    return _either(on, shift_box(b, left.cast("double"), top.cast("double")), b)


# ------------------------------------------------------------------ flags and labels


def best_class(scores: Column) -> Column:
    """struct(label, score) of the first greatest score; label counts from 1."""
    m = F.array_max(scores)
    return F.struct(F.array_position(scores, m).cast("int").alias("label"), m.alias("score"))


def confident(df, scores: Column, thr: float):
    """``df`` with label and score of the best class, where that is above ``thr``."""
    return df.withColumn("_best", best_class(scores)).select("*", "_best.label", "_best.score").drop("_best").where(F.col("score") > thr)


def large_flag(b: Box, min_size: float) -> Column:
    """Whether both sides reach ``min_size``."""
    return (b.x2 - b.x1 + 1 >= min_size) & (b.y2 - b.y1 + 1 >= min_size)


def aspect_flag(w: Column, h: Column) -> Column:
    return F.when(w / h > 1, 1).otherwise(0)


def inside_flag(b: Box, img_w: Column, img_h: Column, border: float = 0) -> Column:
    return F.lit(True) if border < 0 else (b.x1 >= -border) & (b.y1 >= -border) & (b.x2 < img_w + border) & (b.y2 < img_h + border)


def loc_mask(loc: Column, thr: float = 0.0) -> Column:
    """Whether a position's location score reaches the threshold."""
    return sigmoid(loc) >= thr


def valid_anchor_flag(col: Column, row: Column, stride: int, pad_w: Column, pad_h: Column) -> Column:
    return (col < F.ceil(pad_w / F.lit(float(stride)))) & (row < F.ceil(pad_h / F.lit(float(stride))))


# ------------------------------------------------------------------ names


def strip_ext(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^./]*$", "")


def swap_ext(c: Column, new: str) -> Column:
    return F.regexp_replace(c, r"\.[^./]*$", f".{new}")


def fmt4(c: Column) -> Column:
    return F.format_string("%.4f", c)


def pretty_distortion(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def voc_year(path: Column) -> Column:
    return F.when(path.contains("2007"), 2007).when(path.contains("2012"), 2012).otherwise(F.raise_error(F.lit("cannot infer the year from the path")).cast("int"))
