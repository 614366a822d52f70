"""Matching of detections with ground truth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.operators import kernels
from boxloom.operators.groups import per_group
from boxloom.operators.pairs import iou_pairs

XY = ["x1", "y1", "x2", "y2"]


def _best(dets: DataFrame, gts: DataFrame, cell: float | None) -> DataFrame:
    """Every detection with the truth of the greatest IoU (smallest gt_id on ties), or nulls."""
    extra = [c for c in ("is_ignore", "g_area") if c in gts.columns]
    p = iou_pairs(dets.select("image_id", "label", "det_id", *XY), gts.select("image_id", "label", "gt_id", *extra, *XY), min_iou=0.0, cell=cell)
    top = p.groupBy("image_id", "label", "det_id").agg(F.max_by(F.struct("gt_id", "iou", *extra), F.struct("iou", -F.col("gt_id"))).alias("g"))
    return dets.join(top, ["image_id", "label", "det_id"], "left").select(dets["*"], "g.gt_id", F.coalesce("g.iou", F.lit(0.0)).alias("iou"), *[f"g.{c}" for c in extra])


def match_voc(dets: DataFrame, gts: DataFrame, thr: float = 0.5, cmp: str = "gt", cell: float | None = None) -> DataFrame:
    """``dets`` with gt_id, iou, tp, fp. A truth counts for its first detection by score; ignored truths count for none.

    The truth that a detection aims at does not depend on other detections, so two window-free steps and one
    rank per truth are exact.
    """
    m = _best(dets, gts, cell)
    hit = F.col("iou") >= thr if cmp == "ge" else F.col("iou") > thr
    m = m.withColumn("hit", F.coalesce(hit & F.col("gt_id").isNotNull(), F.lit(False)))
    w = Window.partitionBy("image_id", "label", "gt_id", "hit").orderBy(F.desc("score"), F.asc("det_id"))
    m = m.withColumn("_rn", F.row_number().over(w))
    skip = F.col("hit") & F.coalesce("is_ignore", F.lit(False))
    tp = (F.col("hit") & ~skip & (F.col("_rn") == 1)).cast("int")
    return m.select(*dets.columns, "gt_id", "iou", tp.alias("tp"), (~skip & (tp == 0)).cast("int").alias("fp"))


def match_default(dets: DataFrame, gts: DataFrame, thr: float = 0.5, area_ranges: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """As :func:`match_voc` with IoU >= thr, for each area range: truths outside it are ignored, and unmatched detections
    outside it count for nothing. Adds range_idx."""
    ranges = list(area_ranges or [(0.0, 1e10)])
    g = gts.withColumn("g_area", (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1))
    m = _best(dets, g, None)
    rs = F.array(*[F.struct(F.lit(i).alias("range_idx"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(ranges)])
    m = m.withColumn("_r", F.explode(rs)).select("*", "_r.*").drop("_r")
    inside = lambda c: (c >= F.col("lo")) & (c < F.col("hi"))
    m = m.withColumn("hit", F.coalesce((F.col("iou") >= thr) & F.col("gt_id").isNotNull(), F.lit(False)))
    w = Window.partitionBy("range_idx", "image_id", "label", "gt_id", "hit").orderBy(F.desc("score"), F.asc("det_id"))
    m = m.withColumn("_rn", F.row_number().over(w))
    off = F.col("hit") & (F.col("is_ignore") | ~inside(F.col("g_area")))
    d_area = (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)
    tp = (F.col("hit") & ~off & (F.col("_rn") == 1)).cast("int")
    fp = F.when(F.col("hit"), (~off & (F.col("_rn") > 1)).cast("int")).otherwise(inside(d_area).cast("int"))
    return m.select(*dets.columns, "range_idx", "gt_id", "iou", tp.alias("tp"), fp.alias("fp"))


def _both(dets: DataFrame, gts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections and truths in one table, so that one shuffle brings them together: kind 0 and 1, id, score, flags, box."""
    flag = lambda t, c: F.coalesce(c, F.lit(False)).alias(c) if c in t.columns else F.lit(False).alias(c)
    k = [F.col(c).cast("long").alias(c) for c in keys]
    d = dets.select(*k, F.lit(0).alias("kind"), F.col("det_id").alias("id"), F.col("score").cast("double").alias("score"), F.lit(False).alias("is_ignore"), F.lit(False).alias("is_crowd"), *XY)
    g = gts.select(*k, F.lit(1).alias("kind"), F.col("gt_id").alias("id"), F.lit(0.0).alias("score"), flag(gts, "is_ignore"), flag(gts, "is_crowd"), *XY)
    return d.unionByName(g)


def _order():
    return [F.asc("kind"), F.desc("score"), F.asc("id")]


def _split(g: dict[str, np.ndarray]):
    n = int(np.searchsorted(g["kind"], 1))
    b = np.stack([g[c] for c in XY], 1).astype(float)
    return n, b[:n], b[n:]


def match_imagenet(dets: DataFrame, gts: DataFrame, thr: float = 0.5, area_ranges: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """image_id, label, det_id, score, tp, fp under the size-dependent threshold; a truth is taken even if ignored.

    With ``area_ranges`` a row per range (range_idx): truths outside it count as ignored, detections outside it without a truth for nothing.
    """

    def run(g):
        n, d, t = _split(g)
        if not n:
            return None
        ign = g["is_ignore"][n:].astype(bool)
        size = lambda b: (b[:, 2] - b[:, 0] + 1) * (b[:, 3] - b[:, 1] + 1)
        own = [g["image_id"][:n], g["label"][:n], g["id"][:n], g["score"][:n]]
        if area_ranges is None:
            return [*own, *kernels.match_imagenet(d, t, ign, thr)]
        got = [kernels.match_imagenet(d, t, ign | (size(t) < lo) | (size(t) >= hi), thr, (size(d) >= lo) & (size(d) < hi)) for lo, hi in area_ranges]
        return [*[np.tile(c, len(got)) for c in own], np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]), np.repeat(np.arange(len(got)), n)]

    keys, more = ["image_id", "label"], "" if area_ranges is None else ", range_idx int"
    return per_group(_both(dets, gts, keys), keys, _order(), run, f"image_id long, label long, det_id long, score double, tp int, fp int{more}")


AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
IOU_THRS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def match_coco(dets: DataFrame, gts: DataFrame, iou_thrs: Sequence[float] = IOU_THRS, areas: dict = AREAS, max_det: int = 100) -> DataFrame:
    """image_id, label, det_id, score, rank, area, thr, matched, ignored: the public protocol, all combinations in one pass
    over the rows of an (image, label). Detections are cut to the best ``max_det`` of an image and label."""
    names = list(areas)

    def run(g):
        n, d, t = _split(g)
        m = min(n, max_det)
        if not m:
            return None
        d = d[:m]
        crowd = g["is_crowd"][n:].astype(bool)
        base = g["is_ignore"][n:].astype(bool) | crowd
        g_area, d_area = (t[:, 2] - t[:, 0]) * (t[:, 3] - t[:, 1]), (d[:, 2] - d[:, 0]) * (d[:, 3] - d[:, 1])
        over = kernels.coco_overlaps(d, t, crowd)
        hit, dig = [], []
        for lo, hi in areas.values():
            ign = base | (g_area < lo) | (g_area > hi)
            off = (d_area < lo) | (d_area > hi)
            for x in iou_thrs:
                got = kernels.match_coco(over, ign, crowd, x)
                hit.append(got >= 0)
                dig.append(np.where(got >= 0, ign[np.maximum(got, 0)], off) if len(ign) else off)
        k, q = len(names) * len(iou_thrs), len(iou_thrs)
        rep = lambda c: np.tile(c[:m], k)
        return [rep(g["image_id"]), rep(g["label"]), rep(g["id"]), rep(g["score"]), np.tile(np.arange(m), k), np.repeat(np.array(names, object), q * m), np.tile(np.repeat(np.array(iou_thrs), m), len(names)), np.concatenate(hit), np.concatenate(dig)]

    keys = ["image_id", "label"]
    return per_group(_both(dets, gts, keys), keys, _order(), run, "image_id long, label long, det_id long, score double, rank int, area string, thr double, matched boolean, ignored boolean")


def match_recall(gts: DataFrame, props: DataFrame, proposal_nums: Sequence[int] = (100, 300, 1000)) -> DataFrame:
    """image_id, gt_id, num, iou: what each truth gets when the best pair is taken again and again."""

    def run(g):
        n, p, t = _split(g)
        if not len(t):
            return None
        over = np.array([kernels.iou_one(b, p) for b in t]) if n else np.zeros((len(t), 0))
        k = len(proposal_nums)
        return [np.tile(g["image_id"][n:], k), np.tile(g["id"][n:], k), np.repeat(np.array(proposal_nums), len(t)), np.concatenate([kernels.match_recall(over[:, :x]) for x in proposal_nums])]

    return per_group(_both(props, gts, ["image_id"]), ["image_id"], _order(), run, "image_id long, gt_id long, num int, iou double")
