"""Assignment of boxes and points to truths, and training targets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.geometry import bbox2delta, box
from boxloom.operators.groups import per_group
from boxloom.operators.pairs import XY, ignore_mask, iou_pairs, points_by_block


def assign_max_iou(
    boxes: DataFrame, gts: DataFrame, pos_thr: float, neg_thr: float | tuple[float, float], min_pos_iou: float = 0.0,
    assign_all: bool = True, require_overlap: bool = False, cell: float = 128.0, ignores: DataFrame | None = None, ignore_iof_thr: float = -1.0, wrt_candidates: bool = True,
) -> DataFrame:
    """``boxes`` (image_id, box_id, box) with gt_id, max_iou and assigned: -1 ignored, 0 negative, 1 positive.

    1. max_iou below neg_thr (or within [lo, hi)) is negative. 2. max_iou >= pos_thr takes its best truth (first on ties).
    3. Truth by truth, the boxes that equal the truth's best IoU take it if that is at least ``min_pos_iou``; a later truth
    overwrites. With ``min_pos_iou`` 0 a truth that overlaps nothing claims every box of the image (the first one without
    ``assign_all``), unless ``require_overlap``. Boxes that lie in an ignore region by more than ``ignore_iof_thr`` (if above 0) take
    no part: -1 and max_iou -1.

    Only overlapping pairs are made, in grid cells; the claims of truths without overlap come from one row per image.
    """
    whole, out_of_it = boxes, None
    if ignores is not None and ignore_iof_thr > 0:
        m = ignore_mask(boxes.select("image_id", "box_id", *XY), ignores, ignore_iof_thr, "box_id", wrt_candidates).where("excluded").select("image_id", "box_id")
        out_of_it = whole.join(m, ["image_id", "box_id"], "left_semi")
        boxes = whole.join(m, ["image_id", "box_id"], "left_anti")
    b, g = boxes.select("image_id", "box_id", *XY), gts.select("image_id", "gt_id", *XY)
    p = iou_pairs(b, g, ["image_id"], cell=cell).select("image_id", "box_id", "gt_id", "iou")
    t = _by_pairs(boxes, g, p, pos_thr, neg_thr, min_pos_iou, assign_all, require_overlap)
    return t if out_of_it is None else t.unionByName(_left_out(out_of_it))


def _left_out(boxes: DataFrame) -> DataFrame:
    return boxes.select("*", F.lit(-1.0).alias("max_iou"), F.lit(None).cast("long").alias("gt_id"), F.lit(-1).alias("assigned"))


def _by_pairs(boxes: DataFrame, g: DataFrame, p: DataFrame, pos_thr: float, neg_thr: float | tuple[float, float], min_pos_iou: float, assign_all: bool, require_overlap: bool) -> DataFrame:
    """The three steps of :func:`assign_max_iou`, from pairs that overlap (image_id, box_id, gt_id, iou)."""
    alone = g.join(p.select("image_id", "gt_id").distinct(), ["image_id", "gt_id"], "left_anti") if min_pos_iou <= 0 and not require_overlap else None
    p = p.withColumn("gt_best", F.max("iou").over(Window.partitionBy("image_id", "gt_id")))
    low = (F.col("iou") == F.col("gt_best")) & (F.col("gt_best") >= min_pos_iou)
    if not assign_all:
        w = Window.partitionBy("image_id", "gt_id").orderBy(F.desc("iou"), F.asc("box_id"))
        p = p.withColumn("_first", F.row_number().over(w) == 1)
        low = low & F.col("_first")
    a = p.groupBy("image_id", "box_id").agg(F.max("iou").alias("max_iou"), F.max_by("gt_id", F.struct("iou", -F.col("gt_id"))).alias("best"), F.max(F.when(low, F.col("gt_id"))).alias("claimed"))
    t = boxes.join(a, ["image_id", "box_id"], "left").withColumn("max_iou", F.coalesce("max_iou", F.lit(0.0)))
    if alone is not None:
        z = alone.groupBy("image_id").agg(F.max("gt_id").alias("_alone")).join(boxes.groupBy("image_id").agg(F.min("box_id").alias("_first_box")), "image_id")
        t = t.join(z, "image_id", "left").withColumn("claimed", F.greatest("claimed", "_alone" if assign_all else F.when(F.col("box_id") == F.col("_first_box"), F.col("_alone"))))
    lo, hi = (0.0, neg_thr) if isinstance(neg_thr, (int, float)) else neg_thr
    gt = F.coalesce("claimed", F.when(F.col("max_iou") >= pos_thr, F.col("best")))
    neg = (F.col("max_iou") >= lo) & (F.col("max_iou") < hi)
    t = t.select(*boxes.columns, "max_iou", gt.alias("gt_id"), F.when(gt.isNotNull(), 1).when(neg, 0).otherwise(-1).alias("assigned"))
    return t


def assign_approx_max_iou(
    approxs: DataFrame, squares: DataFrame, gts: DataFrame, pos_thr: float, neg_thr: float | tuple[float, float], min_pos_iou: float = 0.0,
    assign_all: bool = True, ignores: DataFrame | None = None, ignore_iof_thr: float = -1.0, wrt_candidates: bool = True, cell: float = 128.0,
) -> DataFrame:
    """As above, with the IoU of a square being the greatest of its approximations (box_id of both the same).

    Squares that lie in an ignore region by more than ``ignore_iof_thr`` (if above 0) take no part; that test is on the squares
    themselves, which then need their boxes. Approximations and truths meet in grid cells.
    """
    out_of_it = None
    if ignores is not None and ignore_iof_thr > 0:
        m = ignore_mask(squares.select("image_id", "box_id", *XY), ignores, ignore_iof_thr, "box_id", wrt_candidates).where("excluded").select("image_id", "box_id")
        out_of_it, squares = squares.join(m, ["image_id", "box_id"], "left_semi"), squares.join(m, ["image_id", "box_id"], "left_anti")
        approxs = approxs.join(m, ["image_id", "box_id"], "left_anti")
    g = gts.select("image_id", "gt_id", *XY)
    p = iou_pairs(approxs.select("image_id", "box_id", *XY), g, ["image_id"], cell=cell)
    p = p.groupBy("image_id", "box_id", "gt_id").agg(F.max("iou").alias("iou"))
    t = _by_pairs(squares, g, p, pos_thr, neg_thr, min_pos_iou, assign_all, False)
    return t if out_of_it is None else t.unionByName(_left_out(out_of_it))


def assign_points(points: DataFrame, gts: DataFrame, scale: float = 4.0, pos_num: int = 3) -> DataFrame:
    """(image_id, point_idx, gt_id, dist): the ``pos_num`` nearest points of the truth's level; a point goes to the nearest truth.

    ``points``: point_idx, level, x, y, stride; a grid per level. Levels start at log2(stride of the first). A truth meets the points
    of the ``2 * pos_num + 1`` grid columns and rows around its centre (moved onto the grid): any other has ``pos_num`` nearer ones before it.
    """
    lv = points.agg(F.min("level").alias("lo"), F.max("level").alias("hi"))
    w, h = F.greatest(F.col("x2") - F.col("x1"), F.lit(1e-6)), F.greatest(F.col("y2") - F.col("y1"), F.lit(1e-6))
    g = gts.join(F.broadcast(lv))  # one row
    want = F.floor((F.log2(w / scale) + F.log2(h / scale)) / 2)
    g = g.select("image_id", "gt_id", ((F.col("x1") + F.col("x2")) / 2).alias("gx"), ((F.col("y1") + F.col("y2")) / 2).alias("gy"), w.alias("gw"), h.alias("gh"), F.greatest(F.least(want, F.col("hi")), F.col("lo")).alias("level"))
    pts = points.select("point_idx", F.col("level").cast("long").alias("level"), "x", "y", "stride")
    grid = pts.groupBy("level").agg(F.first("stride").alias("s"), F.min("x").alias("x0"), F.max("x").alias("x9"), F.min("y").alias("y0"), F.max("y").alias("y9"))
    col = lambda v, lo: F.round((F.col(v) - F.col(lo)) / F.col("s")).cast("long")
    near = lambda c, lo, hi: F.sequence(*[F.least(F.greatest(F.least(F.greatest(col(c, lo), F.lit(0)), col(hi, lo)) + k, F.lit(0)), col(hi, lo)) for k in (-pos_num, pos_num)])
    g = g.join(F.broadcast(grid.limit(64)), "level")  # a row per level
    g = g.withColumn("cx", F.explode(near("gx", "x0", "x9"))).withColumn("cy", F.explode(near("gy", "y0", "y9")))
    at = pts.join(F.broadcast(grid.select("level", "s", "x0", "y0").limit(64)), "level").select("point_idx", "level", "x", "y", col("x", "x0").alias("cx"), col("y", "y0").alias("cy"))
    j = g.join(at, ["level", "cx", "cy"])
    dx, dy = (F.col("x") - F.col("gx")) / F.col("gw"), (F.col("y") - F.col("gy")) / F.col("gh")
    j = j.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    near = j.withColumn("_rn", F.row_number().over(Window.partitionBy("image_id", "gt_id").orderBy("dist", "point_idx"))).where(F.col("_rn") <= pos_num)
    return near.groupBy("image_id", "point_idx").agg(F.min(F.struct("dist", "gt_id")).alias("m")).select("image_id", "point_idx", "m.gt_id", "m.dist")


FCOS_RANGES = ((-1.0, 64.0), (64.0, 128.0), (128.0, 256.0), (256.0, 512.0), (512.0, 1e8))


def fcos_targets(points: DataFrame, gts: DataFrame, ranges: Sequence[tuple[float, float]] = FCOS_RANGES) -> DataFrame:
    """(image_id, point_idx, gt_id, label, l, t, r, b) of the points with a truth (the smallest one); others are background."""
    j = points_by_block(points, gts, ranges)
    best = j.groupBy("image_id", "level", "_bx", "_by", "point_idx").agg(F.min(F.struct("area", "gt_id", "label", "l", "t", "r", "b")).alias("m"))  # a point is in one block
    return best.select("image_id", "point_idx", *[f"m.{c}" for c in ("gt_id", "label", "l", "t", "r", "b")])


#: Stride, base length, smallest and largest truth (square root of its area) of each level.
FOVEA_LEVELS = ((4, 16.0, 8.0, 32.0), (8, 32.0, 16.0, 64.0), (16, 64.0, 32.0, 128.0), (32, 128.0, 64.0, 256.0), (64, 256.0, 128.0, 512.0))


def fovea_targets(gts: DataFrame, feat_sizes: Sequence[tuple[int, int]], levels: Sequence[tuple[int, float, float, float]] = FOVEA_LEVELS, sigma: float = 0.4) -> DataFrame:
    """(image_id, level, row, col, gt_id, label, t0..t3) of the grid cells within the central part (``sigma`` of each side) of a truth.

    A truth takes part on every level whose range holds its size; of several truths on a cell the smallest wins (the smallest
    gt_id on ties). Other cells are background. Targets are logs of the distances to the sides, over the base length and within [1/16, 16].
    ``feat_sizes``: (height, width) of each level.
    """
    each = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(s).alias("s"), F.lit(b).alias("base"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(h - 1).alias("last_row"), F.lit(w - 1).alias("last_col")) for i, ((h, w), (s, b, lo, hi)) in enumerate(zip(feat_sizes, levels, strict=True))])
    size = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    g = gts.select("image_id", "gt_id", "label", *XY, size.alias("size"), F.explode(each).alias("v")).select("*", "v.*").where("size >= lo AND size <= hi")

    def span(a: str, z: str, last: str):
        lo, half = F.col(a) / F.col("s"), (F.col(z) / F.col("s") - F.col(a) / F.col("s")) * 0.5
        within = lambda v: F.least(F.greatest(v, F.lit(0)), F.col(last))
        first, end = within(F.ceil(lo + half * (1 - sigma) - 0.5)), within(F.floor(lo + half * (1 + sigma) - 0.5))
        return F.explode(F.when(first <= end, F.sequence(first, end)))  # none where no cell's centre lies inside

    g = g.withColumn("row", span("y1", "y2", "last_row")).withColumn("col", span("x1", "x2", "last_col"))
    best = g.groupBy("image_id", "level", "row", "col").agg(F.min_by(F.struct("gt_id", "label", "s", "base", *XY), F.struct("size", "gt_id")).alias("m")).select("image_id", "level", "row", "col", "m.*")
    x, y = (F.col("col") + 0.5) * F.col("s"), (F.col("row") + 0.5) * F.col("s")
    sides = [x - F.col("x1"), y - F.col("y1"), F.col("x2") - x, F.col("y2") - y]
    return best.select("image_id", "level", "row", "col", "gt_id", "label", *[F.ln(F.least(F.greatest(d / F.col("base"), F.lit(1 / 16)), F.lit(16.0))).alias(f"t{i}") for i, d in enumerate(sides)])


def anchor_bags(pairs: DataFrame, k: int = 50, bbox_thr: float = 0.6) -> DataFrame:
    """The k best anchors of each truth (rank) and the object-box probability of every pair. ``pairs``: image_id, gt_id, anchor_idx, iou."""
    own = Window.partitionBy("image_id", "gt_id")
    top = F.greatest(F.max("iou").over(own), F.lit(bbox_thr + 1e-12))
    p = pairs.select("image_id", "gt_id", "anchor_idx", "iou", F.least(F.greatest((F.col("iou") - bbox_thr) / (top - bbox_thr), F.lit(0.0)), F.lit(1.0)).alias("prob"))
    return p.withColumn("rank", F.row_number().over(own.orderBy(F.desc("iou"), F.asc("anchor_idx")))).where(F.col("rank") <= k)


class AnchorIndex:
    """The anchors of one tile size, as arrays: which of them overlap a box, and by how much."""

    #: Numbers of anchors that may be kept for ranges of cells seen before.
    HELD = 4_000_000

    def __init__(self, ids: np.ndarray, boxes: np.ndarray, cell: float = 64.0):
        """``boxes``: x1, y1, x2, y2 as rows."""
        self.ids, self.boxes, self.cell = ids, boxes, cell
        self.areas = (boxes[2] - boxes[0] + 1) * (boxes[3] - boxes[1] + 1)
        self.low, self.high = np.floor(boxes[:2] / cell), np.floor((boxes[2:] + 1) / cell)
        self.seen: dict[tuple, np.ndarray] = {}
        self.held = 0

    def near(self, cells: tuple) -> np.ndarray:
        """Numbers of the anchors that touch a range of grid cells (first column and row, last column and row)."""
        got = self.seen.get(cells)
        if got is None:
            c0, r0, c1, r1 = cells
            got = np.flatnonzero((self.low[0] <= c1) & (self.high[0] >= c0) & (self.low[1] <= r1) & (self.high[1] >= r0)).astype(np.int32)
            if self.held + len(got) > self.HELD:
                self.seen, self.held = {}, 0
            self.seen[cells] = got
            self.held += len(got)
        return got

    def overlaps(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, iou) of the anchors that overlap box ``b``, in the arithmetic of :func:`boxloom.functions.geometry.iou`."""
        at = self.near((*np.floor(b[:2] / self.cell).tolist(), *np.floor((b[2:] + 1) / self.cell).tolist()))
        x1, y1, x2, y2 = self.boxes[:, at]
        w = np.minimum(x2, b[2]) - np.maximum(x1, b[0]) + 1
        h = np.minimum(y2, b[3]) - np.maximum(y1, b[1]) + 1
        hit = np.flatnonzero((w > 0) & (h > 0))
        at, inter = at[hit], w[hit] * h[hit]
        under = self.areas[at] + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - inter
        v = np.divide(inter, under, out=np.zeros(len(at)), where=under != 0)
        return self.ids[at[v > 0]], v[v > 0]


def best_anchors(anchors: DataFrame, gts: DataFrame, k: int = 50, bbox_thr: float = 0.6) -> DataFrame:
    """:func:`anchor_bags` of :func:`boxloom.operators.pairs.anchor_pairs`, without a row per pair: a truth overlaps thousands of anchors, and k are kept.

    The anchors of a tile size are a fixed table and go to every task; truths are dealt by (image_id, gt_id).
    """
    a = anchors.select(F.col("anchor_idx").cast("long").alias("anchor_idx"), *[F.col(c).cast("double").alias(c) for c in XY]).dropna().toArrow()
    cols = [c.to_numpy() for c in a.columns]
    index = AnchorIndex(cols[0], np.stack(cols[1:]))

    def run(g):
        found = [index.overlaps(b) for b in np.stack([g[c] for c in XY], 1)]  # one, but where a truth is repeated
        ids, v = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(ids):
            return None
        if len(v) > k:
            least = np.partition(v, len(v) - k)[len(v) - k]
            ids, v = ids[v >= least], v[v >= least]
        first = np.lexsort((ids, -v))[:k]
        n = len(first)
        return [np.repeat(g["image_id"][:1], n), np.repeat(g["gt_id"][:1], n), ids[first], v[first], np.full(n, v.max()), np.arange(1, n + 1, dtype=np.int32)]

    rows = gts.select(*[F.col(c).cast("long").alias(c) for c in ("image_id", "gt_id")], *[F.col(c).cast("double").alias(c) for c in XY]).dropna(subset=XY)
    t = per_group(rows, ["image_id", "gt_id"], [], run, "image_id long, gt_id long, anchor_idx long, iou double, _best double, rank int")
    top = F.greatest("_best", F.lit(bbox_thr + 1e-12))
    return t.select("image_id", "gt_id", "anchor_idx", "iou", F.least(F.greatest((F.col("iou") - bbox_thr) / (top - bbox_thr), F.lit(0.0)), F.lit(1.0)).alias("prob"), "rank")


def anchor_targets(assigned: DataFrame, gts: DataFrame, means=(0.0,) * 4, stds=(1.0,) * 4, pos_weight: float = -1.0) -> DataFrame:
    """label, label_weight, d0..d3, bbox_weight of every assigned box; ignored boxes weigh 0."""
    g = gts.select("image_id", "gt_id", F.col("label").alias("g_label"), *[F.col(c).alias("g_" + c) for c in XY])
    j = assigned.join(g, ["image_id", "gt_id"], "left")
    pos = F.col("assigned") == 1
    d = bbox2delta(box(), box("g_"), means, stds)
    return j.select(
        "image_id", "box_id", "assigned", F.when(pos, F.col("g_label")).otherwise(0).alias("label"),
        F.when(pos, F.lit(float(pos_weight if pos_weight > 0 else 1.0))).when(F.col("assigned") == 0, 1.0).otherwise(0.0).alias("label_weight"),
        *[F.when(pos, x).otherwise(0.0).alias(f"d{i}") for i, x in enumerate(d)], F.when(pos, 1.0).otherwise(0.0).alias("bbox_weight"),
    )


def target_totals(assigned: DataFrame) -> DataFrame:
    """One row (n_pos, n_neg): what losses are averaged by. Every image counts at least one of each, also where it has none."""
    per = assigned.groupBy("image_id").agg(F.count_if(F.col("assigned") == 1).alias("p"), F.count_if(F.col("assigned") == 0).alias("n"))
    return per.agg(F.sum(F.greatest("p", F.lit(1))).alias("n_pos"), F.sum(F.greatest("n", F.lit(1))).alias("n_neg"))


def point_targets(assigned: DataFrame, gts: DataFrame, pos_weight: float = -1.0) -> DataFrame:
    """label, label_weight, the truth's own box t_x1.. (zeros unless positive) and bbox_weight: targets of points and shapes."""
    t = anchor_targets(assigned.where("x2 >= x1 AND y2 >= y1"), gts, pos_weight=pos_weight).drop("d0", "d1", "d2", "d3")
    own = assigned.select("image_id", "box_id", "gt_id").join(gts.select("image_id", "gt_id", *[F.col(c).alias("t_" + c) for c in XY]), ["image_id", "gt_id"], "left")
    own = own.select("image_id", "box_id", *[F.coalesce("t_" + c, F.lit(0.0)).alias("t_" + c) for c in XY])
    return t.join(own, ["image_id", "box_id"])


def by_level(targets: DataFrame) -> DataFrame:
    """Rows (level, image_id, box_id ...) with their position within the level, image after image: numbered in two passes."""
    from boxloom.operators.windows import cum_sum_by_rank

    t = cum_sum_by_rank(targets.withColumn("_one", F.lit(1).cast("long")), ["level"], [F.col("image_id"), F.col("box_id")], {"_n": "_one"})
    return t.select(*targets.columns, (F.col("_n") - 1).alias("position"))


def roi_targets(targets: DataFrame, num_classes: int) -> DataFrame:
    """Class-wise layout: arrays of 4 * num_classes deltas and weights with the label's slots filled."""
    at = lambda i: F.floor(i / F.lit(4.0)) == F.col("label")
    four = F.array("d0", "d1", "d2", "d3")
    slots = F.sequence(F.lit(0), F.lit(4 * num_classes - 1))
    pos = F.col("assigned") == 1
    return targets.select(
        "image_id", "box_id", "label", "label_weight",
        F.transform(slots, lambda i: F.when(pos & at(i), F.element_at(four, (i % 4 + 1).cast("int"))).otherwise(0.0)).alias("deltas"),
        F.transform(slots, lambda i: F.when(pos & at(i), 1.0).otherwise(0.0)).alias("weights"),
    )
