"""Non-maximum suppression and its relatives. Ties in score go to the smallest det_id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import box, iou
from boxloom.operators import kernels
from boxloom.operators.groups import per_group, schema_of
from boxloom.operators.tables import drop, materialise
from boxloom.operators.windows import topk_per

XY = ["x1", "y1", "x2", "y2"]


def best_first():
    return [F.desc("score"), F.asc("det_id")]


def nms(dets: DataFrame, keys: Sequence[str], thr: float = 0.5, offset: int = 1, cmp: str = "gt", keep_top_k: int | None = None, engine: str = "fold") -> DataFrame:
    """Survivors of greedy suppression per key, with their columns.

    engine 'fold': built-in aggregate over the key's sorted array, for keys of up to about a thousand boxes; 'numpy': a
    vectorised kernel per key, for dense keys; 'rounds': grid cells of a key side by side (:func:`nms_in_rounds`), for keys of any size.
    """
    keys = list(keys)
    if engine == "rounds":
        out = nms_in_rounds(dets, keys, thr, offset, cmp)
    elif engine == "numpy":
        out = _by_kernel(dets, keys, lambda b: kernels.nms(b, thr, offset, cmp == "ge"))
    else:
        rest = [c for c in dets.columns if c not in [*keys, "score", "det_id"]]
        item = F.struct((-F.col("score")).alias("neg"), "det_id", *rest)
        boxes = dets.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("boxes"))

        def add(kept, d):
            over = lambda k: iou(box(source=k), box(source=d), offset=offset)
            hit = F.exists(kept, lambda k: over(k) >= thr if cmp == "ge" else over(k) > thr)
            return F.when(hit, kept).otherwise(F.concat(kept, F.array(d)))

        kept = F.aggregate("boxes", F.filter("boxes", lambda _: F.lit(False)), add)
        out = boxes.select(*keys, F.explode(kept).alias("d")).select(*keys, (-F.col("d.neg")).alias("score"), "d.det_id", *[f"d.{c}" for c in rest]).select(*dets.columns)
    return out if keep_top_k is None else topk_per(out, keys, [F.desc("score"), F.asc("det_id")], keep_top_k)


def _by_kernel(dets: DataFrame, keys: list[str], rows: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(g):
        keep = rows(np.stack([g[c] for c in XY], 1))
        return [c[keep] for c in g.values()]

    return per_group(dets, keys, best_first(), run, schema_of(dets))


#: Median sides of a box that a grid cell of :func:`nms_in_rounds` measures.
CELL_SIDES = 12


def nms_in_rounds(dets: DataFrame, keys: Sequence[str], thr: float = 0.5, offset: int = 1, cmp: str = "gt", cell: float | None = None) -> DataFrame:
    """The survivors of greedy suppression, found in grid cells side by side; the same rows as one sequential pass.

    A box goes if a box that stays is better and overlaps it, and stays if every better neighbour goes. In a cell, boxes are worked off by
    score. One that lies in this cell alone is decided as soon as no open neighbour is better. One that reaches into other cells is decided after
    the round, by what all of its cells say: it goes if one of them says so, and stays if none has an open better neighbour. The next round takes
    the open boxes, and those that stay in their cells. A round decides at least the best open box of every key, and in practice all but
    chains that cross borders of cells, so rounds are few. ``cell``: its side; by default ``CELL_SIDES`` times the median side of the boxes.
    """
    keys = list(keys)
    if thr < 0 or (cmp == "ge" and thr == 0):
        raise ValueError("boxes that do not overlap would meet: the threshold is too low")
    rows = materialise(dets.withColumn("_row", F.monotonically_increasing_id()))  # written with its numbers: det_ids may repeat
    if not cell:
        side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + offset
        cell = CELL_SIDES * max([1.0, *rows.select(side.alias("s")).approxQuantile("s", [0.5], 0.05)])
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) + offset) / cell))
    cells = rows.select(*keys, "_row", "det_id", "score", *XY, F.lit(0).alias("state"), span("x1", "x2").alias("_xs"), span("y1", "y2").alias("_ys"))
    cells = cells.select(*keys, "_row", "det_id", "score", *XY, "state", (F.size("_xs") * F.size("_ys") > 1).alias("wide"), F.explode("_xs").alias("cx"), "_ys").withColumn("cy", F.explode("_ys")).drop("_ys")

    def run(g):
        n = len(g["_row"])
        b = np.stack([g[c] for c in XY], 1).astype(float)
        stays, wide = g["state"] == 1, g["wide"].astype(bool)
        gone, held = np.zeros(n, bool), np.zeros(n, bool)
        for i in range(n):
            if gone[i]:
                continue
            over = kernels.iou_one(b[i], b[i + 1 :], offset)
            near = over >= thr if cmp == "ge" else over > thr
            if stays[i] or not (held[i] or wide[i]):
                gone[i + 1 :] |= near & ~stays[i + 1 :]
            else:
                held[i + 1 :] |= near
        open_ = ~stays
        return [g["_row"][open_], gone[open_], held[open_]]

    kept = None
    cells = materialise(cells)
    while True:
        said = per_group(cells, [*keys, "cx", "cy"], [*best_first(), F.asc("_row")], run, "_row long, gone boolean, held boolean")
        verdict = materialise(said.groupBy("_row").agg(F.bool_or("gone").alias("gone"), F.bool_or("held").alias("held")))
        new = verdict.where("NOT gone AND NOT held").select("_row")
        kept = new if kept is None else kept.unionByName(new)
        waiting = verdict.where("NOT gone AND held").select("_row")
        if waiting.isEmpty():
            break
        open_ = cells.where("state = 0").join(waiting, "_row", "left_semi")
        stay = cells.where("state = 1").unionByName(cells.where("state = 0").join(new, "_row", "left_semi").withColumn("state", F.lit(1)))
        stay = stay.join(open_.select(*keys, "cx", "cy").distinct(), [*keys, "cx", "cy"], "left_semi")
        old, cells = cells, materialise(open_.unionByName(stay.select(*open_.columns)))
        drop(old)
    return rows.join(kept, "_row", "left_semi").select(*dets.columns)


def multiclass_nms(boxes: DataFrame, score_thr: float, iou_thr: float, max_num: int | None = None, factors: str | None = None, op: Callable = nms) -> DataFrame:
    """``boxes``: image_id, box_id, x1.., scores array (class 1 first). Returns label (0-based), det_id = box_id, score.

    ``factors``: a column that multiplies the scores after the threshold.
    """
    t = boxes.select("image_id", F.col("box_id").alias("det_id"), *XY, *([factors] if factors else []), F.posexplode("scores").alias("label", "score")).where(F.col("score") > score_thr)
    if factors:
        t = t.withColumn("score", F.col("score") * F.col(factors)).drop(factors)
    t = op(t, ["image_id", "label"], iou_thr)
    return t if max_num is None or max_num < 0 else topk_per(t, ["image_id"], [F.desc("score"), F.asc("label"), F.asc("det_id")], max_num)


def soft_nms(dets: DataFrame, keys: Sequence[str], thr: float, method: str = "linear", sigma: float = 0.5, min_score: float = 1e-3) -> DataFrame:
    """Rows in ``dets`` that stay above ``min_score``, with their decayed scores."""

    def run(g):
        rows, s = kernels.soft_nms(np.stack([g[c] for c in XY], 1), g["score"], thr, method, sigma, min_score)
        return [s if n == "score" else c[rows] for n, c in g.items()]

    return per_group(dets, list(keys), best_first(), run, schema_of(dets))


def bbox_voting(dets: DataFrame, keys: Sequence[str], thr: float) -> DataFrame:
    """Greedy clusters around leaders: keys, det_id of the leader, score-weighted mean box, greatest score, members."""
    keys = list(keys)
    rows = dets.select(*keys, "det_id", "score", *XY)

    def run(g):
        return [*g.values(), g["det_id"][kernels.vote(np.stack([g[c] for c in XY], 1), thr)]]

    c = per_group(rows, keys, best_first(), run, schema_of(rows, "lead long"))
    mean = lambda x: F.when(F.count("*") == 1, F.first(x)).otherwise(F.sum(F.col(x) * F.col("score")) / F.sum("score"))
    return c.groupBy(*keys, "lead").agg(*[mean(x).alias(x) for x in XY], F.max("score").alias("score"), F.count("*").alias("members")).withColumnRenamed("lead", "det_id")


def merge_tiles(tile_dets: DataFrame, tile_thr: float = 0.5, tile_top: int = 100, image_thr: float = 0.5, engine: str = "fold", image_engine: str | None = None) -> DataFrame:
    """Two stages: each tile keeps its best, then the image. ``tile_dets`` has tile_x, tile_y and boxes within the tile.

    ``image_engine``: that of the second stage, where it differs.
    """
    t = nms(tile_dets, ["image_id", "tile_x", "tile_y"], tile_thr, keep_top_k=tile_top, engine=engine)
    t = t.withColumns({"x1": F.col("x1") + F.col("tile_x"), "x2": F.col("x2") + F.col("tile_x"), "y1": F.col("y1") + F.col("tile_y"), "y2": F.col("y2") + F.col("tile_y")})
    return nms(t, ["image_id"], image_thr, engine=engine if image_engine is None else image_engine)


def merge_aug_bboxes(boxes: DataFrame) -> DataFrame:
    """``boxes``: image_id, box_idx, aug, img_w, scale, flip, x1.., scores. Mapped back and averaged over augmentations."""
    from boxloom.functions.geometry import map_box_back

    b = map_box_back(box(), F.col("img_w"), F.col("scale"), F.col("flip"))
    t = boxes.select("image_id", "box_idx", *[c.alias(n) for c, n in zip(b, XY, strict=True)], F.posexplode("scores").alias("k", "s"))
    one = t.groupBy("image_id", "box_idx", "k").agg(*[F.avg(c).alias(c) for c in XY], F.avg("s").alias("s"))
    return one.groupBy("image_id", "box_idx").agg(*[F.first(c).alias(c) for c in XY], F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("scores"))


def merge_aug_proposals(props: DataFrame, thr: float, max_num: int) -> DataFrame:
    """Proposals of all augmentations mapped back, suppressed per image, best ``max_num``."""
    from boxloom.functions.geometry import map_box_back

    b = map_box_back(box(), F.col("img_w"), F.col("scale"), F.col("flip"))
    t = props.select("image_id", "det_id", "score", *[c.alias(n) for c, n in zip(b, XY, strict=True)])
    return topk_per(nms(t, ["image_id"], thr), ["image_id"], [F.desc("score"), F.asc("det_id")], max_num)


def ensemble_scores(stages: DataFrame, keys: Sequence[str] = ("image_id", "box_idx", "label")) -> DataFrame:
    return stages.groupBy(*keys).agg(F.avg("score").alias("score"))


def _decoded(raw: DataFrame, anchors: DataFrame, best: Column, nms_pre: int, means, stds, max_w, max_h) -> DataFrame:
    """The ``nms_pre`` best predictions of each image and level by ``best`` (score), with decoded boxes."""
    from boxloom.functions.geometry import delta2bbox
    from boxloom.operators.pairs import decode_join

    t = topk_per(decode_join(raw.withColumn("score", best), anchors), ["image_id", "level"], [F.desc("score"), F.asc("anchor_idx")], nms_pre)
    b = delta2bbox(box("a_"), [F.col(c) for c in ("dx", "dy", "dw", "dh")], means, stds, max_w, max_h)
    return t.select("image_id", "level", F.col("anchor_idx").cast("long").alias("det_id"), "score", *[c for c in ("scores", "factor") if c in raw.columns], *[c.alias(n) for c, n in zip(b, XY, strict=True)])


def decode_head(
    raw: DataFrame, anchors: DataFrame, nms_pre: int = 1000, score_thr: float = 0.05, iou_thr: float = 0.5, max_per_img: int = 100, means=(0.0,) * 4, stds=(1.0,) * 4,
    max_w=None, max_h=None, scale: float = 1.0, factors: str | None = None, op: Callable = nms,
) -> DataFrame:
    """Boxes of an image from raw head output: best of each level, decoded, scaled back, suppressed per class.

    ``raw``: image_id, anchor_idx, dx.., scores (array of the classes, foreground first), one row per anchor and image.
    """
    t = _decoded(raw, anchors, F.array_max("scores"), nms_pre, means, stds, max_w, max_h)
    t = t.select("image_id", F.col("det_id").alias("box_id"), "scores", *([factors] if factors else []), *[(F.col(c) / scale).alias(c) for c in XY])
    return multiclass_nms(t, score_thr, iou_thr, max_per_img, factors, op)


def decode_points(
    raw: DataFrame, points: DataFrame, nms_pre: int = 1000, score_thr: float = 0.05, iou_thr: float = 0.5, max_per_img: int = 100, max_w=None, max_h=None, scale: float = 1.0, op: Callable = nms
) -> DataFrame:
    """Boxes of an image from point predictions: the best of each level by score times centre-ness, decoded from the distances to the sides, scaled
    back, suppressed per class with scores times centre-ness.

    ``raw``: image_id, point_idx, l, t, r, b, scores (foreground classes), centerness; ``points``: point_idx, level, x, y, a fixed grid.
    """
    from boxloom.functions.geometry import distance2bbox

    t = raw.join(F.broadcast(points.select("point_idx", "level", "x", "y")), "point_idx")
    t = topk_per(t.withColumn("_best", F.array_max("scores") * F.col("centerness")), ["image_id", "level"], [F.desc("_best"), F.asc("point_idx")], nms_pre)
    b = distance2bbox(F.col("x"), F.col("y"), *[F.col(c) for c in ("l", "t", "r", "b")], max_w, max_h)
    t = t.select("image_id", F.col("point_idx").cast("long").alias("box_id"), "scores", "centerness", *[(c / scale).alias(n) for c, n in zip(b, XY, strict=True)])
    return multiclass_nms(t, score_thr, iou_thr, max_per_img, "centerness", op)


def decode_cascade(
    stages: DataFrame, rois: DataFrame, score_thr: float = 0.05, iou_thr: float = 0.5, max_per_img: int = 100, means=(0.0,) * 4, stds=(0.1, 0.1, 0.2, 0.2), max_w=None, max_h=None, scale: float = 1.0,
    op: Callable = nms,
) -> DataFrame:
    """Boxes of an image from a cascade: scores are the mean over the stages, boxes those of the last stage.

    ``stages``: image_id, box_idx, stage, scores (foreground classes); ``rois``: image_id, box_idx, box and dx, dy, dw, dh of the last stage.
    """
    from boxloom.functions.geometry import delta2bbox

    s = stages.select("image_id", "box_idx", F.posexplode("scores").alias("label", "score"))
    s = ensemble_scores(s).groupBy("image_id", "box_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "score"))), lambda x: x["score"]).alias("scores"))
    b = delta2bbox(box(), [F.col(c) for c in ("dx", "dy", "dw", "dh")], means, stds, max_w, max_h)
    t = rois.select("image_id", "box_idx", *[(c / scale).alias(n) for c, n in zip(b, XY, strict=True)]).join(s, ["image_id", "box_idx"])
    return multiclass_nms(t.withColumnRenamed("box_idx", "box_id"), score_thr, iou_thr, max_per_img, None, op)


def rpn_proposals(
    raw: DataFrame, anchors: DataFrame, nms_pre: int = 2000, nms_post: int = 2000, max_num: int = 2000, nms_thr: float = 0.7, min_size: float = 0, across: bool = False,
    means=(0.0,) * 4, stds=(1.0,) * 4, max_w=None, max_h=None,
) -> DataFrame:
    """Proposals of an image: best of each level, decoded, large enough, suppressed within the level; the best over all
    levels, suppressed once more if ``across``. ``raw``: image_id, anchor_idx, dx.., score."""
    t = _decoded(raw, anchors, F.col("score"), nms_pre, means, stds, max_w, max_h)
    if min_size > 0:
        t = t.where((F.col("x2") - F.col("x1") + 1 >= min_size) & (F.col("y2") - F.col("y1") + 1 >= min_size))
    t = nms(t, ["image_id", "level"], nms_thr, keep_top_k=nms_post)
    t = nms(t, ["image_id"], nms_thr) if across else t
    return topk_per(t, ["image_id"], best_first(), max_num)


def merge_aug_masks(masks: DataFrame, weights: bool = False) -> DataFrame:
    """``masks``: image_id, mask_id, aug, width, flip, values (row by row)[, weight]. Flipped back, (weighted) mean per pixel."""
    t = masks.select("image_id", "mask_id", "width", "flip", (F.col("weight") if weights else F.lit(1.0)).alias("w"), F.posexplode("values").alias("p", "v"))
    col = F.col("p") % F.col("width")
    t = t.withColumn("p", F.when(F.col("flip"), F.col("p") - col + F.col("width") - 1 - col).otherwise(F.col("p")))
    one = t.groupBy("image_id", "mask_id", "p").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return one.groupBy("image_id", "mask_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("values"))


def refine_bboxes(rois: DataFrame, means=(0.0,) * 4, stds=(1.0,) * 4, max_w=None, max_h=None) -> DataFrame:
    """``rois``: image_id, box_id, box, label, deltas (class-wise), is_gt. Decoded by the predicted class; truths that were added as proposals go."""
    from boxloom.functions.geometry import class_delta, delta2bbox

    b = delta2bbox(box(), class_delta(F.col("deltas"), F.col("label")), means, stds, max_w, max_h)
    return rois.where(~F.col("is_gt")).select("image_id", "box_id", "label", *[c.alias(n) for c, n in zip(b, XY, strict=True)])
