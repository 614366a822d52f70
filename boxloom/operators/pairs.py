"""Joins of boxes with boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import box, coverage, iou

XY = ["x1", "y1", "x2", "y2"]


def _prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c if c in XY else c) for c in df.columns])


def iou_pairs(dets: DataFrame, gts: DataFrame, keys: Sequence[str] = ("image_id", "label"), min_iou: float = 0.0, cell: float | None = None, offset: int = 1, mode: str = "iou") -> DataFrame:
    """Pairs of equal keys with IoU above ``min_iou`` (all pairs of a key where that is negative): d_x1.., g_x1.., iou.

    ``cell``: for keys with many boxes. Boxes are dealt to grid cells and only meet inside one; a pair is made in the one
    cell that holds the corner (greatest x1, greatest y1), so no later distinct is needed.
    """
    keys = list(keys)
    d, g = _prefixed(dets, "d_", keys), _prefixed(gts, "g_", keys)
    if cell:
        d, g = (_in_cells(t, p, cell, offset) for t, p in ((d, "d_"), (g, "g_")))
        at = lambda a, b: F.floor(F.greatest(a, b) / cell)
        p = d.join(g, [*keys, "_cx", "_cy"]).where((F.col("_cx") == at(F.col("d_x1"), F.col("g_x1"))) & (F.col("_cy") == at(F.col("d_y1"), F.col("g_y1")))).drop("_cx", "_cy")
    else:
        p = d.join(g, keys)
    p = p.withColumn("iou", iou(box("d_"), box("g_"), mode, offset))
    return p if min_iou < 0 else p.where(F.col("iou") > min_iou)


def _in_cells(df: DataFrame, prefix: str, cell: float, offset: int) -> DataFrame:
    """A row per grid cell that the box (grown by ``offset`` to the right and below) touches."""
    b = box(prefix)
    rng = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor((hi + offset) / cell)))
    return df.withColumn("_cx", rng(b.x1, b.x2)).withColumn("_cy", rng(b.y1, b.y2))


def decode_join(raw: DataFrame, anchors: DataFrame) -> DataFrame:
    """Predictions with their anchors: the grid is a fixed table of one tile size."""
    return raw.join(F.broadcast(_prefixed(anchors.select("anchor_idx", "level", *XY), "a_", ["anchor_idx"])), "anchor_idx")


def anchor_pairs(anchors: DataFrame, gts: DataFrame, cell: float = 64.0) -> DataFrame:
    """(image_id, gt_id, anchor_idx, iou) of anchors and truths that overlap; anchors without a pair overlap nothing."""
    a = F.broadcast(_in_cells(_prefixed(anchors.select("anchor_idx", *XY), "d_", ["anchor_idx"]), "d_", cell, 1))
    g = _in_cells(_prefixed(gts, "g_", []), "g_", cell, 1)
    at = lambda p, q: F.floor(F.greatest(F.col(p), F.col(q)) / cell)
    p = g.join(a, ["_cx", "_cy"]).where((F.col("_cx") == at("d_x1", "g_x1")) & (F.col("_cy") == at("d_y1", "g_y1"))).drop("_cx", "_cy")
    return p.withColumn("iou", iou(box("d_"), box("g_"))).where("iou > 0")


def ignore_mask(boxes: DataFrame, ignores: DataFrame, thr: float, id_col: str = "det_id", wrt_candidates: bool = True, cell: float = 128.0) -> DataFrame:
    """``boxes`` with max_iof over the ignore boxes of the image, and excluded = max_iof > thr. They meet in grid cells."""
    p = iou_pairs(boxes.select("image_id", id_col, *XY), ignores.select("image_id", *XY), ["image_id"], cell=cell)
    part = iou(box("d_"), box("g_"), "iof") if wrt_candidates else iou(box("g_"), box("d_"), "iof")
    m = p.groupBy("image_id", id_col).agg(F.max(part).alias("max_iof"))
    out = boxes.join(m, ["image_id", id_col], "left").withColumn("max_iof", F.coalesce("max_iof", F.lit(0.0)))
    return out.withColumn("excluded", F.col("max_iof") > thr)


#: Grid cells of a block of a level, along either axis.
BLOCK = 16


def points_in_boxes(points: DataFrame, gts: DataFrame, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """Points strictly inside a truth whose farthest side lies in the level's range: l, t, r, b, area.

    The points of a level are a grid of its stride, so a truth names the grid cells that it covers and meets their points by an equi-join;
    levels whose range no point of the truth can reach are left out before. The grid is a fixed table of one image size, so it is what is broadcast, never the truths.
    """
    return points_by_block(points, gts, ranges).drop("_bx", "_by")


def points_by_block(points: DataFrame, gts: DataFrame, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """:func:`points_in_boxes`, dealt by (image_id, level, _bx, _by): what concerns a point of an image is in one task, and only truths were shuffled.

    A block has ``BLOCK`` grid cells along either axis; cells are listed after the shuffle.
    """
    lim = F.element_at(F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in ranges]), F.col("level") + 1)
    at = lambda c: F.floor(F.col(c) / F.col("stride"))
    p = points.withColumn("_lim", lim).withColumn("_cx", at("x")).withColumn("_cy", at("y"))
    levels = points.groupBy("level").agg(F.first("stride").alias("stride"), F.min("x").alias("_x0"), F.max("x").alias("_x9"), F.min("y").alias("_y0"), F.max("y").alias("_y9")).withColumn("_lim", lim)
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    few = levels.limit(len(ranges)).collect()  # a row per level
    names = [c for c in levels.columns if c != "_lim"]
    each = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in names], F.lit(r["_lim"]["lo"]).alias("_lo"), F.lit(r["_lim"]["hi"]).alias("_hi")) for r in few])
    g = gts.select("*", F.explode(each).alias("_level")).select(*gts.columns, "_level.*").where((F.col("_hi") >= side / 2) & (F.col("_lo") <= side))
    cells = lambda lo, hi, a, z: (F.floor(F.greatest(F.col(lo), F.col(a)) / F.col("stride")), F.floor(F.least(F.col(hi), F.col(z)) / F.col("stride")))
    g = g.where("x2 > _x0 AND x1 < _x9 AND y2 > _y0 AND y1 < _y9")
    block = lambda c: F.floor(F.col(c) / BLOCK)
    for axis in "xy":
        lo, hi = cells(f"{axis}1", f"{axis}2", f"_{axis}0", f"_{axis}9")
        g = g.withColumn(f"_lo{axis}", lo).withColumn(f"_hi{axis}", hi)
        g = g.withColumn(f"_b{axis}", F.explode(F.sequence(block(f"_lo{axis}"), block(f"_hi{axis}"))))
    g = g.select(*gts.columns, "level", "_bx", "_by", *[f"_{e}{axis}" for axis in "xy" for e in ("lo", "hi")])
    n = int(gts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))  # fixed: few rows here, many after it
    g = g.repartition(n, "image_id", "level", "_bx", "_by")
    for axis in "xy":
        first = F.col(f"_b{axis}") * BLOCK
        g = g.withColumn(f"_c{axis}", F.explode(F.sequence(F.greatest(F.col(f"_lo{axis}"), first), F.least(F.col(f"_hi{axis}"), first + (BLOCK - 1)))))
    g = g.drop("_lox", "_hix", "_loy", "_hiy")
    j = g.join(F.broadcast(p), ["level", "_cx", "_cy"]).where((F.col("x") > F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") > F.col("y1")) & (F.col("y") < F.col("y2"))).drop("_cx", "_cy")
    j = j.select("*", (F.col("x") - F.col("x1")).alias("l"), (F.col("y") - F.col("y1")).alias("t"), (F.col("x2") - F.col("x")).alias("r"), (F.col("y2") - F.col("y")).alias("b"))
    far = F.greatest("l", "t", "r", "b")
    area = (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)
    return j.where((far >= F.col("_lim.lo")) & (far <= F.col("_lim.hi"))).withColumn("area", area).drop("_lim")


def crop_boxes(windows: DataFrame, gts: DataFrame, min_coverage: float = 0.5) -> DataFrame:
    """Truths covered by more than ``min_coverage`` of themselves, shifted to the window and clipped to it.

    ``windows``: image_id, wx1, wy1, wx2, wy2.
    """
    j = windows.join(gts, "image_id")
    w = box("w")
    j = j.where(coverage(w, box()) > min_coverage)
    return _shifted(j)


def _shifted(j: DataFrame) -> DataFrame:
    out = j
    for a, lo, hi in (("x1", "wx1", "wx2"), ("x2", "wx1", "wx2"), ("y1", "wy1", "wy2"), ("y2", "wy1", "wy2")):
        out = out.withColumn(a, F.least(F.greatest(F.col(a) - F.col(lo), F.lit(0.0)), F.col(hi) - F.col(lo)))
    return out


def crop_boxes_any(windows: DataFrame, gts: DataFrame) -> DataFrame:
    """Shift and clip all truths, keep those that are still boxes."""
    return _shifted(windows.join(gts, "image_id")).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def gts_to_tiles(tiles: DataFrame, gts: DataFrame, patch: tuple[int, int] = (800, 800), min_coverage: float = 0.5) -> DataFrame:
    """Every truth in every tile that covers more than ``min_coverage`` of it (0 at least); they meet in the cell of the tile size that holds the tile's first corner.

    A tile is one row. A truth names the cells where a tile may begin that covers more than ``min_coverage`` of either side of it: two along an axis at 0.5.
    Neither side is broadcast, however small the images or truths that it was made of look to Spark.
    """
    t = tiles.select("image_id", "tile_idx", F.col("x").cast("double").alias("wx1"), F.col("y").cast("double").alias("wy1"))
    t = t.select("*", (F.col("wx1") + patch[0]).alias("wx2"), (F.col("wy1") + patch[1]).alias("wy2"))
    t = t.withColumn("_cx", F.floor(F.col("wx1") / patch[0])).withColumn("_cy", F.floor(F.col("wy1") / patch[1]))
    share = max(min_coverage, 0.0) * (1 - 1e-9)  # the test itself comes after the join

    def begins(lo, hi, n):
        part = (F.col(hi) - F.col(lo)) * share
        first, last = F.floor((F.col(lo) + part - n) / n), F.floor((F.col(hi) - part) / n)
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    g = gts.withColumn("_cx", begins("x1", "x2", patch[0])).withColumn("_cy", begins("y1", "y2", patch[1]))
    j = t.hint("merge").join(g, ["image_id", "_cx", "_cy"]).drop("_cx", "_cy")
    return _shifted(j.where(coverage(box("w"), box()) > min_coverage))


def with_empty_images(images: DataFrame, dets: DataFrame) -> DataFrame:
    return images.join(dets, "image_id", "left")


def semi_images(images: DataFrame, gts: DataFrame) -> DataFrame:
    return images.join(gts, "image_id", "left_semi")


def anti_images(images: DataFrame, gts: DataFrame) -> DataFrame:
    return images.join(gts, "image_id", "left_anti")


def placeable(cands: DataFrame, boxes: DataFrame, iou_max: float = 0.05, cov_max: float = 0.1, cell: float = 128.0) -> DataFrame:
    """Candidates (c_x1..) that touch none of the image's boxes too much; no +1 rule. They meet in grid cells; equal candidates share a verdict."""
    c, b = box("d_"), box("g_")
    mine = cands.select("image_id", *[F.col("c_" + x).alias(x) for x in XY]).distinct()
    p = iou_pairs(mine, boxes.select("image_id", *XY), ["image_id"], cell=cell, offset=0)
    bad = p.where((F.col("iou") > iou_max) | (coverage(c, b) > cov_max) | (coverage(b, c) > cov_max))
    bad = bad.select("image_id", *[F.col("d_" + x).alias("c_" + x) for x in XY]).distinct()
    return cands.join(bad, ["image_id", *["c_" + x for x in XY]], "left_anti").select(*cands.columns)
