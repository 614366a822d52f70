"""Targets of guided anchoring: where on the feature maps a truth is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import Box, box, calc_region

XY = ["x1", "y1", "x2", "y2"]


def location_targets(
    gts: DataFrame, feat_sizes: Sequence[tuple[int, int]], anchor_scale: int = 4, strides: Sequence[int] = (8, 16, 32, 64, 128), center_ratio: float = 0.2, ignore_ratio: float = 0.5
) -> DataFrame:
    """(image_id, level, row, col, target, weight) of every grid cell that a truth touches; all others are (0, 0.1).

    A truth belongs to the level of its size. There its centre region is 1 with weight 1, the ring around it weighs 0; the same region
    on the levels next to it weighs 0 unless a truth of that level says otherwise. Truths write one after the other by gt_id: the last
    one on a cell sets its weight, so a later ring takes the weight of an earlier centre, whose target stays 1. As rows: a truth
    names its cells, and a cell takes the greatest target and the weight of its last writer. ``feat_sizes``: (height, width) of each level.
    """
    n = len(strides)
    levels = F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for s, (h, w) in zip(strides, feat_sizes, strict=True)])
    size = F.sqrt((F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1))
    own = F.least(F.greatest(F.floor(F.log2(size) - F.log2(F.lit(float(anchor_scale * strides[0]))) + 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
    t = gts.select("image_id", "gt_id", *XY, own.alias("own")).withColumn("level", F.explode(F.sequence(F.greatest(F.col("own") - 1, F.lit(0)), F.least(F.col("own") + 1, F.lit(n - 1)))))
    t = t.withColumn("v", F.element_at(levels, F.col("level") + 1))
    scaled = Box(*[c / F.col("v.s") for c in box()])
    ring = calc_region(scaled, (1 - ignore_ratio) / 2, F.col("v.w"), F.col("v.h"))
    centre = calc_region(scaled, (1 - center_ratio) / 2, F.col("v.w"), F.col("v.h"))
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int")))
    # the centre may stick out of the ring where both are one cell: cells of either
    x, y = span(F.least(ring.x1, centre.x1), F.greatest(ring.x2, centre.x2)), span(F.least(ring.y1, centre.y1), F.greatest(ring.y2, centre.y2))
    fields = [*[c.alias(f"r{n}") for c, n in zip(ring, XY, strict=True)], *[c.alias(f"c{n}") for c, n in zip(centre, XY, strict=True)]]
    t = t.select("image_id", "gt_id", "own", "level", *fields, x.alias("xs"), F.explode(y).alias("row"))
    t = t.select("*", F.explode("xs").alias("col"))
    within = lambda p: (F.col("col") >= F.col(f"{p}x1")) & (F.col("col") <= F.col(f"{p}x2")) & (F.col("row") >= F.col(f"{p}y1")) & (F.col("row") <= F.col(f"{p}y2"))
    mine = F.col("own") == F.col("level")
    t = t.select("image_id", "level", "row", "col", "gt_id", mine.alias("mine"), (mine & within("c")).cast("int").alias("hit"), within("r").alias("ring"))
    t = t.where("hit = 1 OR ring")
    cell = t.groupBy("image_id", "level", "row", "col").agg(F.max("hit").alias("target"), F.max_by("hit", F.when(F.col("mine"), F.col("gt_id"))).alias("weight"))
    return cell.select("image_id", "level", "row", "col", "target", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))


def location_factor(feat_sizes: Sequence[tuple[int, int]], images: int) -> float:
    """What the loss is divided by: cells of all levels and images, over 200."""
    return images * sum(h * w for h, w in feat_sizes) / 200
