"""Tables made from sizes: tile plans, anchors, points, test-time plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_count(size: Column, patch: int, stride: int) -> Column:
    return (F.ceil((size - patch) / F.lit(float(stride))) + 1).cast("long")


def _axis(size: Column, patch: int, stride: int, drop: int | None) -> Column:
    """Array of tile starts along one axis."""
    n = tile_count(size, patch, stride)
    steps = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    right = F.transform(steps, lambda i: F.when(i == n - 1, size - patch).otherwise(i * stride).cast("long"))
    if drop is None:
        return right
    rem, cols = F.pmod(size, F.lit(patch)), F.floor(size / F.lit(float(patch)))
    even = F.when(cols > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(cols, F.lit(1)) - 1), lambda i: (F.floor(rem / F.lit(2.0)) + i * patch).cast("long")))
    return F.when(rem < drop, F.coalesce(even, F.array().cast("array<long>"))).otherwise(right)


def tile_plan(images: DataFrame, patch: tuple[int, int] = (800, 800), stride: tuple[int, int] = (800, 800), drop_pixel: int | None = None) -> DataFrame:
    """(image_id, tile_idx, x, y, short_side): last tiles are right-aligned; with ``drop_pixel`` a small remainder is cut instead."""
    t = images.select("image_id", ((F.col("width") < patch[0]) | (F.col("height") < patch[1])).alias("short_side"), _axis(F.col("width"), patch[0], stride[0], drop_pixel).alias("xs"), _axis(F.col("height"), patch[1], stride[1], drop_pixel).alias("ys"))
    t = t.select("image_id", "short_side", F.size("ys").alias("ny"), "ys", F.posexplode("xs").alias("i", "x"))
    t = t.select("image_id", "short_side", "ny", "i", "x", F.posexplode("ys").alias("j", "y"))
    return t.select("image_id", (F.col("i") * F.col("ny") + F.col("j")).cast("long").alias("tile_idx"), "x", "y", "short_side")


def pack_batches(tiles: DataFrame, batch_size: int) -> DataFrame:
    """Tiles numbered in order over all images and cut into batches; the last one is short, never padded."""
    from boxloom.operators.windows import cum_sum_by_rank

    rows = tiles.withColumn("_one", F.lit(1).cast("long")).withColumn("_all", F.lit(0))
    out = cum_sum_by_rank(rows, ["_all"], [F.col("image_id"), F.col("tile_idx")], {"_n": "_one"})
    n = F.col("_n") - 1
    return out.select(*tiles.columns, F.floor(n / F.lit(float(batch_size))).alias("batch"), (n % batch_size).alias("slot"))


def base_anchors(spark: SparkSession, sizes: Sequence[int], scales: Sequence[float], ratios: Sequence[float], scale_major: bool = True, ctr: float | None = None) -> DataFrame:
    """(level, anchor, x1, y1, x2, y2), rounded half to even. With ``scale_major`` the scale changes fastest."""
    rows = [(lv, float(s), [float(x) for x in scales], [float(r) for r in ratios]) for lv, s in enumerate(sizes)]
    t = spark.createDataFrame(rows, "level int, base double, scales array<double>, ratios array<double>")
    t = t.select("level", "base", "scales", F.size("scales").alias("ns"), F.size("ratios").alias("nr"), F.posexplode("ratios").alias("ri", "ratio"))
    t = t.select("*", F.posexplode("scales").alias("si", "scale"))
    idx = F.col("ri") * F.col("ns") + F.col("si") if scale_major else F.col("si") * F.col("nr") + F.col("ri")
    hr = F.sqrt("ratio")
    w, h = F.col("base") * F.col("scale") / hr, F.col("base") * F.col("scale") * hr
    c = F.lit(float(ctr)) if ctr is not None else (F.col("base") - 1) * 0.5
    return t.select("level", idx.cast("int").alias("anchor"), *[F.bround(e).alias(n) for n, e in (("x1", c - (w - 1) * 0.5), ("y1", c - (h - 1) * 0.5), ("x2", c + (w - 1) * 0.5), ("y2", c + (h - 1) * 0.5))])


def anchor_grid(spark: SparkSession, w: int, h: int, strides=(8, 16, 32, 64, 128), scales=(4.0, 5.0397, 6.3496), ratios=(0.5, 1.0, 2.0)) -> DataFrame:
    """(anchor_idx, level, row, col, anchor, box): cell by cell, anchors of a cell together, levels one after another."""
    base = base_anchors(spark, strides, scales, ratios)
    k, start, levels = len(scales) * len(ratios), 0, []
    for lv, s in enumerate(strides):
        fw, fh = -(-w // s), -(-h // s)
        levels.append((lv, s, fw, fh, start))
        start += fw * fh * k
    lv = spark.createDataFrame(levels, "level int, stride int, fw int, fh int, start long")
    cells = lv.select("*", F.explode(F.sequence(F.lit(0), F.col("fh") - 1)).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.col("fw") - 1)).alias("col"))
    g = cells.join(F.broadcast(base), "level")  # levels x anchors rows
    idx = F.col("start") + (F.col("row") * F.col("fw") + F.col("col")).cast("long") * k + F.col("anchor")
    dx, dy = (F.col("col") * F.col("stride")).cast("double"), (F.col("row") * F.col("stride")).cast("double")
    return g.select(idx.alias("anchor_idx"), "level", "row", "col", "anchor", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"))


#: Sizes in per cent of the first level, by input size and start of the ratio range.
SSD_FIRST = {(300, 15): (7, 15), (300, 20): (10, 20), (512, 10): (4, 10), (512, 15): (7, 15)}


def ssd_anchors(spark: SparkSession, input_size: int, ratio_range: tuple[float, float], strides: Sequence[int], ratios: Sequence[Sequence[int]]) -> DataFrame:
    """(level, anchor, box) of a single-shot detector: a small square, a large one, then the pair of each ratio.

    The share of a level's small square grows evenly over the range; its large square is the geometric mean with the next share.
    """
    lo, hi = (round(r * 100) for r in ratio_range)
    step, first = (hi - lo) // (len(strides) - 2), SSD_FIRST[input_size, lo]
    t = spark.createDataFrame([(lv, float(s), [float(r) for r in rs]) for lv, (s, rs) in enumerate(zip(strides, ratios, strict=True))], "level int, stride double, ratios array<double>")
    share = lambda at, k: F.floor(F.when(F.col("level") == 0, first[k]).otherwise(lo + (F.col("level") + at) * step) * input_size / 100)
    t = t.withColumn("small", share(-1, 0)).withColumn("large", share(0, 1))
    shape = lambda ratio, scale: F.struct(ratio.alias("ratio"), scale.alias("scale"))
    one = F.lit(1.0)
    squares = F.array(shape(one, one), shape(one, F.sqrt(F.col("large") / F.col("small"))))
    pairs = F.flatten(F.transform("ratios", lambda r: F.array(shape(one / r, one), shape(r, one))))
    t = t.select("level", "stride", "small", F.posexplode(F.concat(squares, pairs)).alias("anchor", "s"))
    side = F.col("small") * F.col("s.scale")
    c, w, h = F.col("stride") / 2, side / F.sqrt("s.ratio"), side * F.sqrt("s.ratio")
    return t.select("level", "anchor", *[F.bround(e).alias(n) for n, e in (("x1", c - (w - 1) * 0.5), ("y1", c - (h - 1) * 0.5), ("x2", c + (w - 1) * 0.5), ("y2", c + (h - 1) * 0.5))])


def point_grid(spark: SparkSession, feat_sizes: Sequence[tuple[int, int]], strides: Sequence[int], half_shift: bool = False) -> DataFrame:
    """(point_idx, level, x, y, stride); ``feat_sizes``: (height, width) of each level."""
    rows, start = [], 0
    for lv, ((h, w), s) in enumerate(zip(feat_sizes, strides, strict=True)):
        rows.append((lv, s, w, h, start))
        start += w * h
    t = spark.createDataFrame(rows, "level int, stride int, fw int, fh int, start long")
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("fh") - 1)).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.col("fw") - 1)).alias("c"))
    half = F.floor(F.col("stride") / 2) if half_shift else F.lit(0)
    idx = F.col("start") + F.col("r") * F.col("fw") + F.col("c")
    return t.select(idx.alias("point_idx"), "level", (F.col("c") * F.col("stride") + half).cast("double").alias("x"), (F.col("r") * F.col("stride") + half).cast("double").alias("y"), "stride")


def any_inside(anchors: DataFrame, keys: Sequence[str], flag: str = "inside") -> DataFrame:
    """keys, flag: whether any anchor of a position is inside."""
    return anchors.groupBy(*keys).agg(F.bool_or(flag).alias(flag))


def tta_plan(images: DataFrame, scales: Sequence[tuple[int, int]], flip: bool = False) -> DataFrame:
    """Every image under every test scale, plain and (if asked for) mirrored."""
    plans = F.array(*[F.struct(F.lit(max(s)).alias("long_side"), F.lit(min(s)).alias("short_side"), F.lit(f).alias("flip")) for s in scales for f in ((False, True) if flip else (False,))])
    return images.select("*", F.explode(plans).alias("_p")).select(*images.columns, "_p.*")


#: Corruption groups of the public robustness benchmark.
CORRUPTIONS = {
    "noise": ["gaussian_noise", "shot_noise", "impulse_noise"],
    "blur": ["defocus_blur", "glass_blur", "motion_blur", "zoom_blur"],
    "weather": ["snow", "frost", "fog", "brightness"],
    "digital": ["contrast", "elastic_transform", "pixelate", "jpeg_compression"],
    "holdout": ["speckle_noise", "gaussian_blur", "spatter", "saturate"],
    "None": ["None"],
}
CORRUPTIONS["benchmark"] = [c for g in ("noise", "blur", "weather", "digital") for c in CORRUPTIONS[g]]
CORRUPTIONS["all"] = CORRUPTIONS["benchmark"] + CORRUPTIONS["holdout"]


def corruption_plan(spark: SparkSession, group: str, severities: Sequence[int]) -> DataFrame:
    """(corruption, severity, run): severity 0 is run once and shared by all corruptions."""
    names = CORRUPTIONS.get(group, [group])
    rows = [(c, s, bool(s or i == 0)) for i, c in enumerate(names) for s in severities]
    return spark.createDataFrame(rows, "corruption string, severity int, run boolean")
