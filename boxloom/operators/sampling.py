"""Sampling, dataset wrappers and batches. Choices come from hashes of ids, never from a generator's state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lcg(seed: int, c: Column) -> Column:
    """An integer draw that any SQL engine can repeat."""
    return (c * F.lit(7919) + F.lit(seed * 104729)) % F.lit(1_000_003)


def concat(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [d.withColumn("source_idx", F.lit(i)) for i, d in enumerate(dfs)])


def repeat(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("repeat_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def add_gt_as_proposals(props: DataFrame, gts: DataFrame) -> DataFrame:
    """Truths in front of the proposals, flagged, with IoU 1."""
    cols = ["image_id", "box_id", "x1", "y1", "x2", "y2"]
    g = gts.select("image_id", F.col("gt_id").alias("box_id"), *cols[2:], F.lit(True).alias("is_gt"), F.col("gt_id"), F.lit(1.0).alias("max_iou"))
    p = props.select(*cols, F.lit(False).alias("is_gt"), F.lit(None).cast("long").alias("gt_id"), F.lit(None).cast("double").alias("max_iou"))
    return g.unionByName(p)


def sample_random(assigned: DataFrame, num: int, pos_fraction: float, neg_pos_ub: float = -1, seed: int = 0) -> DataFrame:
    """Positives up to ``num * pos_fraction``, the rest negatives, at most ``neg_pos_ub`` times the positives."""
    t = assigned.where("assigned >= 0")
    w = Window.partitionBy("image_id", "assigned").orderBy(lcg(seed, F.col("box_id")), "box_id")
    t = t.withColumn("_rn", F.row_number().over(w)).withColumn("_npos", F.sum((F.col("assigned") == 1).cast("int")).over(Window.partitionBy("image_id")))
    pos = F.least(F.col("_npos"), F.lit(int(num * pos_fraction)))
    neg = F.lit(num) - pos
    if neg_pos_ub >= 0:
        neg = F.least(neg, F.floor(F.lit(float(neg_pos_ub)) * F.greatest(pos, F.lit(1))))
    return t.where(F.when(F.col("assigned") == 1, F.col("_rn") <= pos).otherwise(F.col("_rn") <= neg)).drop("_rn", "_npos")


def sample_instance_balanced(assigned: DataFrame, num: int, seed: int = 0) -> DataFrame:
    """Positives: round(num / truths) + 1 of each truth, topped up at random, cut to ``num``."""
    p = assigned.where("assigned = 1")
    r = lcg(seed, F.col("box_id"))
    p = p.withColumn("_g", F.row_number().over(Window.partitionBy("image_id", "gt_id").orderBy(r, "box_id")))
    n = F.size(F.collect_set("gt_id").over(Window.partitionBy("image_id")))
    p = p.withColumn("_late", (F.col("_g") > F.bround(F.lit(float(num)) / n) + 1).cast("int"))
    p = p.withColumn("_rn", F.row_number().over(Window.partitionBy("image_id").orderBy("_late", r, "box_id")))
    return p.where(F.col("_rn") <= num).drop("_g", "_late", "_rn")


def sample_iou_balanced_neg(assigned: DataFrame, num: int, num_bins: int = 3, seed: int = 0) -> DataFrame:
    """Negatives in equal parts from equal bins of max_iou, topped up at random."""
    t = assigned.where("assigned = 0")
    own = Window.partitionBy("image_id")
    top = F.max("max_iou").over(own)
    t = t.withColumn("_bin", F.when(top > 0, F.least(F.floor(F.col("max_iou") / top * num_bins), F.lit(num_bins - 1))).otherwise(F.lit(0)))
    r = lcg(seed, F.col("box_id"))
    t = t.withColumn("_b", F.row_number().over(Window.partitionBy("image_id", "_bin").orderBy(r, "box_id")))
    t = t.withColumn("_late", (F.col("_b") > num // num_bins).cast("int"))
    t = t.withColumn("_rn", F.row_number().over(Window.partitionBy("image_id").orderBy("_late", r, "box_id")))
    return t.where(F.col("_rn") <= num).drop("_bin", "_b", "_late", "_rn")


def sample_floor_balanced_neg(assigned: DataFrame, num: int, num_bins: int = 3, floor_thr: float = 0.0, floor_fraction: float = 0.0, seed: int = 0) -> DataFrame:
    """``num`` negatives of each image: up to ``floor_fraction`` of them with a max_iou below ``floor_thr`` (0: that overlap nothing; negative: no such set),
    the others in equal parts from ``num_bins`` equal bins up to the image's greatest max_iou, and what is short of either at random.

    The greatest max_iou is that of all boxes of the image; one that equals it lies in no bin and comes in at random only.
    """
    t = assigned.withColumn("_top", F.max("max_iou").over(Window.partitionBy("image_id"))).where("assigned = 0")
    low = F.lit(False) if floor_thr < 0 else F.col("max_iou") == 0 if floor_thr == 0 else F.col("max_iou") < floor_thr
    n_iou, base = int(num * (1 - floor_fraction)), max(floor_thr, 0.0)
    t = t.withColumn("_low", low.cast("int")).withColumn("_r", lcg(seed, F.col("box_id")))
    step = (F.col("_top") - base) / num_bins
    at = F.when(step > 0, F.floor((F.col("max_iou") - base) / step))
    t = t.withColumn("_bin", F.when((at >= 0) & (at < num_bins), at))
    w = lambda *keys: Window.partitionBy("image_id", *keys)
    t = t.withColumn("_k", F.row_number().over(w("_low", "_bin").orderBy("_r", "box_id")))
    t = t.withColumn("_late", (F.col("_bin").isNull() | (F.col("_k") > n_iou // num_bins)).cast("int") if num_bins >= 2 else F.lit(0))
    t = t.withColumn("_rank", F.row_number().over(w("_low").orderBy(F.when(F.col("_low") == 0, F.col("_late")).otherwise(0), "_r", "box_id")))
    n_high = F.sum(1 - F.col("_low")).over(w())
    room = F.when(F.col("_low") == 0, F.lit(n_iou)).otherwise(F.lit(num) - F.least(n_high, F.lit(n_iou)))
    t = t.withColumn("_out", (F.col("_rank") > room).cast("int"))
    t = t.withColumn("_rn", F.row_number().over(w().orderBy("_out", "_r", "box_id")))
    return t.where(F.col("_rn") <= num).select(*assigned.columns)


def interleave(parts: Sequence[DataFrame], size: int, order: str) -> DataFrame:
    """Results of several ranks put together in turn (first of each rank, second of each ...), cut to ``size`` rows: position, rank."""
    from boxloom.operators.windows import cum_sum_by_rank

    t = reduce(lambda a, b: a.unionByName(b), [p.withColumn("rank", F.lit(i)) for i, p in enumerate(parts)]).withColumn("_one", F.lit(1).cast("long"))
    t = cum_sum_by_rank(t, ["rank"], [F.col(order)], {"_n": "_one"})
    return t.withColumn("position", (F.col("_n") - 1) * len(parts) + F.col("rank")).where(F.col("position") < size).drop("_one", "_n")


def flag_ignores(gts: DataFrame, ignores: DataFrame) -> DataFrame:
    """Truths and ignore regions as one table with gt_ignore 0 or 1."""
    return gts.withColumn("gt_ignore", F.lit(0)).unionByName(ignores.withColumn("gt_ignore", F.lit(1)))


def pipeline(*steps):
    """One step from several: each takes and returns a DataFrame and may drop rows."""
    return lambda df: reduce(lambda d, step: d.transform(step), steps, df)


def sample_combined(pos: DataFrame, neg: DataFrame) -> DataFrame:
    return pos.unionByName(neg)


def hard_examples(df: DataFrame, n: int, loss: str = "loss") -> DataFrame:
    """The n rows of the greatest loss among the positives and among the negatives of each image."""
    w = Window.partitionBy("image_id", "assigned").orderBy(F.desc(loss), F.asc("box_id"))
    return df.where("assigned >= 0").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def hard_negatives(df: DataFrame, ratio: float, loss: str = "loss") -> DataFrame:
    """All positives, and the hardest min(ratio * positives, negatives) negatives of each image."""
    npos = F.sum((F.col("assigned") == 1).cast("int")).over(Window.partitionBy("image_id"))
    w = Window.partitionBy("image_id", "assigned").orderBy(F.desc(loss), F.asc("box_id"))
    t = df.where("assigned >= 0").withColumn("_n", npos).withColumn("_rn", F.row_number().over(w))
    return t.where((F.col("assigned") == 1) | (F.col("_rn") <= F.col("_n") * ratio)).drop("_n", "_rn")


def epoch_shards(images: DataFrame, batch: int, replicas: int, epoch: int, flag: str | None = "flag") -> DataFrame:
    """(image, position, shard): each group in the epoch's hash order, padded by wrapping to a multiple of batch * replicas,
    then cut into one run per replica. A group's order is numbered in two passes, so it need not fit a task."""
    from boxloom.operators.windows import cum_sum_by_rank

    keys = [flag] if flag else ["_all"]
    t = images if flag else images.withColumn("_all", F.lit(0))
    t = t.withColumn("_one", F.lit(1).cast("long"))
    n = t.groupBy(*keys).agg(F.count("*").alias("_n"))
    t = cum_sum_by_rank(t, keys, [lcg(epoch, F.col("image_id")), F.col("image_id")], {"_i": "_one"}).join(F.broadcast(n), keys)
    step = batch * replicas
    total = (F.ceil(F.col("_n") / F.lit(float(step))) * step).cast("long")
    i = F.col("_i") - 1
    # a row stands at i, i + n, i + 2n ... below the padded total
    pos = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((total - 1 - i) / F.col("_n"))), lambda k: i + k * F.col("_n")))
    t = t.select(*images.columns, total.alias("_total"), pos.alias("position"))
    return t.withColumn("shard", F.floor(F.col("position") / (F.col("_total") / replicas)).cast("int")).drop("_total")


def group_batches(images: DataFrame, batch: int, seed: int = 0, flag: str = "flag") -> DataFrame:
    """Batches within a flag group, batch order by hash: (image, flag, batch_key)."""
    t = epoch_shards(images, batch, 1, seed, flag)
    b = F.floor(F.col("position") / F.lit(float(batch)))
    return t.withColumn("batch", b).withColumn("batch_key", lcg(seed, b * 2 + F.col(flag))).drop("shard")


def replacement(dropped: DataFrame, images: DataFrame, seed: int = 0, flag: str = "flag") -> DataFrame:
    """For each dropped image another one of its flag group: the first whose hash is above the dropped one's, else the group's first; null in a group without any.

    Dropped and kept images stand in one order by hash, worked off from its end in two passes over range partitions: the kept image seen last is the
    one of the least (hash, id) so far. So one group spans many tasks.
    """
    from boxloom.operators.windows import running_by_rank

    kept = images.join(dropped.select("image_id"), "image_id", "left_anti").select(flag, lcg(seed, F.col("image_id")).alias("k"), F.lit(0).alias("ask"), "image_id")
    asks = dropped.select(flag, lcg(seed + 1, F.col("image_id")).alias("k"), F.lit(1).alias("ask"), "image_id")
    back = F.struct((-F.col("k")).alias("k"), (-F.col("image_id")).alias("image_id"))
    both = kept.unionByName(asks).withColumn("seen", F.when(F.col("ask") == 0, back))
    out = running_by_rank(both, [flag], [F.desc("k"), F.desc("ask"), F.desc("image_id")], maxes={"next": "seen"}).where("ask = 1")
    first = kept.groupBy(flag).agg(F.min(F.struct("k", "image_id"))["image_id"].alias("first"))  # a row per flag
    return out.join(first, flag, "left").select("image_id", flag, F.coalesce(-F.col("next.image_id"), F.col("first")).alias("replacement"))


def choose_crops(images: DataFrame, gts: DataFrame, crop: tuple[int, int], seed: int = 0) -> DataFrame:
    """(image_id, gt_id, wx1, wy1, wx2, wy2): a window per image around a truth drawn by hash."""
    g = gts.withColumn("_r", lcg(seed, F.col("gt_id"))).groupBy("image_id").agg(F.min_by(F.struct("gt_id", "x1", "y1", "x2", "y2"), F.struct("_r", "gt_id")).alias("g"))
    j = images.join(g, "image_id")

    def start(lo, hi, size, p, k):
        a = F.greatest(F.col(hi) - p, F.lit(0.0))
        b = F.greatest(F.least(F.col(lo) + 1, F.col(size) - p + 1), a + 1)
        return F.floor(a + lcg(seed + k, F.col("image_id")) / F.lit(1_000_003.0) * (b - a)).cast("double")

    j = j.withColumn("wx1", start("g.x1", "g.x2", "width", crop[0], 1)).withColumn("wy1", start("g.y1", "g.y2", "height", crop[1], 2))
    return j.select("image_id", "g.gt_id", "wx1", "wy1", (F.col("wx1") + crop[0]).alias("wx2"), (F.col("wy1") + crop[1]).alias("wy2"))
