"""Counts, curves and averages of precision and recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators import coco
from boxloom.operators.match import IOU_THRS, match_default, match_recall, match_voc
from boxloom.operators.tables import drop, materialise
from boxloom.operators.windows import cum_sum_by_rank, reverse_cummax, running_by_rank

EPS = 2.220446049250313e-16


def num_gts(gts: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    return gts.groupBy(*keys).agg(F.sum(F.when(~F.col("is_ignore"), 1).otherwise(0)).cast("long").alias("n_gts"))


def pr_curve(matched: DataFrame, n_gts: DataFrame, keys: Sequence[str] = ("label",), parts: int | None = None) -> DataFrame:
    """Rows by score with recall and precision so far; two-pass sums split one key's order over tasks."""
    keys = list(keys)
    c = cum_sum_by_rank(matched, keys, [F.desc("score"), F.asc("det_id")], {"ctp": "tp", "cfp": "fp"}, parts)
    c = c.join(n_gts, keys, "left")  # a row per key: Spark broadcasts it while it is small
    n = F.coalesce("n_gts", F.lit(0))
    return c.select(*keys, "det_id", "score", "ctp", "cfp", (F.col("ctp") / F.greatest(n.cast("double"), F.lit(EPS))).alias("recall"), (F.col("ctp") / F.greatest((F.col("ctp") + F.col("cfp")).cast("double"), F.lit(EPS))).alias("precision"))


def average_precision(curve: DataFrame, keys: Sequence[str] = ("label",), mode: str = "area", parts: int | None = None) -> DataFrame:
    """keys, ap: area under the envelope, or the mean over 11 recalls."""
    keys = list(keys)
    if mode == "11points":
        at = curve.groupBy(*keys).agg(*[F.max(F.when(F.col("recall") >= F.lit(i / 10.0), F.col("precision"))).alias(f"p{i}") for i in range(11)])
        return at.select(*keys, (sum(F.coalesce(f"p{i}", F.lit(0.0)) for i in range(11)) / 11.0).alias("ap"))
    # rows of equal recall share its step: the envelope there is that of the first of them, their best precision
    steps = curve.groupBy(*keys, "recall").agg(F.max("precision").alias("precision"))
    env = reverse_cummax(steps, keys, [F.desc("recall")], {"env": "precision"}, parts)
    # sum of (recall - recall before) * env, with the terms of each recall put together: recall * (env here - env of the next)
    nxt = running_by_rank(env, keys, [F.desc("recall")], lags={"env_after": "env"}, parts=parts)
    return nxt.groupBy(*keys).agg(F.sum(F.col("recall") * (F.col("env") - F.coalesce("env_after", F.lit(0.0)))).alias("ap"))


def map_report(dets: DataFrame, gts: DataFrame, iou_thr: float = 0.5, mode: str = "area") -> DataFrame:
    """label, n_gts, n_dets, recall, precision, ap per label, and a last row (null label) with the mean AP."""
    m = match_default(dets, gts, iou_thr)
    n = num_gts(gts)
    curve = pr_curve(m, n)
    last = curve.groupBy("label").agg(F.count("*").alias("n_dets"), F.max("recall").alias("recall"), F.min_by("precision", F.struct("score", -F.col("det_id"))).alias("precision"))
    t = n.join(last, "label", "left").join(average_precision(curve, mode=mode), "label", "left")
    t = t.select("label", "n_gts", F.coalesce("n_dets", F.lit(0)).alias("n_dets"), F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("ap", F.lit(0.0)).alias("ap"))
    g = t.groupingSets([["label"], []], "label").agg(F.sum("n_gts").alias("n_gts"), F.sum("n_dets").alias("n_dets"), F.max("recall").alias("recall"), F.max("precision").alias("precision"), F.avg(F.when(F.col("n_gts") > 0, F.col("ap"))).alias("ap"), F.grouping_id().alias("gid"))
    only = lambda c: F.when(F.col("gid") == 0, F.col(c)).alias(c)
    return g.select("label", "n_gts", "n_dets", only("recall"), only("precision"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def range_report(dets: DataFrame, gts: DataFrame, ranges: Sequence[tuple[float, float]], iou_thr: float = 0.5, mode: str = "area") -> DataFrame:
    """As :func:`map_report` for each range of areas: range_idx, label, n_gts, n_dets, recall, precision, ap; n_dets counts all detections of a label."""
    keys = ["range_idx", "label"]
    n = _range_gts(gts, ranges)
    curve = pr_curve(match_default(dets, gts, iou_thr, ranges), n, keys)
    last = curve.groupBy(*keys).agg(F.count("*").alias("n_dets"), F.max("recall").alias("recall"), F.min_by("precision", F.struct("score", -F.col("det_id"))).alias("precision"))
    t = n.join(last, keys, "left").join(average_precision(curve, keys, mode), keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    t = t.select(*keys, "n_gts", F.coalesce("n_dets", F.lit(0)).alias("n_dets"), zero("recall"), zero("precision"), zero("ap"))
    mean = t.groupBy("range_idx").agg(F.sum("n_gts").alias("n_gts"), F.sum("n_dets").alias("n_dets"), F.coalesce(F.avg(F.when(F.col("n_gts") > 0, F.col("ap"))), F.lit(0.0)).alias("ap"))
    return t.unionByName(mean, allowMissingColumns=True)


def _range_gts(gts: DataFrame, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """(range_idx, label, n_gts): truths of each range that count."""
    g = gts.withColumn("_a", (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1))
    rs = F.array(*[F.struct(F.lit(i).alias("range_idx"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for i, (a, b) in enumerate(ranges)])
    g = g.withColumn("_r", F.explode(rs)).select("label", "_r.range_idx", (F.col("is_ignore") | (F.col("_a") < F.col("_r.lo")) | (F.col("_a") >= F.col("_r.hi"))).alias("is_ignore"))
    return num_gts(g, ["range_idx", "label"])


def eval_map(dets: DataFrame, gts: DataFrame, iou_thr: float = 0.5, scale_ranges: Sequence[tuple[float, float]] | None = None, mode: str = "area") -> DataFrame:
    """range_idx, map: the mean AP over labels with truths, per size range (bounds are squared)."""
    ranges = [(a * a, b * b) for a, b in scale_ranges] if scale_ranges else [(0.0, 1e10)]
    m = match_default(dets, gts, iou_thr, ranges)
    n = _range_gts(gts, ranges)
    ap = average_precision(pr_curve(m, n, ["range_idx", "label"]), ["range_idx", "label"], mode)
    t = n.join(ap, ["range_idx", "label"], "left").where("n_gts > 0")
    return t.groupBy("range_idx").agg(F.avg(F.coalesce("ap", F.lit(0.0))).alias("map"))


def voc_ap(dets: DataFrame, gts: DataFrame, thr: float = 0.5, mode: str = "area") -> DataFrame:
    """label, ap under strict matching."""
    return average_precision(pr_curve(match_voc(dets, gts, thr), num_gts(gts)), mode=mode)


def eval_recalls(gts: DataFrame, props: DataFrame, proposal_nums: Sequence[int] = (100, 300, 1000), iou_thrs: Sequence[float] = IOU_THRS) -> DataFrame:
    """num, thr, recall; and thr null: the mean over the thresholds."""
    m = match_recall(gts.where("NOT is_ignore AND NOT is_crowd"), props, proposal_nums)
    t = m.select("num", F.explode(F.array(*[F.lit(float(t)) for t in iou_thrs])).alias("thr"), "iou")
    r = t.groupBy("num", "thr").agg(F.avg((F.col("iou") >= F.col("thr")).cast("double")).alias("recall"))
    return r.unionByName(r.groupBy("num").agg(F.avg("recall").alias("recall")).withColumn("thr", F.lit(None).cast("double")))


def coco_metrics(dets: DataFrame, gts: DataFrame, use_cats: bool = True, max_dets: Sequence[int] | None = None) -> DataFrame:
    """metric, value: the twelve numbers. Without categories (proposals) maxDets are 100, 300, 1000."""
    md = list(max_dets or ((1, 10, 100) if use_cats else (100, 300, 1000)))
    if not use_cats:
        dets, gts = dets.withColumn("label", F.lit(1)), gts.withColumn("label", F.lit(1))
    combos, last = coco.combinations(), md[-1]
    bits, n = materialise(coco.match_bits(dets, gts, combos, max(md))), materialise(coco.truths(gts))
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c.area).alias("area"), F.lit(c.thr).alias("thr")) for k, c in enumerate(combos)])
    named = lambda t: t.select("*", F.element_at(names, F.col("k") + 1).alias("c")).select("*", "c.area", "c.thr")
    ap = named(coco.precisions(bits, n, combos)).select("area", "thr", F.lit(last).alias("max_det"), "ap", F.lit(None).cast("double").alias("recall"))
    ar = named(coco.recalls(bits, n, combos, md)).select("area", "thr", "max_det", F.lit(None).cast("double").alias("ap"), "recall")
    sel = {"AP": ("ap", "all", None, last), "AP50": ("ap", "all", 0.5, last), "AP75": ("ap", "all", 0.75, last), "APs": ("ap", "small", None, last), "APm": ("ap", "medium", None, last), "APl": ("ap", "large", None, last)}
    sel |= {f"AR{k}": ("recall", "all", None, k) for k in md} | {f"AR{a[0]}": ("recall", a, None, last) for a in ("small", "medium", "large")}
    aggs = []
    for name, (col, area, thr, k) in sel.items():
        ok = (F.col("area") == area) & (F.col("max_det") == k)
        aggs.append(F.coalesce(F.avg(F.when(ok & (F.col("thr") == thr) if thr else ok, F.col(col))), F.lit(-1.0)).alias(name))
    one = materialise(ap.unionByName(ar).agg(*aggs))
    drop(bits)
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in sel])).alias("x")).select("x.*")


def coco_classwise(dets: DataFrame, gts: DataFrame) -> DataFrame:
    """label, ap100: per cent; null for labels without countable truths."""
    combos = [c for c in coco.combinations() if c.area == "all"]
    full = coco.precisions(coco.match_bits(dets, gts, combos), coco.truths(gts), combos)
    ap = full.groupBy("label").agg((F.avg("ap") * 100).alias("ap100"))
    return gts.select("label").union(dets.select("label")).distinct().join(ap, "label", "left")


def topk_accuracy(df: DataFrame, k: Sequence[int] = (1,), scores: str = "scores", label: str = "label") -> DataFrame:
    """k, accuracy in per cent: the label's score is among the k greatest (smaller positions win ties)."""
    s = F.col(scores)
    own = F.element_at(s, F.col(label) + 1)
    better = F.size(F.filter(F.transform(s, lambda v, i: (v > own) | ((v == own) & (i < F.col(label)))), lambda x: x))
    one = df.agg(*[F.avg((better < n).cast("double") * 100).alias(f"k{n}") for n in k])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"k{n}").alias("accuracy")) for n in k])).alias("x")).select("x.*")


def dataset_stats(images: DataFrame, gts: DataFrame) -> DataFrame:
    """cube of label and aspect flag: boxes and images."""
    from boxloom.functions.geometry import aspect_flag

    t = gts.join(images.select("image_id", aspect_flag(F.col("width"), F.col("height")).alias("flag")), "image_id")
    return t.cube("label", "flag").agg(F.count("*").alias("boxes"), F.countDistinct("image_id").alias("images"), F.grouping_id().alias("gid"))
