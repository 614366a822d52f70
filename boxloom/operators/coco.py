"""Evaluation by the public COCO protocol, many thresholds, size ranges and views of the truths at once.

A combination is (view, IoU threshold, size range). One pass over an image's detections of a label works all combinations out together; what
it says about a detection are two 64-bit numbers, a bit per combination: counted as right, counted as wrong. A detection is thus one row in
the sweep by score, not one per combination.

Views of the truths, seen from a label: ``own`` (its truths), ``super`` (other labels of its supercategory as well, ignored like crowds), ``any``
(all other labels, ignored like crowds).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.operators import kernels
from boxloom.operators.groups import per_group
from boxloom.operators.match import AREAS, IOU_THRS
from boxloom.operators.tables import drop, materialise

XY = ["x1", "y1", "x2", "y2"]
VIEWS = ("own", "super", "any")


class Combination(NamedTuple):
    view: str
    thr: float
    area: str


def combinations(thrs: Sequence[float] = IOU_THRS, views: Sequence[str] = ("own",)) -> list[Combination]:
    return [Combination(v, t, a) for v in views for t in thrs for a in AREAS]


def _flag(t: DataFrame, c: str):
    return F.coalesce(c, F.lit(False)).alias(c) if c in t.columns else F.lit(False).alias(c)


def match_bits(dets: DataFrame, gts: DataFrame, combos: Sequence[Combination], max_det: int = 100, cats: DataFrame | None = None) -> DataFrame:
    """image_id, label, det_id, score, rank, right, wrong: bit k says what combination k counts the detection as.

    ``cats`` (label, supercategory) is needed for the views of other labels: there a truth joins every label that its image has
    detections of. Detections are cut to the best ``max_det`` of an image and label.
    """
    if len(combos) > 62:
        raise ValueError("at most 62 combinations at once")
    d = dets.select("image_id", F.col("label").cast("long").alias("label"), F.lit(0).alias("kind"), F.col("det_id").alias("id"), F.col("score").cast("double").alias("score"), F.lit(0).alias("view"), F.lit(False).alias("is_ignore"), F.lit(False).alias("is_crowd"), *XY)
    g = gts.select("image_id", F.col("label").cast("long").alias("label"), F.col("gt_id").alias("id"), _flag(gts, "is_ignore"), _flag(gts, "is_crowd"), *XY)
    g = g.withColumn("view", F.lit(0))
    if any(c.view != "own" for c in combos):
        sup = cats.select(F.col("label").cast("long").alias("label"), F.col("supercategory").alias("sup"))  # a row per label
        seen = d.select("image_id", "label").distinct().join(F.broadcast(sup), "label", "left")
        other = g.withColumnRenamed("label", "_own").join(F.broadcast(sup.select(F.col("label").alias("_own"), F.col("sup").alias("_sup"))), "_own", "left")
        other = seen.join(other, "image_id").where("label <> _own").withColumn("view", F.when(F.col("sup") == F.col("_sup"), 1).otherwise(2))
        g = g.unionByName(other.select(*g.columns))
    both = d.unionByName(g.select("image_id", "label", F.lit(1).alias("kind"), "id", F.lit(0.0).alias("score"), "view", "is_ignore", "is_crowd", *XY))
    reach = np.array([VIEWS.index(c.view) for c in combos])
    need = np.array([min(c.thr, 1 - 1e-10) for c in combos])
    lo, hi = (np.array([AREAS[c.area][k] for c in combos])[:, None] for k in (0, 1))
    bits = 1 << np.arange(len(combos), dtype=np.int64)

    def run(x):
        n = int(np.searchsorted(x["kind"], 1))
        m = min(n, max_det)
        if not m:
            return None
        b = np.stack([x[c] for c in XY], 1).astype(float)
        det, t, view = b[:m], b[n:], x["view"][n:]
        own = view == 0
        crowd = x["is_crowd"][n:].astype(bool) | ~own
        base = x["is_ignore"][n:].astype(bool) | crowd
        size = lambda q: ((q[:, 2] - q[:, 0]) * (q[:, 3] - q[:, 1]))[None, :]
        ignored = base | (size(t) < lo) | (size(t) > hi)
        off = (size(det) < lo) | (size(det) > hi)
        got = kernels.match_coco_all(kernels.coco_overlaps(det, t, crowd), view[None, :] <= reach[:, None], ignored, crowd, need)
        hit = got >= 0
        skip = np.where(hit, np.take_along_axis(ignored, np.maximum(got, 0), 1), off) if len(t) else off
        pack = lambda f: (f * bits[:, None]).sum(0)
        return [x["image_id"][:m], x["label"][:m], x["id"][:m], x["score"][:m], np.arange(m), pack(hit & ~skip), pack(~hit & ~skip)]

    order = [F.asc("kind"), F.desc("score"), F.asc("id")]
    return per_group(both, ["image_id", "label"], order, run, "image_id long, label long, det_id long, score double, rank int, right long, wrong long")


def truths(gts: DataFrame) -> DataFrame:
    """(label, area, n_gts): countable truths by size range."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    ranges = F.array(*[F.struct(F.lit(k).alias("area"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in AREAS.items()])
    none = F.lit(False)
    g = gts.where(~F.coalesce(F.col("is_ignore") if "is_ignore" in gts.columns else none, none) & ~F.coalesce(F.col("is_crowd") if "is_crowd" in gts.columns else none, none))
    g = g.select(F.col("label").cast("long").alias("label"), size.alias("a"), F.explode(ranges).alias("r")).where((F.col("a") >= F.col("r.lo")) & (F.col("a") <= F.col("r.hi")))
    return g.groupBy("label", "r.area").agg(F.count(F.lit(1)).alias("n_gts"))


def _each(combos: Sequence[Combination], *cols):
    """A struct per combination with its number and ``cols(k)``, exploded."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c.area).alias("area"), *[f(k).alias(n) for n, f in cols]) for k, c in enumerate(combos)])).alias("c")


def recalls(bits: DataFrame, n_gts: DataFrame, combos: Sequence[Combination], max_dets: Sequence[int]) -> DataFrame:
    """label, k, max_det, recall of every label with countable truths."""
    sums = [F.sum(F.when(F.col("rank") < m, F.shiftright("right", k).bitwiseAND(F.lit(1))).otherwise(0)).alias(f"h{m}_{k}") for m in max_dets for k in range(len(combos))]
    hits = bits.groupBy("label").agg(*sums)
    one = [hits.select("label", F.lit(m).alias("max_det"), _each(combos, ("hits", lambda k, m=m: F.col(f"h{m}_{k}")))).select("label", "max_det", "c.*") for m in max_dets]
    got = one[0]
    for t in one[1:]:
        got = got.unionByName(t)
    grid = n_gts.select("label", "area", "n_gts", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c.area).alias("a")) for k, c in enumerate(combos)])).alias("c"))
    grid = grid.where("area = c.a").select("label", "c.k", "n_gts", F.explode(F.array(*[F.lit(m) for m in max_dets])).alias("max_det"))
    return grid.join(got.drop("area"), ["label", "k", "max_det"], "left").select("label", "k", "max_det", (F.coalesce("hits", F.lit(0)) / F.col("n_gts")).alias("recall"))


def precisions(bits: DataFrame, n_gts: DataFrame, combos: Sequence[Combination]) -> DataFrame:
    """label, k, ap, reached: the mean precision over the 101 recall points, and the share of points with a precision above 0.

    The rows are cut into ranges of (label, score), so that one label spans many tasks. What the ranges before come to is one row of
    sums per label and range; ranges are in order, so there are at most as many as partitions and labels together, and they may be broadcast.
    """
    spark, n = bits.sparkSession, len(combos)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = bits.where("right <> 0 OR wrong <> 0").select("label", "score", "det_id", "right", "wrong")
    rows = materialise(rows.repartitionByRange(parts, F.col("label"), F.desc("score"), F.col("det_id")).withColumn("part", F.spark_partition_id()))
    one = lambda c, k: F.sum(F.shiftright(c, k).bitwiseAND(F.lit(1)))
    totals = rows.groupBy("label", "part").agg(F.array(*[one(c, k) for c in ("right", "wrong") for k in range(n)]).alias("sums"))
    before: dict[tuple[int, int], np.ndarray] = {}
    at: dict[int, np.ndarray] = {}
    for r in sorted(totals.collect()):
        so_far = at.get(r["label"], np.zeros(2 * n, np.int64))
        before[r["label"], r["part"]] = so_far
        at[r["label"]] = so_far + np.array(r["sums"], np.int64)
    areas = [c.area for c in combos]
    known: dict[tuple[int, str], int] = {(r["label"], r["area"]): r["n_gts"] for r in n_gts.collect()}  # a row per label and range of sizes
    shared = spark.sparkContext.broadcast((before, known))

    def run(x):
        before, known = shared.value
        label, part = int(x["label"][0]), int(x["part"][0])
        n_gt = np.array([known.get((label, a), 0) for a in areas])
        start = before[label, part]
        best = np.zeros((n, 101))
        for i in range(0, len(x["label"]), 8192):
            right, wrong = (((x[c][i : i + 8192, None] >> np.arange(n)) & 1) for c in ("right", "wrong"))
            tp, fp = start[:n] + right.cumsum(0), start[n:] + wrong.cumsum(0)
            start = np.concatenate([tp[-1], fp[-1]])
            row, k = np.nonzero(right & (n_gt > 0))
            point = np.floor(tp[row, k] * 100 / n_gt[k] + 1e-9).astype(int)
            np.maximum.at(best, (k, np.minimum(point, 100)), tp[row, k] / (tp[row, k] + fp[row, k]))
        k, point = np.nonzero(best)
        return [np.full(len(k), label), k, point, best[k, point]]

    got = per_group(rows, ["label", "part"], [F.desc("score"), F.asc("det_id")], run, "label long, k int, point int, pr double")
    best = got.groupBy("label", "k", "point").agg(F.max("pr").alias("pr"))
    down = Window.partitionBy("label", "k").orderBy(F.desc("point"))  # at most 101 rows
    best = best.select("label", "k", "point", F.max("pr").over(down).alias("env"), F.lead("point", 1, -1).over(down).alias("below"))
    ap = best.groupBy("label", "k").agg((F.sum(F.col("env") * (F.col("point") - F.col("below"))) / 101.0).alias("ap"), ((F.max("point") + 1) / 101.0).alias("reached"))
    grid = n_gts.select("label", "area", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a")) for k, a in enumerate(areas)])).alias("c")).where("area = c.a")
    out = materialise(grid.select("label", "c.k").join(ap, ["label", "k"], "left").select("label", "k", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("reached", F.lit(0.0)).alias("reached")))
    drop(rows)
    return out


#: The rows of an error breakdown.
TYPES = ("C75", "C50", "Loc", "Sim", "Oth", "BG", "FN")


def coco_error_breakdown(dets: DataFrame, gts: DataFrame, cats: DataFrame) -> DataFrame:
    """label, area, type, value: mean precision of every category as one kind of error after the other is forgiven.

    C75 and C50 are plain; Loc takes IoU 0.1; Sim ignores confusion within the supercategory and Oth any confusion, at IoU 0.1; BG
    removes what is left on the background (a recall point that is reached counts 1); FN is 1. A null label is the mean over
    all categories. ``cats``: label, supercategory, a row per category; one without countable truths has zeros before FN.
    """
    combos = [Combination(*c, a) for a in AREAS for c in (("own", 0.75), ("own", 0.5), ("own", 0.1), ("super", 0.1), ("any", 0.1))]
    labels = cats.select(F.col("label").cast("long").alias("label"))
    bits = materialise(match_bits(dets.join(F.broadcast(labels), "label", "left_semi"), gts, combos, 100, cats))
    p = precisions(bits, materialise(truths(gts)), combos)
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c.area).alias("area"), F.lit(TYPES[k % 5]).alias("type")) for k, c in enumerate(combos)])
    rows = p.join(labels.select("label", F.explode(names).alias("c")).select("label", "c.*"), ["label", "k"], "right")
    plain = rows.select("label", "area", "type", F.coalesce("ap", F.lit(0.0)).alias("value"))
    reached = rows.where("type = 'Oth'").select("label", "area", F.lit("BG").alias("type"), F.coalesce("reached", F.lit(0.0)).alias("value"))
    full = rows.where("type = 'Oth'").select("label", "area", F.lit("FN").alias("type"), F.lit(1.0).alias("value"))
    out = plain.unionByName(reached).unionByName(full)
    out = materialise(out.groupingSets([["label", "area", "type"], ["area", "type"]], "label", "area", "type").agg(F.avg("value").alias("value")))
    drop(bits)
    return out
