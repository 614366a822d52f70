"""Loss values over prediction tables, and gradient-harmonised weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import box, iou, sigmoid


def smooth_l1(pred: Column, target: Column, beta: float = 1.0) -> Column:
    d = F.abs(pred - target)
    return F.when(d < beta, d * d * 0.5 / beta).otherwise(d - 0.5 * beta)


def balanced_l1(pred: Column, target: Column, beta: float = 1.0, alpha: float = 0.5, gamma: float = 1.5) -> Column:
    d, b = F.abs(pred - target), math.exp(gamma / alpha) - 1
    return F.when(d < beta, (b * d + 1) * F.ln(b * d / beta + 1) * (alpha / b) - d * alpha).otherwise(d * gamma + gamma / b - alpha * beta)


def mse(pred: Column, target: Column) -> Column:
    return (pred - target) * (pred - target)


def bce(logit: Column, target: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.ln(F.lit(1.0) + F.exp(-F.abs(logit)))


def sigmoid_focal(logit: Column, target: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = sigmoid(logit)
    pt = (F.lit(1.0) - p) * target + p * (F.lit(1.0) - target)
    return bce(logit, target) * (target * alpha + (F.lit(1.0) - target) * (1 - alpha)) * F.pow(pt, F.lit(float(gamma)))


def cross_entropy(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.ln(total) + top - F.element_at(logits, label + 1)


def iou_loss(prefix_a: str, prefix_b: str, eps: float = 1e-6) -> Column:
    return -F.ln(F.greatest(iou(box(prefix_a), box(prefix_b)), F.lit(eps)))


def bounded_iou(prefix_pred: str, prefix_target: str, beta: float = 0.2, eps: float = 1e-3) -> list[Column]:
    """The four parts (centre x and y, width, height) of the bounded IoU loss, each smoothed below ``beta``."""
    p, t = box(prefix_pred), box(prefix_target)
    parts = []
    for a1, a2, b1, b2 in ((p.x1, p.x2, t.x1, t.x2), (p.y1, p.y2, t.y1, t.y2)):
        own, far = b2 - b1 + 1, F.abs((b1 + b2) * 0.5 - (a1 + a2) * 0.5) * 2
        parts.append(F.lit(1.0) - F.greatest((own - far) / (own + far + eps), F.lit(0.0)))
    for a, b in ((p.x2 - p.x1 + 1, t.x2 - t.x1 + 1), (p.y2 - p.y1 + 1, t.y2 - t.y1 + 1)):
        parts.append(F.lit(1.0) - F.least(b / (a + eps), a / (b + eps)))
    return [smooth_l1(v, F.lit(0.0), beta) for v in parts]


def loss_report(df: DataFrame, loss: Column, weight: Column | None = None, reduction: str = "mean", avg_factor: Column | float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, loss: weighted and reduced. ``avg_factor`` divides the sum in place of the count; with 'sum' it is an error."""
    v = loss if weight is None else loss * weight
    if reduction == "none":
        return df.withColumn("loss", v)
    if reduction == "sum":
        if avg_factor is not None:
            raise ValueError('avg_factor can not be used with reduction="sum"')
        return df.groupBy(*by).agg(F.sum(v).alias("loss"))
    if avg_factor is None:
        return df.groupBy(*by).agg(F.avg(v).alias("loss"))
    f = F.lit(float(avg_factor)) if isinstance(avg_factor, (int, float)) else F.sum(avg_factor)
    return df.groupBy(*by).agg((F.sum(v) / f).alias("loss"))


def ghm_weights(df: DataFrame, g: Column, bins: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """``df`` with bin and weight = total / (rows of the bin * bins in use); the bins are one small table.

    ``counts`` (bin, acc): running counts, as of :func:`boxloom.streaming.jobs.stream_histogram`, in place of the rows of a bin.
    """
    t = df.withColumn("bin", F.least(F.floor(g * bins), F.lit(bins - 1)).cast("int"))
    c = t.groupBy("bin").agg(F.count("*").alias("n"))
    s = c.agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    if counts is not None:
        c = c.join(F.broadcast(counts.select("bin", "acc")), "bin")
    c = c.join(F.broadcast(s)).select("bin", (F.col("total") / (F.col("n" if counts is None else "acc") * F.col("used"))).alias("weight"))
    return t.join(F.broadcast(c), "bin")


def ghm_c(prob: Column, target: Column) -> Column:
    return F.abs(prob - target)


def ghm_r(diff: Column, mu: float = 0.02) -> Column:
    return F.abs(diff) / F.sqrt(diff * diff + mu * mu)
