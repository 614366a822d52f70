"""Roll-ups of training logs, corruption benchmarks and stage timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def train_time(logs: DataFrame, include_outliers: bool = False) -> DataFrame:
    """Per run: slowest and fastest epoch with their mean times, population deviation of the epochs' means, overall mean.

    The first iteration of each epoch is left out unless ``include_outliers``.
    """
    t = logs.where("mode = 'train'")
    if not include_outliers:
        w = Window.partitionBy("run_id", "epoch").orderBy("iter", "event_id")
        t = t.withColumn("_rn", F.row_number().over(w)).where("_rn > 1")
    e = t.groupBy("run_id", "epoch").agg(F.avg("time").alias("m"), F.sum("time").alias("s"), F.count("*").alias("n"))
    pick = lambda f, c: f(c, F.struct("m", -F.col("epoch")) if f is F.max_by else F.struct("m", "epoch"))
    return e.groupBy("run_id").agg(
        pick(F.max_by, "epoch").alias("slowest_epoch"), F.max("m").alias("slowest"), pick(F.min_by, "epoch").alias("fastest_epoch"),
        F.min("m").alias("fastest"), F.stddev_pop("m").alias("std"), (F.sum("s") / F.sum("n")).alias("mean"),
    )


def learning_curve(logs: DataFrame, metric: str) -> DataFrame:
    """run_id, x, value: x = iter + (epoch - 1) * iterations of an epoch, these being the last train iter of the first epoch."""
    first = logs.where("mode = 'train'").withColumn("_e", F.min("epoch").over(Window.partitionBy("run_id"))).where("epoch = _e")
    n = first.groupBy("run_id").agg(F.max("iter").alias("_per"))
    t = logs.where("mode = 'train'").join(n, "run_id")
    return t.select("run_id", "event_id", (F.col("iter") + (F.col("epoch") - 1) * F.col("_per")).alias("x"), F.col(metric).alias("value"))


def robustness(results: DataFrame, metric: str = "ap", aggregate: str = "benchmark", benchmark: int = 15) -> DataFrame:
    """p (clean), mpc (mean over corruptions and severities >= 1), rpc = mpc / p. ``results``: corruption (number), severity, metric."""
    ok = (F.col("severity") >= 1) & ((F.col("corruption") < benchmark) if aggregate == "benchmark" else F.lit(True))
    one = results.agg(F.avg(F.when((F.col("severity") == 0) & (F.col("corruption") == 0), F.col(metric))).alias("p"), F.avg(F.when(ok, F.col(metric))).alias("mpc"))
    return one.select("p", "mpc", F.try_divide("mpc", "p").alias("rpc"))


def unpivot_metrics(results: DataFrame, metrics: list[str]) -> DataFrame:
    """corruption, severity, metric, value from one column per metric."""
    return results.unpivot(["corruption", "severity"], metrics, "metric", "value")


def robustness_by_metric(results: DataFrame, aggregate: str = "benchmark", benchmark: int = 15) -> DataFrame:
    """metric, p, mpc, rpc of every metric at once. ``results``: corruption, severity, metric, value."""
    ok = (F.col("severity") >= 1) & ((F.col("corruption") < benchmark) if aggregate == "benchmark" else F.lit(True))
    clean = (F.col("severity") == 0) & (F.col("corruption") == 0)
    one = results.groupBy("metric").agg(F.avg(F.when(clean, F.col("value"))).alias("p"), F.avg(F.when(ok, F.col("value"))).alias("mpc"))
    return one.select("metric", "p", "mpc", F.try_divide("mpc", "p").alias("rpc"))


def timing_report(timings: DataFrame) -> DataFrame:
    """timer, average, total, calls, weighted: ``timings`` has timer, seconds, n."""
    return timings.groupBy("timer").agg(F.avg("seconds").alias("average"), F.sum("seconds").alias("total"), F.count("*").alias("calls"), (F.sum(F.col("seconds") * F.col("n")) / F.sum("n")).alias("weighted"))
