"""Window patterns that other operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark prunes before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return topk_per(df, keys, order, 1)


def running_by_rank(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str] | None = None, maxes: dict[str, str] | None = None, lags: dict[str, str] | None = None, parts: int | None = None
) -> DataFrame:
    """Running sums, running maxima and values of the row before, in the order of ``order`` within ``keys``.

    Two passes, so that one key may span many tasks: the rows are range-partitioned by (keys, order); each (key, partition)
    is worked off by itself, and what the partitions before it come to (a row per key and partition) is added. Every frame
    starts at the first row, which Spark evaluates in one sweep. ``order`` must be total. ``sums``, ``maxes``, ``lags``: new column -> column.
    """
    from boxloom.operators.tables import materialise

    sums, maxes, lags = sums or {}, maxes or {}, lags or {}
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    rows = materialise(rows)
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    last = F.struct(*[F.col(c).alias(f"_v_{o}") for o, c in lags.items()]) if lags else None
    totals = rows
    if lags:  # the last row of each part
        totals = totals.withColumn("_end", F.row_number().over(first))
    aggs = [F.sum(c).alias(f"_t_{o}") for o, c in sums.items()] + [F.max(c).alias(f"_t_{o}") for o, c in maxes.items()]
    if lags:
        aggs.append(F.max_by(last, "_end").alias("_last"))
    totals = totals.groupBy(*keys, "_part").agg(*aggs)
    by_part = Window.partitionBy(*keys).orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums], *[F.max(f"_t_{o}").over(before).alias(f"_o_{o}") for o in maxes],
        *([F.lag("_last").over(by_part).alias("_last")] if lags else []),
    )
    local = first.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "*", *[F.sum(c).over(local).alias(f"_l_{o}") for o, c in sums.items()], *[F.max(c).over(local).alias(f"_l_{o}") for o, c in maxes.items()],
        *[F.lag(c).over(first).alias(f"_l_{o}") for o, c in lags.items()], *([F.row_number().over(first).alias("_rn")] if lags else []),
    ).join(offsets, [*keys, "_part"])
    out = [(F.col(f"_l_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums]
    out += [F.greatest(f"_l_{o}", f"_o_{o}").alias(o) for o in maxes]
    out += [F.when(F.col("_rn") > 1, F.col(f"_l_{o}")).otherwise(F.col(f"_last._v_{o}")).alias(o) for o in lags]
    return rows.select(*df.columns, *out)


def cum_sum_by_rank(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Running sums: see :func:`running_by_rank`."""
    return running_by_rank(df, keys, order, sums=sums, parts=parts)


def reverse_cummax(df: DataFrame, keys: list[str], order: list[Column], maxes: dict[str, str], parts: int | None = None) -> DataFrame:
    """Greatest value from each row to the last of its key. ``order`` is that of the reversed rows: the last one first."""
    return running_by_rank(df, keys, order, maxes=maxes, parts=parts)
