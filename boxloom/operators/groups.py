"""Numpy kernels over the groups of a sorted table, streamed: no frame per group, no group list in memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], run: Callable[[dict[str, np.ndarray]], list[np.ndarray] | None], schema: str) -> DataFrame:
    """``run`` gets the columns of one group, in order, as arrays, and returns the output's columns.

    The rows are dealt by the keys and sorted by Spark (which spills); a task holds one Arrow batch and one group.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    probe = df.sparkSession.createDataFrame([], schema).schema
    fields = [(f.name, f.dataType.simpleString()) for f in probe]
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [(n, types[t]) for n, t in fields]

    def go(batches):
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            n = len(cols[0])
            new = np.zeros(n, bool)
            for i in at:
                new[1:] |= cols[i][1:] != cols[i][:-1]
            cuts = np.concatenate(([0], np.flatnonzero(new)))
            yield from emit(cols, cuts[:-1], cuts[1:])
            held = [c[cuts[-1] :] for c in cols]
        if held is not None:
            yield from emit(held, np.array([0]), np.array([len(held[0])]))

    def emit(cols, starts, ends):
        out: list[list[np.ndarray]] = [[] for _ in kinds]
        for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
            got = run({n: c[a:z] for n, c in zip(names, cols, strict=True)})
            if got is not None:
                for o, g in zip(out, got, strict=True):
                    o.append(g)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), t) for o, (_, t) in zip(out, kinds, strict=True)], names=[n for n, _ in kinds])

    # a fixed number: rows are few but costly here, so small partitions must not be merged
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(go, schema)


def schema_of(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + list(more))
