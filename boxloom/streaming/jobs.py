"""The same work on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from boxloom.functions.geometry import box, iou
from boxloom.operators import kernels

XY = ["x1", "y1", "x2", "y2"]


def stream_dedupe(stream: DataFrame, keys: Sequence[str], ts: str = "ts", bound: str = "1 hour") -> DataFrame:
    """Repeats of a key within the bound go."""
    return stream.withWatermark(ts, bound).dropDuplicatesWithinWatermark(list(keys))


def stream_log_windows(stream: DataFrame, kind: str = "tumbling", size: str = "10 minutes", slide: str = "5 minutes", watermark: str = "1 hour", keys: Sequence[str] = ("run_id",), ts: str = "ts") -> DataFrame:
    """start, end, keys, n, mean time per window; late rows are dropped by the watermark."""
    w = {"tumbling": lambda: F.window(ts, size), "sliding": lambda: F.window(ts, size, slide), "session": lambda: F.session_window(ts, size)}[kind]()
    t = stream.withWatermark(ts, watermark) if stream.isStreaming else stream
    t = t.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("time").alias("mean"))
    return t.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean")


def stream_hits(stream: DataFrame, gts: DataFrame, thr: float = 0.5) -> DataFrame:
    """label, n, hits: detections so far, and those that reach a truth. Exact: a detection is one row of the stream, and its
    best overlap with the static truths of its image comes from one row per image and label."""
    one = F.struct(*[F.col(c) for c in XY])
    g = gts.groupBy("image_id", "label").agg(F.collect_list(one).alias("_truths"))
    j = stream.join(g, ["image_id", "label"], "left")
    hit = F.exists(F.coalesce("_truths", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")), lambda t: iou(box(), box(source=t)) >= thr)
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("hits"))


def stream_running_mean(stream: DataFrame, keys: Sequence[str], value: str = "time", momentum: float | None = None) -> DataFrame:
    """keys, n, mean after each micro-batch: the plain mean, or an exponential one."""
    keys = list(keys)
    kinds = [f"`{k}` {dict(stream.dtypes)[k]}" for k in keys]

    def run(key, pdfs, state):
        n, m = state.get if state.exists else (0, 0.0)
        for p in pdfs:
            for v in p[value]:
                n += 1
                m = m + (v - m) / n if momentum is None or n == 1 else momentum * m + (1 - momentum) * v
        state.update((n, m))
        yield pd.DataFrame([[*key, n, m]], columns=[*keys, "n", "mean"])

    return stream.groupBy(*keys).applyInPandasWithState(run, ", ".join([*kinds, "n long", "mean double"]), "n long, mean double", "update", GroupStateTimeout.NoTimeout)


def stream_histogram(stream: DataFrame, keys: Sequence[str], value: str, bins: int = 10, momentum: float = 0.75) -> DataFrame:
    """keys, bin, n, acc, total after each micro-batch, for the bins that it filled: rows in the bin, their count with decay, rows of the key.

    Bins part [0, 1] evenly; values outside and nulls are left out, 1 belongs to the last bin. A bin that a micro-batch fills goes to
    momentum * before + (1 - momentum) * rows; one without rows keeps its count. This is the running count that harmonised losses weigh by
    (:func:`boxloom.operators.losses.ghm_weights` with ``counts``); with momentum 0 it is the micro-batch's own.
    """
    keys = list(keys)
    kinds = [f"`{k}` {dict(stream.dtypes)[k]}" for k in keys]

    def run(key, pdfs, state):
        acc = list(state.get[0]) if state.exists else [0.0] * bins
        n = [0] * bins
        for p in pdfs:
            v = p[value].dropna()
            v = v[(v >= 0) & (v <= 1)]
            for b, k in (v * bins).astype(int).clip(upper=bins - 1).value_counts().items():
                n[b] += int(k)
        acc = [momentum * a + (1 - momentum) * k if k else a for a, k in zip(acc, n, strict=True)]
        state.update((acc,))
        rows = [[*key, b, n[b], acc[b], sum(n)] for b in range(bins) if n[b]]
        yield pd.DataFrame(rows, columns=[*keys, "bin", "n", "acc", "total"])

    out = ", ".join([*kinds, "bin int, n long, acc double, total long"])
    return stream.groupBy(*keys).applyInPandasWithState(run, out, "acc array<double>", "update", GroupStateTimeout.NoTimeout)


#: Keeps the states of :func:`stream_merge_tiles`.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MERGED = "image_id long, det_id long, score double, x1 double, y1 double, x2 double, y2 double, complete boolean"


class TileMerger(StatefulProcessor):
    """State of one image: its boxes by (tile, detection), each tile's expected number, and whether the image was closed."""

    def __init__(self, timeout_ms: int, keep_ms: int, tile_thr: float, tile_top: int, image_thr: float):
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms
        self.tile_thr, self.tile_top, self.image_thr = tile_thr, tile_top, image_thr

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.boxes = handle.getMapState("boxes", "tile long, det long", "score double, x1 double, y1 double, x2 double, y2 double")
        # a tile that is merged has expected = -1: repeats of its rows are known by that
        self.tiles = handle.getMapState("tiles", "tile long", "expected long")
        self.plan = handle.getValueState("plan", "n_tiles int")
        self.closed = handle.getValueState("closed", "closed boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.closed.exists():  # after the end of an image: late rows open no second one
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.plan.exists():
            self.handle.registerTimer(now + self.timeout_ms)
        touched = set()
        for p in rows:
            for r in p.itertuples(index=False):
                tile = (int(r.tile_idx),)
                self.plan.update((int(r.n_tiles),))
                if self.tiles.containsKey(tile) and self.tiles.getValue(tile)[0] < 0:
                    continue
                self.tiles.updateValue(tile, (int(r.tile_dets),))
                touched.add(tile[0])
                if pd.notna(r.det_id):
                    box = (float(r.score), float(r.x1 + r.tile_x), float(r.y1 + r.tile_y), float(r.x2 + r.tile_x), float(r.y2 + r.tile_y))
                    self.boxes.updateValue((tile[0], int(r.det_id)), box)
        held: dict[int, list] = {}
        for (t, d), b in self.boxes.iterator():
            held.setdefault(t, []).append((d, *b))
        for t in touched:
            if len(held.get(t, [])) >= self.tiles.getValue((t,))[0]:
                kept = {b[0] for b in self._best(held.get(t, []), self.tile_thr)[: self.tile_top]}
                for d, *_ in held.get(t, []):
                    if d not in kept:
                        self.boxes.removeKey((t, d))
                self.tiles.updateValue((t,), (-1,))
        done = sum(e[0] < 0 for _, e in self.tiles.iterator())
        if done >= self.plan.get()[0]:
            yield self._close(key, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.closed.exists():
            yield self._close(key, False)

    def _best(self, boxes: list, thr: float) -> list:
        boxes = sorted(boxes, key=lambda b: (-b[1], b[0]))
        return [boxes[i] for i in kernels.nms(np.array([b[2:] for b in boxes], float).reshape(-1, 4), thr)]

    def _close(self, key, complete: bool) -> pd.DataFrame:
        tiles: dict[int, list] = {}
        for (t, d), b in list(self.boxes.iterator()):
            tiles.setdefault(t, []).append((d, *b))
        merged = {t for (t,), e in self.tiles.iterator() if e[0] < 0}
        every = [b for t, held in tiles.items() for b in (held if t in merged else self._best(held, self.tile_thr)[: self.tile_top])]
        for state in (self.boxes, self.tiles, self.plan):
            state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.closed.update((True,))
        rows = [(int(key[0]), d, *b, complete) for d, *b in self._best(every, self.image_thr)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MERGED.split(", ")])

    def close(self) -> None:
        pass


def stream_merge_tiles(
    stream: DataFrame, plans: DataFrame, timeout_ms: int = 60_000, tile_thr: float = 0.5, tile_top: int = 100, image_thr: float = 0.5, keep_ms: int = 86_400_000
) -> DataFrame:
    """Detections of an image once all tiles of its plan are whole, or what there is ``timeout_ms`` after its first row (complete = false).

    ``stream``: image_id, tile_idx, tile_x, tile_y, tile_dets, det_id, score, box; ``plans``: image_id, n_tiles. tile_dets says how many detections
    the tile has, so they may come in any number of micro-batches; a tile without any sends one row with a null det_id. Rows that come
    again change nothing. A whole tile is cut to its ``tile_top`` survivors, which is what the state holds of it. A closed image leaves a mark for ``keep_ms``:
    rows that come after it are dropped and open no second image. The query needs the RocksDB state store, which is set here for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    s = stream.join(plans.select("image_id", "n_tiles"), "image_id")
    merger = TileMerger(timeout_ms, keep_ms, tile_thr, tile_top, image_thr)
    return s.groupBy("image_id").transformWithStateInPandas(merger, MERGED, "Append", "processingTime")
