"""Table functions for SQL: tiles, points and anchors of an image size (LATERAL), and suppression of a table (PARTITION BY)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from boxloom.operators import kernels

#: Strides, scales and ratios of the default anchor grid.
STRIDES, SCALES, RATIOS = (8, 16, 32, 64, 128), (4.0, 5.0397, 6.3496), (0.5, 1.0, 2.0)


def _starts(size: int, patch: int, stride: int) -> list[int]:
    n = math.ceil((size - patch) / stride) + 1
    return [size - patch if i == n - 1 else i * stride for i in range(max(n, 0))]


class Tiles:
    """tiles(width, height, patch, stride): a row per tile, column after column; the last ones are right-aligned."""

    def eval(self, width: int, height: int, patch: int, stride: int):
        if None not in (width, height):
            ys = _starts(height, patch, stride)
            for i, x in enumerate(_starts(width, patch, stride)):
                for j, y in enumerate(ys):
                    yield i * len(ys) + j, x, y


class Points:
    """points(width, height, stride): the grid of a feature map of that size."""

    def eval(self, width: int, height: int, stride: int):
        if None not in (width, height):
            for row in range(height):
                for col in range(width):
                    yield row * width + col, float(col * stride), float(row * stride)


class Anchors:
    """anchors(width, height): the default anchor grid, level after level, the anchors of a cell together."""

    def eval(self, width: int, height: int):
        if None in (width, height):
            return
        at = 0
        for level, s in enumerate(STRIDES):
            shapes, centre = [], (s - 1) * 0.5
            for ratio in RATIOS:
                for scale in SCALES:
                    w, h = s * scale / math.sqrt(ratio), s * scale * math.sqrt(ratio)
                    shapes.append([float(np.round(v)) for v in (centre - 0.5 * (w - 1), centre - 0.5 * (h - 1), centre + 0.5 * (w - 1), centre + 0.5 * (h - 1))])
            for row in range(-(-height // s)):
                for col in range(-(-width // s)):
                    for x1, y1, x2, y2 in shapes:
                        yield at, level, x1 + col * s, y1 + row * s, x2 + col * s, y2 + row * s
                        at += 1


class Suppress:
    """suppress(TABLE(t) PARTITION BY keys ORDER BY score DESC, det_id, thr): the det_ids that stay. t has det_id, x1, y1, x2, y2."""

    def __init__(self):
        self.rows, self.thr = [], 0.5

    def eval(self, row, thr: float):
        self.thr = thr
        self.rows.append((row["det_id"], row["x1"], row["y1"], row["x2"], row["y2"]))

    def terminate(self):
        if self.rows:
            for i in kernels.nms(np.array([r[1:] for r in self.rows], float), self.thr):
                yield (self.rows[i][0],)


def register(spark: SparkSession) -> None:
    """Make tiles, points, anchors and suppress known to ``spark.sql``."""
    for name, cls, kind in (
        ("tiles", Tiles, "tile_idx: long, x: long, y: long"),
        ("points", Points, "point_idx: long, x: double, y: double"),
        ("anchors", Anchors, "anchor_idx: long, level: int, x1: double, y1: double, x2: double, y2: double"),
        ("suppress", Suppress, "det_id: long"),
    ):
        spark.udtf.register(name, udtf(cls, returnType=kind))
