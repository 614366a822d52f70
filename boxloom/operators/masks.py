"""Run-length masks (uncompressed counts, column by column, starting with background) and raw pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rle_area(counts: Column) -> Column:
    """Pixels of the foreground: every second run."""
    return F.aggregate(F.filter(counts, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))


def rle_intersection(a: Column, b: Column) -> Column:
    """Common foreground: the overlap of each pair of runs, from their ends."""
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.struct(i.alias("i"), F.aggregate(F.slice(c, 1, i), F.lit(0).cast("long"), lambda s, v: s + v.cast("long")).alias("e"), F.element_at(c, i).cast("long").alias("n")))
    fore = lambda c: F.filter(ends(c), lambda x: x["i"] % 2 == 0)
    one = lambda x, y: F.greatest(F.least(x["e"], y["e"]) - F.greatest(x["e"] - x["n"], y["e"] - y["n"]), F.lit(0).cast("long"))
    return F.aggregate(fore(a), F.lit(0).cast("long"), lambda s, x: s + F.aggregate(fore(b), F.lit(0).cast("long"), lambda t, y: t + one(x, y)))


def rle_iou(a: Column, b: Column) -> Column:
    i = rle_intersection(a, b)
    return F.coalesce(F.try_divide(i.cast("double"), (rle_area(a) + rle_area(b) - i).cast("double")), F.lit(0.0))


def mask_iou_target(pred_area: Column, overlap: Column, gt_in_box: Column, ratio: Column) -> Column:
    """Overlap over union, the truth's full size taken from its share inside the box."""
    return overlap / (pred_area + gt_in_box / F.greatest(ratio, F.lit(1e-7)) - overlap)


def mask_score(box_score: Column, ious: Column, label: Column) -> Column:
    return box_score * F.element_at(ious, label)


def split_polys(polys: Column, lens: Column) -> Column:
    """A flat array cut into parts of the given lengths."""
    start = lambda i: F.aggregate(F.slice(lens, 1, i), F.lit(1), lambda s, v: s + v)
    return F.transform(lens, lambda n, i: F.slice(polys, start(i), n))


def _per_image(df: DataFrame, run, schema: str) -> DataFrame:
    """``df`` (…, h, w, c, pixels) with each pixel array changed by ``run``."""
    at = [df.columns.index(x) for x in ("h", "w", "c", "pixels")]

    def go(batches):
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            h, w, c, px = (cols[i].to_pylist() for i in at)
            new = [run(np.frombuffer(p, np.uint8).reshape(y, x, z)) for y, x, z, p in zip(h, w, c, px, strict=True)]
            for k, i in enumerate(at[:3]):
                cols[i] = pa.array([a.shape[k] for a in new], pa.int32())
            cols[at[3]] = pa.array([np.ascontiguousarray(a).tobytes() for a in new], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(go, schema or df.schema)


def cut_tiles(images_raw: DataFrame, tiles: DataFrame, patch: tuple[int, int] = (800, 800)) -> DataFrame:
    """image_id, tile_idx, x, y, pixels of each tile; what lies outside the image is left out."""

    def go(batches):
        for b in batches:
            h, w, c, px = (b.column(n).to_pylist() for n in ("h", "w", "c", "pixels"))
            xs, ys = b.column("x").to_pylist(), b.column("y").to_pylist()
            out = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(a, q, z)[max(y, 0) : y + patch[1], max(x, 0) : x + patch[0]]).tobytes() for a, q, z, p, x, y in zip(h, w, c, px, xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("image_id", "tile_idx", "x", "y")], pa.array(out, pa.binary())], names=["image_id", "tile_idx", "x", "y", "pixels"])

    return tiles.select("image_id", "tile_idx", "x", "y").join(images_raw, "image_id").mapInArrow(go, "image_id long, tile_idx long, x long, y long, pixels binary")


def flip_pixels(df: DataFrame, direction: str = "horizontal") -> DataFrame:
    return _per_image(df, lambda a: a[:, ::-1] if direction == "horizontal" else a[::-1], None)


def pad_pixels(df: DataFrame, divisor: int, value: int = 0) -> DataFrame:
    def pad(a):
        h, w = (-(-s // divisor) * divisor for s in a.shape[:2])
        return np.pad(a, ((0, h - a.shape[0]), (0, w - a.shape[1]), (0, 0)), constant_values=value)

    return _per_image(df, pad, None)


def normalize_pixels(df: DataFrame, mean, std, to_rgb: bool = True) -> DataFrame:
    """Pixels as float32 bytes: (value - mean) / std, channels turned around if ``to_rgb``."""
    m, s = np.array(mean, np.float32), np.array(std, np.float32)
    return _per_image(df, lambda a: ((a[..., ::-1] if to_rgb else a).astype(np.float32) - m) / s, None)


def standardize_brightness(df: DataFrame) -> DataFrame:
    return _per_image(df, lambda a: np.clip(a * 255.0 / np.percentile(a, 90), 0, 255).astype(np.uint8), None)


def optical_density(df: DataFrame) -> DataFrame:
    """-ln(value / 255) as float64 bytes, zeros taken as 1."""
    return _per_image(df, lambda a: -np.log(np.where(a == 0, 1, a) / 255.0), None)


def score_tiles(tiles: DataFrame, make_predict, schema: str, batch_size: int = 8) -> DataFrame:
    """Run a detector over tiles: ``make_predict()`` is called once per task and returns pandas -> pandas."""

    def go(batches):
        predict = make_predict()
        for p in batches:
            for i in range(0, len(p), batch_size):
                yield predict(p.iloc[i : i + batch_size])

    return tiles.mapInPandas(go, schema)
