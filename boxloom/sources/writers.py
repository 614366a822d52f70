"""Result formats. Each function makes the rows to write; the ``write_*`` ones write them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.geometry import box, fmt4, strip_ext, xyxy2xywh


def to_submission_json(dets: DataFrame) -> DataFrame:
    """image_id, json: one array per image, truncated toward zero, best first."""
    b = box()
    one = F.struct(
        b.x1.cast("int").alias("x"), b.y1.cast("int").alias("y"), F.greatest((b.x2 - b.x1).cast("int"), F.lit(1)).alias("w"),
        F.greatest((b.y2 - b.y1).cast("int"), F.lit(1)).alias("h"), F.col("score").alias("p"),
    )
    t = dets.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "det_id", one.alias("o")))).alias("a"))
    return t.select("image_id", F.to_json(F.transform("a", lambda x: x["o"])).alias("json"))


def write_submission(dets: DataFrame, path: str, buckets: int = 64) -> None:
    """Hash buckets of images rather than a file for each."""
    to_submission_json(dets).withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets))).write.partitionBy("bucket").json(path)


def to_voc_lines(dets: DataFrame, name: str = "filename") -> DataFrame:
    n = [F.col(c).cast("long").cast("string") for c in ("x1", "y1", "x2", "y2")]
    return dets.select("det_id", F.concat_ws(" ", strip_ext(F.col(name)), fmt4(F.col("score")), *n).alias("line"))


def det2coco(dets: DataFrame, cats: DataFrame) -> DataFrame:
    """det_id, image_id, category_id, bbox, score. ``cats``: label, category_id."""
    t = dets.join(F.broadcast(cats), "label")  # a row per category
    return t.select("det_id", "image_id", "category_id", F.array(*xyxy2xywh(box())).alias("bbox"), "score")


def proposal2coco(props: DataFrame) -> DataFrame:
    return props.select("det_id", "image_id", F.lit(1).alias("category_id"), F.array(*xyxy2xywh(box())).alias("bbox"), "score")


def segm2coco(dets: DataFrame, cats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(box rows, mask rows); a mask's score is its own if it has one. ``dets`` has segmentation and mask_score too."""
    t = dets.join(F.broadcast(cats), "label")
    rows = t.select("det_id", "image_id", "category_id", F.array(*xyxy2xywh(box())).alias("bbox"), "score")
    return rows, t.select("det_id", "image_id", "category_id", F.coalesce("mask_score", "score").alias("score"), "segmentation")


def results2json(kind: str, dets: DataFrame, cats: DataFrame | None = None) -> dict[str, DataFrame]:
    """File suffix to rows, by kind of result: bbox, segm or proposal."""
    if kind == "bbox":
        return {"bbox": det2coco(dets, cats)}
    if kind == "segm":
        b, s = segm2coco(dets, cats)
        return {"bbox": b, "segm": s}
    if kind == "proposal":
        return {"proposal": proposal2coco(dets)}
    raise TypeError(f"unknown kind of result {kind!r}")


def nest_annotations(images: DataFrame, gts: DataFrame) -> DataFrame:
    """image_id, bboxes, labels, bboxes_ignore, labels_ignore; images without truths have empty arrays."""
    item = F.struct("gt_id", F.array("x1", "y1", "x2", "y2").alias("b"), F.col("label").cast("long").alias("l"))
    arr = lambda c: F.array_sort(F.collect_list(F.when(c, item)))
    t = gts.groupBy("image_id").agg(arr(~F.col("is_ignore")).alias("a"), arr(F.col("is_ignore")).alias("i"))
    t = images.select("image_id").join(t, "image_id", "left")
    get = lambda a, f, kind: F.coalesce(F.transform(a, lambda x: x[f]), F.array().cast(kind))
    return t.select("image_id", get("a", "b", "array<array<double>>").alias("bboxes"), get("a", "l", "array<bigint>").alias("labels"), get("i", "b", "array<array<double>>").alias("bboxes_ignore"), get("i", "l", "array<bigint>").alias("labels_ignore"))


def flatten_annotations(nested: DataFrame) -> DataFrame:
    part = lambda s, ign: nested.select("image_id", F.posexplode(F.arrays_zip(F.col("bboxes" + s).alias("b"), F.col("labels" + s).alias("l"))).alias("pos", "z"), F.lit(ign).alias("is_ignore"))
    t = part("", False).unionByName(part("_ignore", True))
    return t.select("image_id", F.col("pos").cast("long").alias("pos"), "is_ignore", F.col("z.l").alias("label"), *[F.col("z.b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def to_rois(dets: DataFrame, images: DataFrame) -> DataFrame:
    """Boxes with the number of their image in a batch table ``images`` (image_id, batch_ind)."""
    return dets.join(images.select("image_id", "batch_ind"), "image_id").select("batch_ind", "det_id", "x1", "y1", "x2", "y2")


def from_rois(rois: DataFrame, images: DataFrame) -> DataFrame:
    """The reverse of :func:`to_rois`: boxes by the image whose number in the batch they carry."""
    return rois.join(images.select("batch_ind", "image_id"), "batch_ind").select("image_id", *[c for c in rois.columns if c != "batch_ind"])


def by_class(images: DataFrame, dets: DataFrame, labels: Sequence[int]) -> DataFrame:
    """image_id, label, dets: every class of every image, empty ones too."""
    item = F.struct((-F.col("score")).alias("neg"), "det_id", "x1", "y1", "x2", "y2")
    d = dets.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(item)).alias("dets"))
    grid = images.select("image_id", F.explode(F.array(*[F.lit(k) for k in labels])).alias("label"))
    return grid.join(d, ["image_id", "label"], "left").withColumn("n", F.coalesce(F.size("dets"), F.lit(0)))
