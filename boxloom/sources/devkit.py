"""A VOC devkit (several years, several splits) as one annotation table, partitioned by data set and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.sources.readers import parse_voc
from boxloom.sources.writers import nest_annotations

#: The years of a devkit, and the splits that both years together have.
YEARS = ("2007", "2012")
COMBINED_SPLITS = ("train", "val", "trainval")
SPLITS = (*COMBINED_SPLITS, "test")


def read_lists(spark: SparkSession, root: str) -> DataFrame:
    """(year, split, name) of every image list that the devkit has; a list that is missing gives no rows."""
    t = spark.read.text(f"{root}/VOC*/ImageSets/Main", pathGlobFilter="*.txt").select(F.input_file_name().alias("f"), F.trim("value").alias("name"))
    t = t.select(F.regexp_extract("f", r"/VOC(\d+)/ImageSets/Main/", 1).alias("year"), F.regexp_extract("f", r"/Main/([^/]+)\.txt$", 1).alias("split"), "name")
    return t.where(F.col("year").isin(*YEARS) & F.col("split").isin(*SPLITS) & (F.col("name") != ""))


def read_annotations(spark: SparkSession, root: str) -> DataFrame:
    """(year, name, xml) of every annotation file."""
    t = spark.read.text(f"{root}/VOC*/Annotations/*.xml", wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("xml"))
    return t.select(F.regexp_extract("f", r"/VOC(\d+)/Annotations/", 1).alias("year"), F.regexp_extract("f", r"([^/]+)\.xml$", 1).alias("name"), "xml")


def data_sets(lists: DataFrame) -> DataFrame:
    """(dataset, split, year, name): each year by itself, and both years together where both have the split; together there is no test split."""
    own = lists.select(F.concat(F.lit("voc"), F.substring("year", 3, 2)).alias("dataset"), "split", "year", "name")
    have = lists.where(F.col("split").isin(*COMBINED_SPLITS)).groupBy("split").agg(F.countDistinct("year").alias("n")).where(F.col("n") == len(YEARS))
    both = lists.join(F.broadcast(have.select("split")), "split", "left_semi")  # a row per split
    return own.unionByName(both.select(F.lit("voc0712").alias("dataset"), "split", "year", "name"))


def annotations(lists: DataFrame, xml: DataFrame, classes: Sequence[str]) -> DataFrame:
    """dataset, split, name, filename, width, height, bboxes, labels, bboxes_ignore, labels_ignore: a row per image of each data set.

    ``xml``: year, name, xml. Difficult objects are ignored ones; an image without an annotation file is left out, one without objects has empty
    arrays. A file is parsed once, however many splits name it.
    """
    key = F.concat_ws("/", "year", "name")
    used = xml.join(lists.select("year", "name").distinct(), ["year", "name"], "left_semi")
    images, gts = parse_voc(used.select(key.alias("name"), "xml"), classes)
    boxes = gts.select(F.col("name").alias("image_id"), F.col("pos").alias("gt_id"), "label", "is_ignore", "x1", "y1", "x2", "y2")
    nested = nest_annotations(images.select(F.col("name").alias("image_id")), boxes)
    parsed = images.select(F.col("name").alias("image_id"), "width", "height").join(nested, "image_id")
    rows = data_sets(lists).withColumn("image_id", key)
    filename = F.concat(F.lit("VOC"), F.col("year"), F.lit("/JPEGImages/"), F.col("name"), F.lit(".jpg"))
    return rows.join(parsed, "image_id").select("dataset", "split", "name", filename.alias("filename"), "width", "height", "bboxes", "labels", "bboxes_ignore", "labels_ignore")


def write_annotations(rows: DataFrame, path: str) -> None:
    """One folder per data set and split; those that ``rows`` has are replaced, the others stay."""
    rows.repartition("dataset", "split", F.pmod(F.xxhash64("name"), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "split").parquet(path)


def convert_voc(spark: SparkSession, root: str, path: str, classes: Sequence[str]) -> DataFrame:
    """The devkit below ``root`` converted into ``path``, and read back."""
    write_annotations(annotations(read_lists(spark, root), read_annotations(spark, root), classes), path)
    return spark.read.parquet(path)
