"""Readers of annotation, prediction and log files into tables of boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROI = "struct<x:int,y:int,w:int,h:int,pos_list:array<struct<x:int,y:int,w:int,h:int,class:string>>>"


def class_label(name, classes: Sequence[str], on_unknown: str = "error") -> F.Column:
    """1-based label of a class name. An unknown name is an error, or null with ``on_unknown='null'``."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), name).cast("int")
    fail = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(name, F.lit("null")))).cast("int") if on_unknown == "error" else F.lit(None).cast("int")
    return F.when(at > 0, at).otherwise(fail)


def with_labels(df: DataFrame, classes: Sequence[str], on_unknown: str = "error", column: str = "name") -> DataFrame:
    """``df`` with label. on_unknown: error, drop, or only (the rows with unknown names: the quarantine)."""
    t = df.withColumn("label", class_label(F.col(column), classes, "error" if on_unknown == "error" else "null"))
    return t if on_unknown == "error" else t.where("label IS NOT NULL") if on_unknown == "drop" else t.where("label IS NULL")


#: Data set names and the names they stand for.
ALIASES = {"voc": ["voc", "pascal_voc", "voc07", "voc12"], "imagenet_det": ["det", "imagenet_det", "ilsvrc_det"], "imagenet_vid": ["vid", "imagenet_vid", "ilsvrc_vid"], "coco": ["coco", "mscoco", "ms_coco"], "wider_face": ["WIDERFaceDataset", "wider_face", "WDIERFace"], "cityscapes": ["cityscapes"]}


def resolve_dataset(name: str) -> str:
    """The data set that a name stands for; an unknown name is an error."""
    for known, names in ALIASES.items():
        if name in names:
            return known
    raise ValueError(f"unknown data set {name!r}")


#: The classes of the data sets, in the order of their labels.
CLASSES = {
    "voc": "aeroplane bicycle bird boat bottle bus car cat chair cow diningtable dog horse motorbike person pottedplant sheep sofa train tvmonitor",
    "imagenet_vid": "airplane antelope bear bicycle bird bus car cattle dog domestic_cat elephant fox giant_panda hamster horse lion lizard monkey motorcycle rabbit "
    "red_panda sheep snake squirrel tiger train turtle watercraft whale zebra",
    "coco": "person bicycle car motorcycle airplane bus train truck boat traffic_light fire_hydrant stop_sign parking_meter bench bird cat dog horse sheep cow elephant "
    "bear zebra giraffe backpack umbrella handbag tie suitcase frisbee skis snowboard sports_ball kite baseball_bat baseball_glove skateboard surfboard tennis_racket "
    "bottle wine_glass cup fork knife spoon bowl banana apple sandwich orange broccoli carrot hot_dog pizza donut cake chair couch potted_plant bed dining_table toilet "
    "tv laptop mouse remote keyboard cell_phone microwave oven toaster sink refrigerator book clock vase scissors teddy_bear hair_drier toothbrush",
    "wider_face": "face",
    "cityscapes": "person rider car truck bus train motorcycle bicycle",
}


def class_names(spark: SparkSession, name: str, path: str | None = None) -> list[str]:
    """The classes behind a data set's name or alias. A long list that is not kept here (imagenet_det) is read from ``path``, a name a line."""
    known = resolve_dataset(name)
    if path is not None:
        text = spark.read.text(path, wholetext=True).first()  # one file, a few hundred lines
        return [v.strip() for v in (text["value"] if text else "").splitlines() if v.strip()]
    if known not in CLASSES:
        raise ValueError(f"the classes of {known} are read from a file: give its path")
    return CLASSES[known].split()


def filter_small_images(images: DataFrame, min_size: int) -> DataFrame:
    """Images whose shorter side is at least ``min_size``."""
    return images.where(F.least("width", "height") >= min_size)


def parse_roi(rows: DataFrame, classes: Sequence[str], inclusive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(images, gts) from rows (filename, json). ``inclusive=False`` is the display variant without the -1."""
    t = rows.select("filename", F.from_json("json", ROI).alias("r"))
    t = t.select(F.regexp_replace("filename", r"\.json$", ".png").alias("filename"), "r")
    images = t.select("filename", F.col("r.w").alias("width"), F.col("r.h").alias("height"))
    p = t.select("filename", F.col("r").alias("r"), F.posexplode_outer("r.pos_list").alias("pos", "p")).where("p IS NOT NULL")
    k = 1 if inclusive else 0
    x1, y1 = F.greatest(F.col("p.x") - F.col("r.x"), F.lit(0)), F.greatest(F.col("p.y") - F.col("r.y"), F.lit(0))
    b = {"x1": x1, "y1": y1, "x2": F.least(x1 + F.col("p.w") - k, F.col("r.w")), "y2": F.least(y1 + F.col("p.h") - k, F.col("r.h"))}
    label = class_label(F.col("p.class"), classes)
    return images, p.select("filename", F.col("pos").cast("long").alias("pos"), label.alias("label"), *[v.cast("double").alias(n) for n, v in b.items()])


def read_roi_json(spark: SparkSession, path: str, classes: Sequence[str], inclusive: bool = True) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("json"))
    return parse_roi(rows, classes, inclusive)


VOC = (
    "folder string, size struct<width:int,height:int>, object array<struct<name:string,pose:string,truncated:int,difficult:int,"
    "bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>"
)


def parse_voc(rows: DataFrame, classes: Sequence[str], min_size: int | None = None, evaluation: bool = False, folder_name: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, gts) from rows (name, xml). Coordinates lose 1, unless for ``evaluation``, which keeps pose and truncated.

    Difficult objects, and those under ``min_size``, are ignored ones. ``folder_name``: file names are folder/id.jpg.
    """
    t = rows.select("name", F.from_xml("xml", VOC).alias("a"))
    fn = F.concat_ws("/", "a.folder", F.concat("name", F.lit(".jpg"))) if folder_name else F.concat(F.lit("JPEGImages/"), "name", F.lit(".jpg"))
    images = t.select("name", fn.alias("filename"), F.col("a.size.width").alias("width"), F.col("a.size.height").alias("height"))
    o = t.select("name", F.posexplode_outer("a.object").alias("pos", "o")).where("o IS NOT NULL")
    k = 0 if evaluation else 1
    xy = {n: (F.col(f"o.bndbox.{s}") - k).cast("double") for n, s in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))}
    ign = F.coalesce(F.col("o.difficult"), F.lit(0)) == 1
    if min_size:
        ign = ign | (xy["x2"] - xy["x1"] < min_size) | (xy["y2"] - xy["y1"] < min_size)
    label = class_label(F.trim("o.name"), classes)
    more = [F.col("o.pose"), F.col("o.truncated"), F.col("o.difficult")] if evaluation else []
    return images, o.select("name", F.col("pos").cast("long").alias("pos"), label.alias("label"), ign.alias("is_ignore"), *more, *[v.alias(n) for n, v in xy.items()])


def read_voc_xml(spark: SparkSession, ids: DataFrame, root: str, classes: Sequence[str], **options) -> tuple[DataFrame, DataFrame]:
    files = spark.read.text(f"{root}/Annotations/*.xml", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1).alias("name"), F.col("value").alias("xml"))
    return parse_voc(files.join(ids.select(F.col("id").alias("name")), "name", "left_semi"), classes, **options)


def read_voc_eval_xml(spark: SparkSession, ids: DataFrame, root: str, classes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return read_voc_xml(spark, ids, root, classes, evaluation=True)


COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>,"
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int,ignore:boolean>>,"
    "categories array<struct<id:int,name:string,supercategory:string>>"
)


def read_coco(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, anns, cats (with label 1.. in the order of category ids) of one or more documents.

    A document is cut into ranges of ``range_bytes``, which tasks read side by side, once for all three tables: what they find is written
    into the shared folder. Paths are those of :mod:`boxloom.sources.files`; :func:`read_coco_whole` reads what only Spark can open.
    """
    from boxloom.operators.tables import materialise
    from boxloom.sources import files

    files.register(spark)
    rows = materialise(spark.read.format("coco_objects").option("rangeBytes", range_bytes).load(path))
    images = rows.where("kind = 'image'").select(F.col("id").alias("image_id"), F.col("file_name").alias("filename"), "width", "height")
    anns = rows.where("kind = 'annotation'").select("id", "image_id", "category_id", "bbox", "area", "iscrowd", "ignore")
    return images, anns, _labelled(rows.where("kind = 'category'").select(F.col("id").cast("int").alias("id"), "name", "supercategory"))


def read_coco_whole(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`read_coco`, through Spark's own reader: one task a document."""
    j = spark.read.schema(COCO).json(path, multiLine=True)
    images = j.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("filename"), "i.width", "i.height")
    return images, j.select(F.explode("annotations").alias("a")).select("a.*"), _labelled(j.select(F.explode("categories").alias("c")).select("c.*"))


def _labelled(cats: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return cats.distinct().withColumn("label", F.dense_rank().over(Window.orderBy("id")))  # one row per category


def clean_coco_annotations(anns: DataFrame, cats: DataFrame) -> DataFrame:
    """Without ignored, empty and thin boxes; crowds are ignored truths."""
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    t = anns.where(~F.coalesce("ignore", F.lit(False)) & (F.col("area") > 0) & (w >= 1) & (h >= 1))
    t = t.join(F.broadcast(cats.select(F.col("id").alias("category_id"), "label")), "category_id")  # a row per category
    crowd = F.coalesce("iscrowd", F.lit(0)) == 1
    return t.select(F.col("id").alias("gt_id"), "image_id", "label", crowd.alias("is_ignore"), crowd.alias("is_crowd"), x.alias("x1"), y.alias("y1"), (x + w - 1).alias("x2"), (y + h - 1).alias("y2"))


def read_image_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_voc_dets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="image_id string, score double, x1 double, y1 double, x2 double, y2 double")


def read_coco_results(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.schema("image_id bigint, category_id int, bbox array<double>, score double").json(path, multiLine=True)
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    return t.select("image_id", "category_id", "score", x.alias("x1"), y.alias("y1"), (x + w - 1).alias("x2"), (y + h - 1).alias("y2"))


def read_train_logs(spark: SparkSession, path: str) -> DataFrame:
    """One run per file of JSON lines; columns are those that any line has."""
    if not path.endswith((".json", ".json/*", "*.json")):
        raise ValueError("logs are .json files")
    return spark.read.json(path).withColumn("run", F.input_file_name())


def parse_log_line(c) -> F.Column:
    """The line as a map of text, without its mode."""
    return F.map_filter(F.from_json(c, "map<string,string>"), lambda k, _: k != "mode")


def read_robustness(rows: DataFrame, column: str = "json") -> DataFrame:
    """distortion, severity, task, metric, value from nested maps."""
    m = F.from_json(column, "map<string,map<string,map<string,map<string,double>>>>")
    t = rows.select(F.explode(m).alias("distortion", "a")).select("distortion", F.explode("a").alias("severity", "b"))
    t = t.select("distortion", "severity", F.explode("b").alias("task", "c")).select("distortion", "severity", "task", F.explode("c").alias("metric", "value"))
    return t.withColumn("severity", F.col("severity").cast("int"))


def image_catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, length, width, height of the PNG files below a folder, from 24 bytes of each."""
    from boxloom.sources import files

    files.register(spark)
    return spark.read.format("png_headers").load(path)


def load_proposals(images: DataFrame, props: DataFrame, num_max: int) -> DataFrame:
    """The first ``num_max`` proposals of each image (by box_id); an image without any gets one box of zeros."""
    from boxloom.operators.windows import topk_per

    p = topk_per(props, ["image_id"], [F.asc("box_id")], num_max)
    out = images.select("image_id").join(p, "image_id", "left")
    return out.select("image_id", "box_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x1", "y1", "x2", "y2")])
