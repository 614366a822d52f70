"""All registered queries of the library, and their SQL. Outputs are rounded to 6 decimals in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.operators import assign, grids, logs, losses, match, metrics, nms, pairs, sampling
from boxloom.plans.fixtures import fixture, with_views
from boxloom.sources import readers, writers

XY = ["x1", "y1", "x2", "y2"]
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


def R(e: str, name: str) -> str:
    return f"round({e}, 6) AS {name}"


def iou_sql(a: str, b: str, off: int = 1) -> str:
    w = f"greatest(least({a}x2,{b}x2)-greatest({a}x1,{b}x1)+{off},0)"
    h = f"greatest(least({a}y2,{b}y2)-greatest({a}y1,{b}y1)+{off},0)"
    s = lambda p: f"(({p}x2-{p}x1+{off})*({p}y2-{p}y1+{off}))"
    return f"coalesce({w}*{h}/nullif({s(a)}+{s(b)}-{w}*{h},0),0)"


# ------------------------------------------------------------------ sources and sinks

ROI_SQL = """
SELECT image_id, 0 AS pos, 1 AS label, greatest(x1-10,0) AS x1, greatest(y1-20,0) AS y1,
  least(greatest(x1-10,0)+(x2-x1+1)-{k},600) AS x2, least(greatest(y1-20,0)+(y2-y1+1)-{k},400) AS y2 FROM fx_gts
"""


def _roi(spark, sf_dir, inclusive):
    rows = fixture(spark, sf_dir, "fx_roi_json").select(F.col("image_id").cast("string").alias("filename"), "json")
    _, gts = readers.parse_roi(rows, ["pos"], inclusive)
    return gts.select(F.col("filename").cast("long").alias("image_id"), "pos", "label", *XY)


@query(ROI_SQL.format(k=1))
def s1_roi_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roi(spark, sf_dir, True)


@query(ROI_SQL.format(k=0))
def s2_roi_json_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roi(spark, sf_dir, False)


def _voc_rows(spark, sf_dir):
    obj = F.format_string(
        "<object><name>c%d</name><pose>x</pose><truncated>0</truncated><difficult>%d</difficult><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>",
        F.col("label").cast("int"), F.col("is_ignore").cast("int"), *[F.col(c).cast("int") for c in XY],
    )
    g = fixture(spark, sf_dir, "fx_gts").groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gt_id", obj.alias("o")))), lambda x: x["o"]), "").alias("o"))
    xml = F.concat(F.lit("<annotation><folder>f</folder><size><width>600</width><height>500</height></size>"), "o", F.lit("</annotation>"))
    return g.select(F.col("image_id").cast("string").alias("name"), xml.alias("xml"))


VOC_SQL = """
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY gt_id) - 1 AS pos, label,
  is_ignore {small} AS is_ignore, x1-{k} AS x1, y1-{k} AS y1, x2-{k} AS x2, y2-{k} AS y2 FROM fx_gts
"""


@query(VOC_SQL.format(k=1, small="OR x2-x1 < 40 OR y2-y1 < 40"))
def s3_voc_xml(spark, sf_dir):
    _, g = readers.parse_voc(_voc_rows(spark, sf_dir), [f"c{i}" for i in range(1, 6)], min_size=40)
    return g.select(F.col("name").cast("long").alias("image_id"), "pos", "label", "is_ignore", *XY)


@query(VOC_SQL.format(k=0, small=""))
def s4_voc_xml_eval(spark, sf_dir):
    _, g = readers.parse_voc(_voc_rows(spark, sf_dir), [f"c{i}" for i in range(1, 6)], evaluation=True)
    return g.select(F.col("name").cast("long").alias("image_id"), "pos", "label", "is_ignore", *XY)


@query("SELECT image_id, concat('f/', image_id, '.jpg') AS filename, 600 AS width, 500 AS height FROM (SELECT DISTINCT image_id FROM fx_gts)")
def s5_wider_names(spark, sf_dir):
    i, _ = readers.parse_voc(_voc_rows(spark, sf_dir), ["c1"], folder_name=True)
    return i.select(F.col("name").cast("long").alias("image_id"), "filename", "width", "height")


def _coco_anns(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts")
    b = F.array("x1", "y1", F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1)
    anns = g.select(F.col("gt_id").alias("id"), "image_id", (F.col("label") * 10).cast("int").alias("category_id"), b.alias("bbox"), ((F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)).alias("area"), F.col("is_crowd").cast("int").alias("iscrowd"), F.col("is_ignore").alias("ignore"))
    cats = g.select((F.col("label") * 10).cast("int").alias("id"), F.col("label").cast("int").alias("label")).distinct()
    return anns, cats


@query("SELECT gt_id, image_id, label, is_crowd AS is_ignore, is_crowd, x1, y1, x2, y2 FROM fx_gts WHERE NOT is_ignore")
def f3_clean_coco(spark, sf_dir):
    return readers.clean_coco_annotations(*_coco_anns(spark, sf_dir))


@query("""
WITH i AS (SELECT c_custkey AS image_id FROM customer),
p AS (SELECT image_id, gt_id AS box_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY image_id ORDER BY gt_id) AS rn FROM fx_gts)
SELECT i.image_id, box_id, coalesce(x1,0) AS x1, coalesce(y1,0) AS y1, coalesce(x2,0) AS x2, coalesce(y2,0) AS y2
FROM i LEFT JOIN p ON p.image_id = i.image_id AND rn <= 5
""")
def s13_load_proposals(spark, sf_dir):
    images = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("image_id"))
    return readers.load_proposals(images, fixture(spark, sf_dir, "fx_gts").select("image_id", F.col("gt_id").alias("box_id"), *XY), 5)


@query("""
SELECT corruption, severity, round(ap, 6) AS value FROM fx_corruption
""")
def s11_robustness_maps(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_corruption")
    inner = F.create_map(F.lit("bbox"), F.create_map(F.lit("AP"), F.col("ap")))
    m = c.groupBy("corruption").agg(F.map_from_entries(F.collect_list(F.struct(F.col("severity").cast("string"), inner))).alias("m"))
    m = m.select(F.to_json(F.create_map(F.col("corruption").cast("string"), F.col("m"))).alias("json"))
    return readers.read_robustness(m).select(F.col("distortion").cast("long").alias("corruption"), F.col("severity").cast("long").alias("severity"), *r6("value"))


@query("""
SELECT image_id, count(*) AS n, CAST(sum(CAST(trunc(x1) AS BIGINT)) AS BIGINT) AS sx, CAST(sum(CAST(trunc(y1) AS BIGINT)) AS BIGINT) AS sy,
  CAST(sum(greatest(CAST(trunc(x2-x1) AS BIGINT),1)) AS BIGINT) AS sw, CAST(sum(greatest(CAST(trunc(y2-y1) AS BIGINT),1)) AS BIGINT) AS sh, round(max(score),6) AS top
FROM fx_dets GROUP BY image_id
""")
def k1_submission_json(spark, sf_dir):
    j = writers.to_submission_json(fixture(spark, sf_dir, "fx_dets"))
    o = j.select("image_id", F.explode(F.from_json("json", "array<struct<x:int,y:int,w:int,h:int,p:double>>")).alias("o"))
    return o.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("o.x").alias("sx"), F.sum("o.y").alias("sy"), F.sum("o.w").alias("sw"), F.sum("o.h").alias("sh"), F.round(F.max("o.p"), 6).alias("top"))


@query("""
SELECT det_id, concat('a.b/', image_id, ' ', printf('%.4f', score), ' ', CAST(x1 AS BIGINT), ' ', CAST(y1 AS BIGINT), ' ', CAST(x2 AS BIGINT), ' ', CAST(y2 AS BIGINT)) AS line FROM fx_dets
""")
def k2_voc_lines(spark, sf_dir):
    return writers.to_voc_lines(fixture(spark, sf_dir, "fx_dets").withColumn("filename", F.concat(F.lit("a.b/"), "image_id", F.lit(".png"))))


K3 = "SELECT det_id, image_id, {cat} AS category_id, x1, y1, x2-x1+1 AS w, y2-y1+1 AS h, round(score,6) AS score FROM fx_dets"


def _coco_row(t):
    return t.select("det_id", "image_id", "category_id", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "w", "h"))], *r6("score"))


@query(K3.format(cat="label*10"))
def k3_det2coco(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets")
    cats = d.select("label").distinct().withColumn("category_id", F.col("label") * 10)
    return _coco_row(writers.results2json("bbox", d, cats)["bbox"])


@query(K3.format(cat="1"))
def k4_proposal2coco(spark, sf_dir):
    return _coco_row(writers.results2json("proposal", fixture(spark, sf_dir, "fx_dets"))["proposal"])


@query("SELECT det_id, image_id, label*10 AS category_id, round(CASE WHEN det_id % 3 = 0 THEN score / 2 ELSE score END, 6) AS score FROM fx_dets")
def k5_segm2coco(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").withColumn("mask_score", F.when(F.col("det_id") % 3 == 0, F.col("score") / 2)).withColumn("segmentation", F.lit(None).cast("string"))
    cats = d.select("label").distinct().withColumn("category_id", F.col("label") * 10)
    return writers.results2json("segm", d, cats)["segm"].select("det_id", "image_id", "category_id", *r6("score"))


@query("""
SELECT image_id, row_number() OVER (PARTITION BY image_id, is_ignore ORDER BY gt_id) - 1 AS pos, is_ignore, label, x1, y1, x2, y2 FROM fx_gts
""")
def k8_nest_and_flatten(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts")
    return writers.flatten_annotations(writers.nest_annotations(g.select("image_id").distinct(), g))


@query("""
WITH i AS (SELECT DISTINCT image_id FROM fx_gts), n AS (SELECT image_id, label, count(*) AS n FROM fx_dets GROUP BY 1, 2)
SELECT i.image_id, l.label, coalesce(n.n, 0) AS n FROM i CROSS JOIN (SELECT unnest(range(0, 7)) AS label) l LEFT JOIN n ON n.image_id = i.image_id AND n.label = l.label
""")
def k9_by_class(spark, sf_dir):
    images = fixture(spark, sf_dir, "fx_gts").select("image_id").distinct()
    return writers.by_class(images, fixture(spark, sf_dir, "fx_dets"), range(7)).select("image_id", "label", F.col("n").cast("long").alias("n"))


# ------------------------------------------------------------------ filters and geometry


@query("SELECT image_id, width, height, CASE WHEN width > height THEN 1 ELSE 0 END AS flag FROM fx_slides WHERE least(width, height) >= 1000")
def f1_f10_filter_images(spark, sf_dir):
    s = readers.filter_small_images(fixture(spark, sf_dir, "fx_slides"), 1000)
    return s.withColumn("flag", G.aspect_flag(F.col("width"), F.col("height")))


@query("SELECT image_id, count(*) AS n FROM fx_gts GROUP BY image_id HAVING count(*) FILTER (WHERE NOT is_ignore AND label = 1) > 0")
def f2_f4_images_with_truths(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts")
    n = g.groupBy("image_id").agg(F.count("*").alias("n"))
    return pairs.semi_images(n, g.where("NOT is_ignore AND label = 1"))


@query("SELECT pred_id, CASE WHEN s1 >= s2 THEN 1 ELSE 2 END AS label, round(greatest(s1, s2), 6) AS score FROM fx_raw_preds WHERE greatest(s1, s2) > 0.3")
def f7_f8_best_class(spark, sf_dir):
    return G.confident(fixture(spark, sf_dir, "fx_raw_preds"), F.array("s1", "s2"), 0.3).select("pred_id", "label", *r6("score"))


@query("SELECT det_id, x1 >= 5 AND y1 >= 5 AND x2 < 395 AND y2 < 295 AS inside, x2-x1+1 >= 40 AND y2-y1+1 >= 40 AS large FROM fx_dets")
def f9_f11_flags(spark, sf_dir):
    b = G.box()
    return fixture(spark, sf_dir, "fx_dets").select("det_id", ((b.x1 >= 5) & (b.y1 >= 5) & (b.x2 < 395) & (b.y2 < 295)).alias("inside"), G.large_flag(b, 40).alias("large"))


PAIR = "SELECT d.det_id, g.gt_id, {e} AS iou FROM fx_dets d JOIN fx_gts g ON d.image_id = g.image_id AND d.label = g.label WHERE {i} > 0"


@query(PAIR.format(e=f"round({iou_sql('d.', 'g.')}, 6)", i=iou_sql("d.", "g.")))
def j1_g2_iou_pairs(spark, sf_dir):
    return pairs.iou_pairs(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts")).select("det_id", "gt_id", *r6("iou"))


@query(f"SELECT a.det_id, b.det_id AS gt_id, round({iou_sql('a.', 'b.')}, 6) AS iou FROM fx_dense a JOIN fx_dense b ON a.image_id = b.image_id AND a.det_id < b.det_id WHERE {iou_sql('a.', 'b.')} > 0.3")
def j2_overlap_join(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dense")
    p = pairs.iou_pairs(d.drop("score"), d.drop("score").withColumnRenamed("det_id", "gt_id"), ["image_id"], 0.3, cell=64.0)
    return p.where("det_id < gt_id").select("det_id", "gt_id", *r6("iou"))


@query(f"""
SELECT gt_id, {R('(x2-x1+1)*(y2-y1+1)', 'area')}, 399-x2 AS fx1, 399-x1 AS fx2, 299-y2 AS fy1, 299-y1 AS fy2,
  least(greatest(floor(log2(sqrt((x2-x1+1)*(y2-y1+1))/20+0.000001)),0),3)::INT AS level,
  {R('least(greatest(x1*0.7,0),299)', 'rx1')}, {R('least(greatest(y2*0.7,0),239)', 'ry2')}, x2-x1+1 AS w, y2-y1+1 AS h,
  {R('sqrt(least(x1+1,x2+1)/greatest(x1+1,x2+1)*least(y1+1,y2+1)/greatest(y1+1,y2+1))', 'centre')}
FROM fx_gts
""")
def g1_g18_scalars(spark, sf_dir):
    b, g = G.box(), fixture(spark, sf_dir, "fx_gts")
    w, h = F.lit(400.0), F.lit(300.0)
    f, v, r = G.flip_box(b, w, h), G.flip_box(b, w, h, "vertical"), G.resize_box(b, F.lit(0.7), F.lit(0.7), F.lit(300.0), F.lit(240.0))
    xywh = G.xyxy2xywh(b)
    one = F.lit(1.0)
    return g.select(
        "gt_id", F.round(G.area(b), 6).alias("area"), f.x1.alias("fx1"), f.x2.alias("fx2"), v.y1.alias("fy1"), v.y2.alias("fy2"), G.roi_level(b, 20).alias("level"),
        F.round(r.x1, 6).alias("rx1"), F.round(r.y2, 6).alias("ry2"), xywh[2].alias("w"), xywh[3].alias("h"), F.round(G.centerness(b.x1 + one, b.y1 + one, b.x2 + one, b.y2 + one), 6).alias("centre"),
    )


DELTA = "((gx1+gx2)/2-(x1+x2)/2)/(x2-x1+1)"


@query(f"""
WITH p AS (SELECT d.det_id, d.x1, d.y1, d.x2, d.y2, g.gt_id, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2 FROM fx_dets d JOIN fx_gts g ON CAST(floor(d.det_id/CAST(3 AS DOUBLE)) AS BIGINT) = g.gt_id)
SELECT det_id, {R(DELTA, 'dx')}, {R(DELTA.replace('x', 'y'), 'dy')}, {R('ln((gx2-gx1+1)/(x2-x1+1))', 'dw')}, {R('ln((gy2-gy1+1)/(y2-y1+1))', 'dh')},
  gx1 AS bx1, gy1 AS by1, gx2 AS bx2, gy2 AS by2 FROM p WHERE x2 >= x1 AND y2 >= y1
""")
def g6_g7_deltas(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts").select(F.col("gt_id"), *[F.col(c).alias("g" + c) for c in XY])
    d = fixture(spark, sf_dir, "fx_dets").withColumn("gt_id", F.floor(F.col("det_id") / 3.0)).join(g, "gt_id").where("x2 >= x1 AND y2 >= y1")
    dl = G.bbox2delta(G.box(), G.box("g"))
    back = G.delta2bbox(G.box(), dl)
    return d.select("det_id", *[F.round(c, 6).alias(n) for c, n in zip(dl, ("dx", "dy", "dw", "dh"), strict=True)], *[F.round(c, 6).alias("b" + n) for c, n in zip(back, XY, strict=True)])


# ------------------------------------------------------------------ grids

TILES_SQL = """
WITH n AS (SELECT image_id, width, height, CAST(ceil((width-800)/CAST(800 AS DOUBLE)) AS BIGINT)+1 AS nx, CAST(ceil((height-800)/CAST(800 AS DOUBLE)) AS BIGINT)+1 AS ny FROM fx_slides),
t AS (SELECT *, unnest(range(0, nx)) AS i FROM n WHERE ny > 0), u AS (SELECT *, unnest(range(0, ny)) AS j FROM t)
SELECT image_id, i*ny+j AS tile_idx, CASE WHEN i = nx-1 THEN width-800 ELSE i*800 END AS x, CASE WHEN j = ny-1 THEN height-800 ELSE j*800 END AS y,
  width < 800 OR height < 800 AS short_side FROM u
"""


@query(TILES_SQL)
def t1_t2_tile_plan(spark, sf_dir):
    return grids.tile_plan(fixture(spark, sf_dir, "fx_slides"))


def _axis_sql(v: str) -> str:
    n = f"(CAST(ceil(({v}-800)/CAST(800 AS DOUBLE)) AS BIGINT)+1)"
    return f"""CASE WHEN {v}%800 < 400 THEN [CAST(floor(({v}%800)/2.0) AS BIGINT)+q*800 FOR q IN range(0, {v}//800)]
      ELSE [CASE WHEN q = {n}-1 THEN {v}-800 ELSE q*800 END FOR q IN range(0, {n})] END"""


@query(f"""
WITH a AS (SELECT image_id, width, height, {_axis_sql('width')} AS xs, {_axis_sql('height')} AS ys FROM fx_slides),
t AS (SELECT *, unnest(range(0, len(xs))) AS i FROM a), u AS (SELECT *, unnest(range(0, len(ys))) AS j FROM t)
SELECT image_id, i*len(ys)+j AS tile_idx, xs[i+1] AS x, ys[j+1] AS y, width < 800 OR height < 800 AS short_side FROM u
""")
def t3_tile_plan_drop(spark, sf_dir):
    return grids.tile_plan(fixture(spark, sf_dir, "fx_slides"), drop_pixel=400)


@query(TILES_SQL.replace("SELECT image_id, i*ny+j", ", v AS (SELECT image_id, i*ny+j").rstrip() + """)
SELECT image_id, tile_idx, (row_number() OVER (ORDER BY image_id, tile_idx)-1)//8 AS batch, (row_number() OVER (ORDER BY image_id, tile_idx)-1)%8 AS slot FROM v""")
def t4_tile_batches(spark, sf_dir):
    return grids.pack_batches(grids.tile_plan(fixture(spark, sf_dir, "fx_slides")), 8).select("image_id", "tile_idx", "batch", "slot")


ANCHOR_SQL = """
base AS (SELECT lv AS level, s, ri*3+si AS anchor, s*sc/sqrt(ra) AS w, s*sc*sqrt(ra) AS h, (s-1)*0.5 AS c
  FROM (SELECT unnest([0,1,2,3,4]) AS lv, unnest([8.0::DOUBLE,16,32,64,128]) AS s) l,
  (SELECT unnest([0,1,2]) AS ri, unnest([0.5::DOUBLE,1,2]) AS ra) r, (SELECT unnest([0,1,2]) AS si, unnest([4.0::DOUBLE,5.0397,6.3496]) AS sc) z),
lev AS (SELECT level, s, CAST(ceil(800/s) AS BIGINT) AS f FROM (SELECT DISTINCT level, s FROM base)),
start AS (SELECT level, s, f, coalesce(sum(f*f*9) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS st FROM lev),
cell AS (SELECT *, unnest(range(0, f)) AS row FROM start), cell2 AS (SELECT *, unnest(range(0, f)) AS col FROM cell),
anchors AS (SELECT CAST(st+(row*f+col)*9+anchor AS BIGINT) AS anchor_idx, b.level,
  round_even(c-(w-1)*0.5,0)+col*b.s AS ax1, round_even(c-(h-1)*0.5,0)+row*b.s AS ay1, round_even(c+(w-1)*0.5,0)+col*b.s AS ax2, round_even(c+(h-1)*0.5,0)+row*b.s AS ay2
  FROM cell2 JOIN base b ON b.level = cell2.level)
"""


@query(f"""
WITH {ANCHOR_SQL}, p AS (SELECT r.*, a.*, greatest(s1,s2) AS score FROM fx_raw_preds r JOIN anchors a ON r.anchor_idx = a.anchor_idx WHERE greatest(s1,s2) > 0.05),
d AS (SELECT pred_id, level, score, (ax1+ax2)*0.5+(ax2-ax1+1)*dx AS gx, (ay1+ay2)*0.5+(ay2-ay1+1)*dy AS gy, (ax2-ax1+1)*exp(dw) AS gw, (ay2-ay1+1)*exp(dh) AS gh FROM p)
SELECT pred_id, level, round(score,6) AS score, {R('least(greatest(gx-gw*0.5+0.5,0),799)', 'x1')}, {R('least(greatest(gy-gh*0.5+0.5,0),799)', 'y1')},
  {R('least(greatest(gx+gw*0.5-0.5,0),799)', 'x2')}, {R('least(greatest(gy+gh*0.5-0.5,0),799)', 'y2')} FROM d
""")
def t6_t7_j3_decode(spark, sf_dir):
    raw = fixture(spark, sf_dir, "fx_raw_preds").withColumn("score", F.greatest("s1", "s2")).where("score > 0.05")
    j = pairs.decode_join(raw, grids.anchor_grid(spark, 800, 800))
    b = G.delta2bbox(G.box("a_"), [F.col(c) for c in ("dx", "dy", "dw", "dh")], max_w=800, max_h=800)
    return j.select("pred_id", "level", *r6("score"), *[F.round(c, 6).alias(n) for c, n in zip(b, XY, strict=True)])


@query("""
SELECT image_id, long_side, short_side, flip FROM fx_slides, (SELECT unnest([1333, 800]) AS long_side, unnest([800, 600]) AS short_side) s, (SELECT unnest([false, true]) AS flip) f
""")
def t10_tta_plan(spark, sf_dir):
    return grids.tta_plan(fixture(spark, sf_dir, "fx_slides"), [(1333, 800), (800, 600)], True).select("image_id", "long_side", "short_side", "flip")


# ------------------------------------------------------------------ joins

WIN = "(SELECT image_id, 100.0::DOUBLE AS wx1, 80.0::DOUBLE AS wy1, 300.0::DOUBLE AS wx2, 260.0::DOUBLE AS wy2 FROM (SELECT DISTINCT image_id FROM fx_gts))"
CLIP = "least(greatest({v}-{lo},0),{hi}-{lo}) AS {v}"
CLIPS = ", ".join(CLIP.format(v=v, lo="w" + v[0] + "1", hi="w" + v[0] + "2") for v in XY)
COV = "greatest(least(x2,wx2)-greatest(x1,wx1),0)*greatest(least(y2,wy2)-greatest(y1,wy1),0)/greatest((x2-x1)*(y2-y1),0.000001)"


def _windows(spark, sf_dir):
    i = fixture(spark, sf_dir, "fx_gts").select("image_id").distinct()
    return i.select("image_id", *[F.lit(v).alias(n) for n, v in (("wx1", 100.0), ("wy1", 80.0), ("wx2", 300.0), ("wy2", 260.0))])


@query(f"SELECT gt_id, {CLIPS} FROM fx_gts JOIN {WIN} USING (image_id) WHERE {COV} > 0.5")
def j7_crop_boxes(spark, sf_dir):
    return pairs.crop_boxes(_windows(spark, sf_dir), fixture(spark, sf_dir, "fx_gts")).select("gt_id", *XY)


@query(f"SELECT * FROM (SELECT gt_id, {CLIPS} FROM fx_gts JOIN {WIN} USING (image_id)) WHERE x2 > x1 AND y2 > y1")
def j9_crop_any(spark, sf_dir):
    return pairs.crop_boxes_any(_windows(spark, sf_dir), fixture(spark, sf_dir, "fx_gts")).select("gt_id", *XY)


@query(f"""
WITH tiles AS ({TILES_SQL.replace('WITH n AS', 'WITH n AS', 1)}), w AS (SELECT image_id, tile_idx, x::DOUBLE AS wx1, y::DOUBLE AS wy1, x+800.0::DOUBLE AS wx2, y+800.0::DOUBLE AS wy2 FROM tiles),
g AS (SELECT gt_id, image_id, x1*8 AS x1, y1*8 AS y1, x2*8 AS x2, y2*8 AS y2 FROM fx_gts)
SELECT tile_idx, gt_id, {CLIPS} FROM g JOIN w USING (image_id) WHERE {COV} > 0.5
""")
def j8_truths_to_tiles(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts").select("gt_id", "image_id", *[(F.col(c) * 8).alias(c) for c in XY])
    slides = pairs.semi_images(fixture(spark, sf_dir, "fx_slides"), g.select("image_id").distinct().hint("merge"))  # before they have tiles
    return pairs.gts_to_tiles(grids.tile_plan(slides), g).select("tile_idx", "gt_id", *XY)


IOF = "greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1)+1,0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1)+1,0)/nullif((d.x2-d.x1+1)*(d.y2-d.y1+1),0)"


@query(f"""
SELECT d.det_id, {R(f'max(coalesce({IOF},0))', 'max_iof')}, max(coalesce({IOF},0)) > 0.5 AS excluded
FROM fx_dets d LEFT JOIN (SELECT * FROM fx_gts WHERE is_ignore) g ON d.image_id = g.image_id GROUP BY d.det_id
""")
def j5_ignore_regions(spark, sf_dir):
    return pairs.ignore_mask(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts").where("is_ignore"), 0.5).select("det_id", *r6("max_iof"), "excluded")


@query("SELECT i.image_id, d.det_id FROM (SELECT DISTINCT image_id FROM fx_gts) i LEFT JOIN (SELECT * FROM fx_dets WHERE score > 0.97) d USING (image_id)")
def j11_empty_images(spark, sf_dir):
    return pairs.with_empty_images(fixture(spark, sf_dir, "fx_gts").select("image_id").distinct(), fixture(spark, sf_dir, "fx_dets").where("score > 0.97").select("image_id", "det_id"))


@query("SELECT DISTINCT image_id FROM fx_gts WHERE image_id NOT IN (SELECT image_id FROM fx_dets WHERE score > 0.97)")
def j12_images_without(spark, sf_dir):
    return pairs.anti_images(fixture(spark, sf_dir, "fx_gts").select("image_id").distinct(), fixture(spark, sf_dir, "fx_dets").where("score > 0.97"))


# ------------------------------------------------------------------ suppression


def nms_sql(src: str, keys: str, thr: float, cmp: str = ">", off: int = 1) -> str:
    on = " AND ".join(f"r.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    return f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, det_id) AS rn FROM {src}),
r AS (SELECT {ks}, d.rn, [{{'det_id': d.det_id, 'score': d.score, 'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2}}] AS kept FROM d WHERE rn = 1
  UNION ALL SELECT {ks}, d.rn, CASE WHEN len([k FOR k IN r.kept IF {iou_sql('k.', 'd.', off)} {cmp} {thr}]) > 0 THEN r.kept
    ELSE list_append(r.kept, {{'det_id': d.det_id, 'score': d.score, 'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2}}) END
  FROM r JOIN d ON {on} AND d.rn = r.rn + 1),
top AS (SELECT {keys}, arg_max(kept, rn) AS kept FROM r GROUP BY {keys}),
kept AS (SELECT {keys}, unnest(kept) AS k FROM top)"""


@query(nms_sql("fx_dets", "image_id, label", 0.5) + " SELECT image_id, label, k.det_id AS det_id, round(k.score,6) AS score FROM kept")
def n1_greedy_nms(spark, sf_dir):
    return nms.nms(fixture(spark, sf_dir, "fx_dets"), ["image_id", "label"], 0.5).select("image_id", "label", "det_id", *r6("score"))


@query(nms_sql("fx_dense", "image_id", 0.5) + " SELECT image_id, k.det_id AS det_id, round(k.score,6) AS score FROM kept")
def n1_dense_nms(spark, sf_dir):
    return nms.nms(fixture(spark, sf_dir, "fx_dense"), ["image_id"], 0.5, engine="rounds").select("image_id", "det_id", *r6("score"))


@query(nms_sql("fx_dets", "image_id, label", 0.3, ">=") + " SELECT image_id, label, k.det_id AS det_id, round(k.score,6) AS score FROM kept")
def n2_toolbox_nms(spark, sf_dir):
    return nms.nms(fixture(spark, sf_dir, "fx_dets"), ["image_id", "label"], 0.3, cmp="ge").select("image_id", "label", "det_id", *r6("score"))


@query(nms_sql("(SELECT * FROM fx_dets WHERE score > 0.2)", "image_id, label", 0.5) + """,
f AS (SELECT image_id, label - 1 AS label, k.det_id AS det_id, k.score AS score, row_number() OVER (PARTITION BY image_id ORDER BY k.score DESC, label, k.det_id) AS rn FROM kept)
SELECT image_id, label, det_id, round(score,6) AS score FROM f WHERE rn <= 10""")
def n3_multiclass_nms(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").withColumn("label", F.col("label").cast("int"))
    scores = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i == F.col("label"), F.col("score")).otherwise(F.lit(0.0)))
    t = nms.multiclass_nms(d.select("image_id", F.col("det_id").alias("box_id"), *XY, scores.alias("scores")), 0.2, 0.5, 10)
    return t.select("image_id", "label", "det_id", *r6("score"))


@query()
def n4_soft_nms(spark, sf_dir):
    return nms.soft_nms(fixture(spark, sf_dir, "fx_dets"), ["image_id", "label"], 0.3).select("image_id", "label", "det_id", *r6("score"))


@query()
def n5_bbox_voting(spark, sf_dir):
    return nms.bbox_voting(fixture(spark, sf_dir, "fx_dets"), ["image_id", "label"], 0.5).select("image_id", "label", "det_id", "members", *r6("score", *XY))


TILE_SRC = "(SELECT image_id, CAST(floor(x1/800)*800 AS BIGINT) AS tile_x, CAST(floor(y1/800)*800 AS BIGINT) AS tile_y, det_id, score, x1-floor(x1/800)*800 AS x1, y1-floor(y1/800)*800 AS y1, x2-floor(x1/800)*800 AS x2, y2-floor(y1/800)*800 AS y2 FROM fx_dense)"


def _tile_dets(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dense")
    tx, ty = (F.floor(F.col(c) / 800) * 800 for c in ("x1", "y1"))
    return d.select("image_id", tx.alias("tile_x"), ty.alias("tile_y"), "det_id", "score", *[(F.col(c) - (tx if c[0] == "x" else ty)).alias(c) for c in XY])


def _merge_sql() -> str:
    first = nms_sql(TILE_SRC, "image_id, tile_x, tile_y", 0.5)
    second = nms_sql("merged", "image_id", 0.5).replace("WITH RECURSIVE d AS", "d2 AS").replace(" d ", " d2 ").replace("d.", "d2.").replace("r AS (", "r2 AS (").replace("FROM r ", "FROM r2 ").replace("r.", "r2.").replace("top AS", "top2 AS").replace("FROM top", "FROM top2").replace("kept AS (SELECT", "kept2 AS (SELECT").replace("JOIN d ", "JOIN d2 ")
    return f"""{first},
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, tile_x, tile_y ORDER BY k.score DESC, k.det_id) AS q FROM kept),
merged AS (SELECT image_id, k.det_id AS det_id, k.score AS score, k.x1+tile_x AS x1, k.y1+tile_y AS y1, k.x2+tile_x AS x2, k.y2+tile_y AS y2 FROM ranked WHERE q <= 100),
{second} SELECT image_id, k.det_id AS det_id, round(k.score,6) AS score FROM kept2"""


@query(_merge_sql())
def n6_merge_tiles(spark, sf_dir):
    return nms.merge_tiles(_tile_dets(spark, sf_dir), engine="numpy", image_engine="rounds").select("image_id", "det_id", *r6("score"))


@query("""
SELECT image_id, det_id AS box_idx, x1 AS x1, y1 AS y1, x2 AS x2, y2 AS y2, round((score + score/2)/2, 6) AS s FROM fx_dets
""")
def n10_merge_augmented(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").withColumn("box_idx", F.col("det_id"))
    plain = d.select("image_id", "box_idx", F.lit(800.0).alias("img_w"), F.lit(2.0).alias("scale"), F.lit(False).alias("flip"), *[(F.col(c) * 2).alias(c) for c in XY], F.array("score").alias("scores"))
    m = G.map_box(G.box(), F.lit(800.0), F.lit(2.0), F.lit(True))
    mirrored = d.select("image_id", "box_idx", F.lit(800.0).alias("img_w"), F.lit(2.0).alias("scale"), F.lit(True).alias("flip"), *G.named(m), F.array(F.col("score") / 2).alias("scores"))
    t = nms.merge_aug_bboxes(plain.unionByName(mirrored))
    return t.select("image_id", "box_idx", *r6(*XY), F.round(F.col("scores")[0], 6).alias("s"))


@query("SELECT image_id, label, det_id AS box_idx, round(avg(score * s), 6) AS score FROM fx_dets, (SELECT unnest([1.0::DOUBLE, 0.5, 0.25]) AS s) GROUP BY 1, 2, 3")
def n12_cascade_ensemble(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").withColumn("s", F.explode(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25))))
    return nms.ensemble_scores(d.select("image_id", "label", F.col("det_id").alias("box_idx"), (F.col("score") * F.col("s")).alias("score"))).select("image_id", "label", "box_idx", *r6("score"))


# ------------------------------------------------------------------ matching and metrics


def match_sql(cmp: str = ">", thr: float = 0.5) -> str:
    i = iou_sql("d.", "g.")
    return f"""p AS (SELECT d.det_id, g.gt_id, g.is_ignore, {i} AS iou FROM fx_dets d JOIN fx_gts g ON d.image_id = g.image_id AND d.label = g.label WHERE {i} > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS rn FROM p),
h AS (SELECT d.*, b.gt_id, coalesce(b.iou,0) AS iou, coalesce(b.iou {cmp} {thr}, false) AS hit, coalesce(b.is_ignore, false) AS ign FROM fx_dets d LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (det_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY gt_id, hit ORDER BY score DESC, det_id) AS q FROM h),
m AS (SELECT *, CASE WHEN hit AND NOT ign AND q = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN hit AND (ign OR q = 1) THEN 0 ELSE 1 END AS fp FROM k)"""


CURVE_SQL = """n AS (SELECT label, count(*) FILTER (WHERE NOT is_ignore) AS n_gts FROM fx_gts GROUP BY label),
c AS (SELECT m.label, det_id, score, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, n_gts FROM m JOIN n ON n.label = m.label WINDOW w AS (PARTITION BY m.label ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT label, det_id, score, ctp/n_gts AS recall, ctp/(ctp+cfp) AS precision FROM (SELECT label, det_id, score, ctp::DOUBLE AS ctp, greatest(cfp, CASE WHEN ctp = 0 THEN 1e-300 ELSE 0 END)::DOUBLE AS cfp, greatest(n_gts,1e-300)::DOUBLE AS n_gts FROM c)),
e AS (SELECT label, recall - lag(recall, 1, 0) OVER w AS step, max(precision) OVER (PARTITION BY label ORDER BY score DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM pr WINDOW w AS (PARTITION BY label ORDER BY score DESC, det_id)),
ap AS (SELECT label, sum(step*env) AS ap FROM e GROUP BY label)"""


@query(f"WITH {match_sql()} SELECT det_id, gt_id, {R('iou', 'iou')}, tp, fp FROM m")
def a1_match_voc(spark, sf_dir):
    m = match.match_voc(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts"))
    return m.select("det_id", "gt_id", *r6("iou"), "tp", "fp")


A2_SQL = f"""
WITH rs AS (SELECT unnest([0,1,2]) AS range_idx, unnest([0.0::DOUBLE,0,2500]) AS lo, unnest([1e10::DOUBLE,2500,1e10]) AS hi),
g2 AS (SELECT *, (x2-x1+1)*(y2-y1+1) AS ga FROM fx_gts),
p AS (SELECT d.det_id, g.gt_id, g.is_ignore, g.ga, {iou_sql('d.', 'g.')} AS iou FROM fx_dets d JOIN g2 g ON d.image_id = g.image_id AND d.label = g.label WHERE {iou_sql('d.', 'g.')} > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) AS rn FROM p),
h AS (SELECT d.*, range_idx, lo, hi, b.gt_id, coalesce(b.iou >= 0.5, false) AS hit, coalesce(b.is_ignore OR NOT (ga >= lo AND ga < hi), false) AS off, (d.x2-d.x1+1)*(d.y2-d.y1+1) AS da
  FROM fx_dets d CROSS JOIN rs LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (det_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY range_idx, gt_id, hit ORDER BY score DESC, det_id) AS q FROM h)
SELECT range_idx, det_id, CASE WHEN hit AND NOT off AND q = 1 THEN 1 ELSE 0 END AS tp,
  CASE WHEN hit THEN CASE WHEN NOT off AND q > 1 THEN 1 ELSE 0 END WHEN da >= lo AND da < hi THEN 1 ELSE 0 END AS fp FROM k
"""


@query(A2_SQL)
def a2_match_default(spark, sf_dir):
    m = match.match_default(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts"), 0.5, [(0, 1e10), (0, 2500), (2500, 1e10)])
    return m.select("range_idx", "det_id", "tp", "fp")


@query()
def a3_match_imagenet(spark, sf_dir):
    return match.match_imagenet(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts"))


@query()
def a4_match_coco(spark, sf_dir):
    return match.match_coco(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts"), [0.5, 0.75])


@query()
def a5_match_recall(spark, sf_dir):
    return match.match_recall(fixture(spark, sf_dir, "fx_gts"), fixture(spark, sf_dir, "fx_dets"), [10, 30])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how good are these tiled detections? Score filter, two-stage suppression, matching, curve, area."""
    d = fixture(spark, sf_dir, "fx_dets").where("score > 0.05")
    side = 200  # each box belongs to the tile of its upper left corner
    tile = d.select("image_id", F.floor(F.col("x1") / side).alias("tile_x"), F.floor(F.col("y1") / side).alias("tile_y"), "label", "det_id", "score", *XY)
    kept = nms.nms(nms.nms(tile, ["image_id", "tile_x", "tile_y", "label"], 0.5, keep_top_k=100), ["image_id", "label"], 0.5)
    g = fixture(spark, sf_dir, "fx_gts")
    m = match.match_voc(kept.withColumn("one", F.lit(1)), g)
    n = g.agg(F.sum((~F.col("is_ignore")).cast("long")).alias("n_gts")).withColumn("one", F.lit(1))
    curve = metrics.pr_curve(m, n, ["one"], parts=8)
    ap = metrics.average_precision(curve, ["one"])
    last = curve.groupBy("one").agg(F.count("*").alias("n_dets"), F.round(F.max("recall"), 6).alias("recall"), F.round(F.max("ctp") / F.count("*"), 6).alias("hit_share"))
    return n.join(last, "one").join(ap, "one").select("n_gts", "n_dets", "recall", "hit_share", *r6("ap"))


@query()
def flagship_tiled_ap(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("SELECT label, count(*) FILTER (WHERE NOT is_ignore) AS n_gts FROM fx_gts GROUP BY label")
def m1_num_gts(spark, sf_dir):
    return metrics.num_gts(fixture(spark, sf_dir, "fx_gts"))


@query(f"WITH {match_sql()}, {CURVE_SQL} SELECT label, det_id, {R('recall', 'recall')}, {R('precision', 'precision')} FROM pr")
def m2_pr_curve(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts")
    c = metrics.pr_curve(match.match_voc(fixture(spark, sf_dir, "fx_dets"), g), metrics.num_gts(g), parts=8)
    return c.select("label", "det_id", *r6("recall", "precision"))


@query(f"WITH {match_sql()}, {CURVE_SQL} SELECT label, {R('ap', 'ap')} FROM ap")
def m3_average_precision(spark, sf_dir):
    return metrics.voc_ap(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts")).select("label", *r6("ap"))


@query(f"""WITH {match_sql()}, {CURVE_SQL}, t AS (SELECT unnest(range(0, 11)) AS i),
q AS (SELECT label, i, coalesce(max(precision) FILTER (WHERE recall >= i/10.0::DOUBLE), 0) AS p FROM pr, t GROUP BY 1, 2) SELECT label, round(sum(p)/11, 6) AS ap FROM q GROUP BY label""")
def m4_ap_11_points(spark, sf_dir):
    return metrics.voc_ap(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts"), mode="11points").select("label", *r6("ap"))


@query(f"WITH {match_sql('>=')}, {CURVE_SQL} SELECT 0 AS range_idx, round(avg(ap), 6) AS map FROM ap")
def m5_mean_ap(spark, sf_dir):
    return metrics.eval_map(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts")).select("range_idx", *r6("map"))


@query(f"""WITH {match_sql('>=')}, {CURVE_SQL},
last AS (SELECT label, count(*) AS n_dets, max(recall) AS recall, arg_min(precision, (score, -det_id)) AS precision FROM pr GROUP BY label),
t AS (SELECT n.label, n_gts, n_dets, recall, precision, ap FROM n JOIN last ON last.label = n.label JOIN ap ON ap.label = n.label)
SELECT label, n_gts, n_dets, round(recall,6) AS recall, round(precision,6) AS precision, round(ap,6) AS ap FROM t
UNION ALL SELECT NULL, sum(n_gts)::BIGINT, sum(n_dets)::BIGINT, NULL, NULL, round(avg(ap),6) FROM t""")
def m6_class_report(spark, sf_dir):
    return metrics.map_report(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts")).select("label", "n_gts", "n_dets", *r6("recall", "precision", "ap"))


@query()
def m7_recalls(spark, sf_dir):
    return metrics.eval_recalls(fixture(spark, sf_dir, "fx_gts"), fixture(spark, sf_dir, "fx_dets"), [10, 30]).select("num", "thr", *r6("recall"))


@query()
def m8_coco_metrics(spark, sf_dir):
    return metrics.coco_metrics(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts")).select("metric", *r6("value"))


@query()
def m9_coco_classwise(spark, sf_dir):
    return metrics.coco_classwise(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts")).select("label", *r6("ap100"))


@query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY run_id, epoch ORDER BY iter, event_id) AS rn FROM fx_logs WHERE mode = 'train'),
e AS (SELECT run_id, epoch, avg(time) AS m, sum(time) AS s, count(*) AS n FROM t WHERE rn > 1 GROUP BY 1, 2)
SELECT run_id, arg_max(epoch, (m, -epoch)) AS slowest_epoch, round(max(m),6) AS slowest, arg_min(epoch, (m, epoch)) AS fastest_epoch, round(min(m),6) AS fastest, round(stddev_pop(m),6) AS std, round(sum(s)/sum(n),6) AS mean FROM e GROUP BY run_id
""")
def m11_train_time(spark, sf_dir):
    return logs.train_time(fixture(spark, sf_dir, "fx_logs")).select("run_id", "slowest_epoch", "fastest_epoch", *r6("slowest", "fastest", "std", "mean"))


@query("""
WITH p AS (SELECT run_id, max(iter) AS per FROM fx_logs WHERE mode = 'train' AND epoch = 1 GROUP BY run_id)
SELECT run_id, event_id, iter+(epoch-1)*per AS x, round(time,6) AS value FROM fx_logs JOIN p USING (run_id) WHERE mode = 'train'
""")
def m12_learning_curve(spark, sf_dir):
    return logs.learning_curve(fixture(spark, sf_dir, "fx_logs"), "time").select("run_id", "event_id", "x", *r6("value"))


@query("""
WITH a AS (SELECT avg(ap) FILTER (WHERE severity = 0 AND corruption = 0) AS p, avg(ap) FILTER (WHERE severity >= 1 AND corruption < 15) AS mpc FROM fx_corruption)
SELECT round(p,6) AS p, round(mpc,6) AS mpc, round(mpc/p,6) AS rpc FROM a
""")
def m13_robustness(spark, sf_dir):
    return logs.robustness(fixture(spark, sf_dir, "fx_corruption")).select(*r6("p", "mpc", "rpc"))


@query("SELECT concat(mode, run_id) AS timer, round(avg(time),6) AS average, round(sum(time),6) AS total, count(*) AS calls, round(sum(time*epoch)/sum(epoch),6) AS weighted FROM fx_logs GROUP BY 1")
def m14_timing_report(spark, sf_dir):
    t = fixture(spark, sf_dir, "fx_logs").select(F.concat("mode", "run_id").alias("timer"), F.col("time").alias("seconds"), F.col("epoch").alias("n"))
    return logs.timing_report(t).select("timer", "calls", *r6("average", "total", "weighted"))


EMB = "e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS s, label % 64 AS label FROM embeddings)"


def _logits(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("scores"), (F.col("label") % 64).alias("label"))


@query(f"WITH {EMB}, b AS (SELECT len([x FOR x, i IN s IF x > s[label+1] OR (x = s[label+1] AND i < label+1)]) AS better FROM e) SELECT k, round(avg(CASE WHEN better < k THEN 100.0::DOUBLE ELSE 0 END),6) AS accuracy FROM b, (SELECT unnest([1,3,5]) AS k) GROUP BY k")
def m15_topk_accuracy(spark, sf_dir):
    return metrics.topk_accuracy(_logits(spark, sf_dir), (1, 3, 5)).select("k", *r6("accuracy"))


@query(f"WITH {EMB} SELECT label, round(avg(ln(list_sum([exp(x-list_max(s)) FOR x IN s]))+list_max(s)-s[label+1]),6) AS loss FROM e GROUP BY label")
def m16_cross_entropy(spark, sf_dir):
    e = _logits(spark, sf_dir)
    return losses.loss_report(e, losses.cross_entropy(F.col("scores"), F.col("label")), by=["label"]).select("label", *r6("loss"))


@query("""
WITH t AS (SELECT event_id % 7 AS grp, value/100 AS a, (event_id % 100)/50.0::DOUBLE AS b FROM events)
SELECT grp, round(avg(CASE WHEN abs(a-b) < 1 THEN (a-b)*(a-b)*0.5 ELSE abs(a-b)-0.5 END),6) AS smooth, round(avg((a-b)*(a-b)),6) AS mse FROM t GROUP BY grp
""")
def m16_regression_losses(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 7).alias("grp"), (F.col("value") / 100).alias("a"), ((F.col("event_id") % 100) / 50.0).alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.groupBy("grp").agg(F.round(F.avg(losses.smooth_l1(a, b)), 6).alias("smooth"), F.round(F.avg(losses.mse(a, b)), 6).alias("mse"))


@query("""
WITH t AS (SELECT pred_id, least(floor(abs(s1-(anchor_idx%2))*10),9)::INT AS bin FROM fx_raw_preds), c AS (SELECT bin, count(*) AS n FROM t GROUP BY bin)
SELECT pred_id, bin, round((sum(n) OVER () )::DOUBLE/(n*count(*) OVER ()),6) AS weight FROM t JOIN (SELECT bin, n, sum(n) OVER () AS total, count(*) OVER () AS used FROM c) c USING (bin)
""".replace("round((sum(n) OVER () )::DOUBLE/(n*count(*) OVER ()),6)", "round(total::DOUBLE/(n*used),6)"))
def m17_ghm_weights(spark, sf_dir):
    t = fixture(spark, sf_dir, "fx_raw_preds")
    w = losses.ghm_weights(t, losses.ghm_c(F.col("s1"), (F.col("anchor_idx") % 2).cast("double")))
    return w.select("pred_id", "bin", *r6("weight"))


@query("""
SELECT label, flag, count(*) AS boxes, count(DISTINCT image_id) AS images FROM (SELECT g.label, g.image_id, CASE WHEN width > height THEN 1 ELSE 0 END AS flag FROM fx_gts g JOIN fx_slides s USING (image_id)) GROUP BY CUBE (label, flag)
""")
def m18_dataset_stats(spark, sf_dir):
    return metrics.dataset_stats(fixture(spark, sf_dir, "fx_slides"), fixture(spark, sf_dir, "fx_gts")).drop("gid")


# ------------------------------------------------------------------ assignment and sampling

ASSIGN_SQL = f"""
p AS (SELECT d.image_id, d.det_id AS box_id, g.gt_id, {iou_sql('d.', 'g.')} AS iou FROM fx_dets d JOIN fx_gts g ON d.image_id = g.image_id),
q AS (SELECT *, max(iou) OVER (PARTITION BY image_id, gt_id) AS best FROM p),
a AS (SELECT image_id, box_id, max(iou) AS max_iou, arg_max(gt_id, (iou, -gt_id)) AS own, max(gt_id) FILTER (WHERE iou = best AND best >= 0.2) AS claimed FROM q GROUP BY 1, 2),
t AS (SELECT d.image_id, d.det_id AS box_id, coalesce(max_iou,0) AS max_iou, coalesce(claimed, CASE WHEN max_iou >= 0.5 THEN own END) AS gt_id FROM fx_dets d LEFT JOIN a ON a.box_id = d.det_id),
s AS (SELECT *, CASE WHEN gt_id IS NOT NULL THEN 1 WHEN max_iou < 0.4 THEN 0 ELSE -1 END AS assigned FROM t)
"""


def _assigned(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").select("image_id", F.col("det_id").alias("box_id"), *XY)
    return assign.assign_max_iou(d, fixture(spark, sf_dir, "fx_gts"), 0.5, 0.4, 0.2)


@query(f"WITH {ASSIGN_SQL} SELECT box_id, gt_id, round(max_iou,6) AS max_iou, assigned FROM s")
def a6_assign_max_iou(spark, sf_dir):
    return _assigned(spark, sf_dir).select("box_id", "gt_id", *r6("max_iou"), "assigned")


@query(f"WITH {ASSIGN_SQL} SELECT s.box_id, s.assigned, CASE WHEN s.assigned = 1 THEN g.label ELSE 0 END AS label, CASE WHEN s.assigned >= 0 THEN 1.0::DOUBLE ELSE 0 END AS label_weight, CASE WHEN s.assigned = 1 THEN 1.0::DOUBLE ELSE 0 END AS bbox_weight FROM s LEFT JOIN fx_gts g ON g.gt_id = s.gt_id")
def a15_anchor_targets(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").select("image_id", F.col("det_id").alias("box_id"), *XY).where("x2 >= x1 AND y2 >= y1")
    g = fixture(spark, sf_dir, "fx_gts")
    return assign.anchor_targets(assign.assign_max_iou(d, g, 0.5, 0.4, 0.2), g).select("box_id", "assigned", "label", "label_weight", "bbox_weight")


@query()
def a8_assign_points(spark, sf_dir):
    pts = grids.point_grid(spark, [(50, 50), (25, 25), (13, 13)], [8, 16, 32]).withColumn("level", F.col("level") + 3)
    return assign.assign_points(pts, fixture(spark, sf_dir, "fx_gts")).select("image_id", "point_idx", "gt_id", *r6("dist"))


@query("""
WITH lv AS (SELECT unnest([0,1]) AS level, unnest([8,16]) AS s, unnest([50,25]) AS f, unnest([0,2500]) AS st, unnest([-1.0::DOUBLE,64]) AS lo, unnest([64.0::DOUBLE,128]) AS hi),
r AS (SELECT *, unnest(range(0,f)) AS rr FROM lv), c AS (SELECT *, unnest(range(0,f)) AS cc FROM r),
pt AS (SELECT st+rr*f+cc AS point_idx, level, lo, hi, cc*s+s//2 AS x, rr*s+s//2 AS y FROM c),
j AS (SELECT image_id, gt_id, label, point_idx, x-x1 AS l, y-y1 AS t, x2-x AS r, y2-y AS b, (x2-x1+1)*(y2-y1+1) AS area, lo, hi FROM fx_gts JOIN pt ON x > x1 AND x < x2 AND y > y1 AND y < y2),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, point_idx ORDER BY area, gt_id) AS rn FROM j WHERE greatest(l,t,r,b) BETWEEN lo AND hi)
SELECT image_id, point_idx, gt_id, label, l, t, r, b FROM k WHERE rn = 1
""")
def a9_fcos_targets(spark, sf_dir):
    pts = grids.point_grid(spark, [(50, 50), (25, 25)], [8, 16], half_shift=True)
    return assign.fcos_targets(pts, fixture(spark, sf_dir, "fx_gts"))


LCG = "(({c})*7919+{s}*104729)%1000003"


@query(f"""WITH {ASSIGN_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY image_id, assigned ORDER BY {LCG.format(c='box_id', s=3)}, box_id) AS rn, sum(CASE WHEN assigned = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id) AS npos FROM s WHERE assigned >= 0)
SELECT image_id, box_id, assigned FROM u WHERE CASE WHEN assigned = 1 THEN rn <= least(npos, 4) ELSE rn <= 16-least(npos,4) END""")
def d5_sample_random(spark, sf_dir):
    return sampling.sample_random(_assigned(spark, sf_dir), 16, 0.25, seed=3).select("image_id", "box_id", "assigned")


@query(f"""WITH {ASSIGN_SQL}, u AS (SELECT s.*, d.score, row_number() OVER (PARTITION BY s.image_id, assigned ORDER BY d.score DESC, box_id) AS rn FROM s JOIN fx_dets d ON d.det_id = box_id WHERE assigned >= 0)
SELECT image_id, box_id, assigned FROM u WHERE rn <= 3""")
def d9_hard_examples(spark, sf_dir):
    a = _assigned(spark, sf_dir).join(fixture(spark, sf_dir, "fx_dets").select(F.col("det_id").alias("box_id"), F.col("score").alias("loss")), "box_id")
    return sampling.hard_examples(a, 3).select("image_id", "box_id", "assigned")


@query("SELECT gt_id, r AS repeat_idx, s AS source_idx FROM (SELECT gt_id, 0 AS s FROM fx_gts UNION ALL SELECT gt_id, 1 FROM fx_gts WHERE label = 1), (SELECT unnest([0,1,2]) AS r)")
def d1_d2_concat_repeat(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts").select("gt_id", "label")
    return sampling.repeat(sampling.concat([g, g.where("label = 1")]), 3).select("gt_id", "repeat_idx", "source_idx")


@query(f"""
WITH f AS (SELECT image_id, CASE WHEN width > height THEN 1 ELSE 0 END AS flag FROM fx_slides),
o AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY {LCG.format(c='image_id', s=2)}, image_id)-1 AS i, count(*) OVER (PARTITION BY flag) AS n FROM f),
t AS (SELECT *, CAST(ceil(n/32.0::DOUBLE) AS BIGINT)*32 AS total FROM o)
SELECT image_id, flag, p AS position, CAST(floor(p/(total/4.0::DOUBLE)) AS INT) AS shard FROM t, LATERAL (SELECT unnest(range(i, total, n)) AS p)
""")
def d12_epoch_shards(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_slides").withColumn("flag", G.aspect_flag(F.col("width"), F.col("height")))
    return sampling.epoch_shards(s.select("image_id", "flag"), 8, 4, 2).select("image_id", "flag", "position", "shard")


@query()
def d14_j7_crop_choice(spark, sf_dir):
    i = fixture(spark, sf_dir, "fx_gts").select("image_id").distinct().withColumn("width", F.lit(500)).withColumn("height", F.lit(400))
    w = sampling.choose_crops(i, fixture(spark, sf_dir, "fx_gts"), (200, 200), 5)
    return pairs.crop_boxes(w.drop("gt_id"), fixture(spark, sf_dir, "fx_gts")).select("image_id", "gt_id", *XY)


@query("""
SELECT ts - INTERVAL 0 SECOND AS start, run_id, n, round(mean,6) AS mean FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, run_id, count(*) AS n, avg(time) AS mean FROM fx_logs GROUP BY 1, 2)
""")
def r3_log_windows_batch(spark, sf_dir):
    from boxloom.streaming.jobs import stream_log_windows

    w = stream_log_windows(fixture(spark, sf_dir, "fx_logs"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "run_id", "n", *r6("mean"))


from boxloom.plans import more, scenes  # noqa: E402, F401  (register their queries)
