"""Registered queries: error breakdown, drawn crops and moved boxes, devkit conversion, location targets, table functions, replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.functions import tables as table_functions
from boxloom.operators import assign, coco, grids, location, logs, metrics, nms, placement, sampling
from boxloom.operators.tables import shared_dir
from boxloom.plans import more  # noqa: F401  (its SQL is used below)
from boxloom.plans.catalogue import _SQL, A2_SQL, ASSIGN_SQL, CLIPS, COV, LCG, TILES_SQL, XY, _assigned, iou_sql, nms_sql, query, r6
from boxloom.plans.fixtures import fixture, with_views
from boxloom.sources import devkit


def _images(spark, sf_dir, w: int = 500, h: int = 400):
    return fixture(spark, sf_dir, "fx_gts").select("image_id").distinct().withColumn("width", F.lit(w)).withColumn("height", F.lit(h))


# ------------------------------------------------------------------ M10


@query()
def m10_error_breakdown(spark, sf_dir):
    cats = spark.createDataFrame([(k, "a" if k <= 2 else "b") for k in range(1, 6)], "label long, supercategory string")
    return coco.coco_error_breakdown(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts"), cats).select("label", "area", "type", *r6("value"))


# ------------------------------------------------------------------ J10


def _hex(digest: str, k: int) -> str:
    return f"('0x' || substr({digest}, {8 * k + 1}, 8))::BIGINT"


@query(f"""
WITH i AS (SELECT image_id, 500.0::DOUBLE AS w, 400.0::DOUBLE AS h FROM (SELECT DISTINCT image_id FROM fx_gts) q),
m AS (SELECT image_id, w, h, r AS round, {_hex("md5(concat('7:mode:', image_id, ':', r))", 0)} % 7 AS pick FROM i, (SELECT unnest(range(0, 40)) AS r) s),
open_ AS (SELECT * FROM (SELECT *, min(CASE WHEN pick = 0 THEN round END) OVER (PARTITION BY image_id) AS whole FROM m) q WHERE whole IS NULL OR round < whole),
d AS (SELECT image_id, w, h, round, t AS trial, [1, 0.1::DOUBLE, 0.3, 0.5, 0.7, 0.9, 0][pick + 1] AS min_iou, md5(concat('7:', image_id, ':', round, ':', t)) AS d FROM open_, (SELECT unnest(range(0, 50)) AS t) s),
u AS (SELECT *, (0.3::DOUBLE + (1 - 0.3::DOUBLE) * ({_hex('d', 0)} / 4294967296.0::DOUBLE)) * w AS nw, (0.3::DOUBLE + (1 - 0.3::DOUBLE) * ({_hex('d', 1)} / 4294967296.0::DOUBLE)) * h AS nh FROM d),
v AS (SELECT *, {_hex('d', 2)} / 4294967296.0::DOUBLE * (w - nw) AS l, {_hex('d', 3)} / 4294967296.0::DOUBLE * (h - nh) AS t FROM u WHERE nh >= nw * 0.5::DOUBLE AND nh <= nw * 2),
p AS (SELECT image_id, round, trial, min_iou, floor(l) AS x1, floor(t) AS y1, floor(l + nw) AS x2, floor(t + nh) AS y2 FROM v),
ok AS (SELECT p.image_id, p.round, p.trial, p.x1, p.y1, p.x2, p.y2 FROM p JOIN fx_gts g ON g.image_id = p.image_id
  GROUP BY p.image_id, p.round, p.trial, p.min_iou, p.x1, p.y1, p.x2, p.y2
  HAVING min({iou_sql('p.', 'g.')}) >= p.min_iou AND bool_or((g.x1+g.x2)/2 > p.x1 AND (g.y1+g.y2)/2 > p.y1 AND (g.x1+g.x2)/2 < p.x2 AND (g.y1+g.y2)/2 < p.y2)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round, trial) AS rn FROM ok) q WHERE rn = 1)
SELECT g.image_id, gt_id, label, round, trial,
  CASE WHEN f.x1 IS NULL THEN g.x1 ELSE greatest(g.x1, f.x1) - f.x1 END AS x1, CASE WHEN f.x1 IS NULL THEN g.y1 ELSE greatest(g.y1, f.y1) - f.y1 END AS y1,
  CASE WHEN f.x1 IS NULL THEN g.x2 ELSE least(g.x2, f.x2) - f.x1 END AS x2, CASE WHEN f.x1 IS NULL THEN g.y2 ELSE least(g.y2, f.y2) - f.y1 END AS y2
FROM fx_gts g LEFT JOIN f ON f.image_id = g.image_id
WHERE f.x1 IS NULL OR ((g.x1+g.x2)/2 > f.x1 AND (g.y1+g.y2)/2 > f.y1 AND (g.x1+g.x2)/2 < f.x2 AND (g.y1+g.y2)/2 < f.y2)
""")
def j10_min_iou_crop(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts")
    return placement.to_crops(g, placement.first_crops(_images(spark, sf_dir), g, 7)).select("image_id", "gt_id", "label", "round", "trial", *XY)


# ------------------------------------------------------------------ K7

YEAR = "CASE WHEN image_id % 2 = 0 THEN '2007' ELSE '2012' END"


@query(f"""
WITH i AS (SELECT DISTINCT image_id, {YEAR} AS year FROM fx_gts),
l AS (
  SELECT year, CASE image_id % 3 WHEN 0 THEN 'train' ELSE 'val' END AS split, image_id FROM i WHERE image_id % 3 < 2
  UNION ALL SELECT year, 'trainval', image_id FROM i WHERE image_id % 3 < 2 UNION ALL SELECT year, 'test', image_id FROM i WHERE image_id % 3 = 2 AND year = '2007'),
s AS (SELECT 'voc' || substr(year, 3) AS dataset, split, year, image_id FROM l UNION ALL SELECT 'voc0712', split, year, image_id FROM l WHERE split <> 'test')
SELECT dataset, split, concat('VOC', year, '/JPEGImages/', s.image_id, '.jpg') AS filename, 600 AS width, 500 AS height,
  count(*) FILTER (WHERE NOT is_ignore) AS boxes, count(*) FILTER (WHERE is_ignore) AS ignored,
  coalesce(sum(x1 - 1 + 2 * (y2 - 1)) FILTER (WHERE NOT is_ignore), 0) AS total, coalesce(sum(label) FILTER (WHERE is_ignore), 0)::BIGINT AS ignored_labels
FROM s JOIN fx_gts USING (image_id) GROUP BY dataset, split, year, s.image_id
""")
def k7_convert_voc(spark, sf_dir):
    from boxloom.plans.catalogue import _voc_rows

    year = F.when(F.col("image_id") % 2 == 0, "2007").otherwise("2012")
    i = fixture(spark, sf_dir, "fx_gts").select("image_id", year.alias("year"), (F.col("image_id") % 3).alias("k")).distinct()
    names = F.when(F.col("k") == 0, F.array(F.lit("train"), F.lit("trainval"))).when(F.col("k") == 1, F.array(F.lit("val"), F.lit("trainval")))
    names = F.coalesce(names, F.when(F.col("year") == "2007", F.array(F.lit("test"))))  # the other year has no list of tests
    lists = i.select("year", F.explode(names).alias("split"), F.col("image_id").cast("string").alias("name"))
    xml = _voc_rows(spark, sf_dir).join(i.select(F.col("image_id").cast("string").alias("name"), "year"), "name")
    path = f"{shared_dir(spark)}/boxloom-{uuid.uuid4().hex}/voc"
    devkit.write_annotations(devkit.annotations(lists, xml, [f"c{k}" for k in range(1, 6)]), path)
    total = F.aggregate("bboxes", F.lit(0.0), lambda a, b: a + b[0] + 2 * b[3])
    t = spark.read.parquet(path)
    return t.select(F.col("dataset").cast("string").alias("dataset"), "split", "filename", "width", "height", F.size("bboxes").cast("long").alias("boxes"), F.size("bboxes_ignore").cast("long").alias("ignored"), total.alias("total"), F.aggregate("labels_ignore", F.lit(0).cast("long"), lambda a, x: a + x).alias("ignored_labels"))


# ------------------------------------------------------------------ A11, A13, A14

#: Feature maps of an image of 512 x 416.
MAPS = [(52, 64), (26, 32), (13, 16), (7, 8), (4, 4)]


def _region(ratio: str, p: str) -> str:
    one = lambda a, z, last: f"least(greatest(round_even((1 - {ratio}::DOUBLE) * ({a} / s) + {ratio}::DOUBLE * ({z} / s), 0), 0), {last} - 1)"
    return f"{one('x1', 'x2', 'w')} AS {p}x1, {one('y1', 'y2', 'h')} AS {p}y1, {one('x2', 'x1', 'w')} AS {p}x2, {one('y2', 'y1', 'h')} AS {p}y2"


@query(f"""
WITH l AS (SELECT * FROM (VALUES (0, 8.0::DOUBLE, 64, 52), (1, 16.0, 32, 26), (2, 32.0, 16, 13), (3, 64.0, 8, 7), (4, 128.0, 4, 4)) v(level, s, w, h)),
g AS (SELECT *, least(greatest(floor(log2(sqrt((x2 - x1 + 1) * (y2 - y1 + 1))) - log2(32.0::DOUBLE) + 0.5), 0), 4)::INT AS own FROM fx_gts),
p AS (SELECT image_id, gt_id, own, level, {_region('0.25', 'r')}, {_region('0.4', 'c')} FROM g JOIN l ON level BETWEEN own - 1 AND own + 1),
x AS (SELECT *, unnest(range(least(rx1, cx1)::BIGINT, greatest(rx2, cx2)::BIGINT + 1)) AS col FROM p),
y AS (SELECT *, unnest(range(least(ry1, cy1)::BIGINT, greatest(ry2, cy2)::BIGINT + 1)) AS row FROM x),
z AS (SELECT image_id, level, row, col, gt_id, own = level AS mine, CASE WHEN own = level AND col BETWEEN cx1 AND cx2 AND row BETWEEN cy1 AND cy2 THEN 1 ELSE 0 END AS hit,
  col BETWEEN rx1 AND rx2 AND row BETWEEN ry1 AND ry2 AS ring FROM y)
SELECT image_id, level, row, col, max(hit) AS target, coalesce(arg_max(hit, gt_id) FILTER (WHERE mine), 0)::DOUBLE AS weight FROM z WHERE hit = 1 OR ring GROUP BY image_id, level, row, col
""")
def a11_location_targets(spark, sf_dir):
    return location.location_targets(fixture(spark, sf_dir, "fx_gts"), MAPS).select("image_id", "level", "row", "col", "target", "weight")


@query()
def a13_shift_gts(spark, sf_dir):
    return placement.shift_gts(_images(spark, sf_dir, 900, 700), fixture(spark, sf_dir, "fx_gts"), 3)


@query()
def a14_paste_gts(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts")
    small = g.where("gt_id % 3 = 0").withColumns({"x1": F.col("x1") * 0.5, "x2": F.col("x2") * 0.5, "y1": F.col("y1") * 0.5, "y2": F.col("y2") * 0.5})
    return placement.paste_gts(_images(spark, sf_dir), small, g, (300, 250), 5)


# ------------------------------------------------------------------ U5


@query(TILES_SQL.replace(",\n  width < 800 OR height < 800 AS short_side", ""))
def u5_tiles(spark, sf_dir):
    table_functions.register(spark)
    slides = fixture(spark, sf_dir, "fx_slides")
    return spark.sql("SELECT image_id, t.tile_idx, t.x, t.y FROM {s} s, LATERAL tiles(CAST(width AS INT), CAST(height AS INT), 800, 800) t", s=slides)


@query("""
SELECT image_id, q AS point_idx, (q % cols) * 512.0::DOUBLE AS x, (q // cols) * 512.0::DOUBLE AS y
FROM (SELECT image_id, cols, unnest(range(0, cols * rows)) AS q FROM (SELECT image_id, CAST(ceil(width / 512.0::DOUBLE) AS BIGINT) AS cols, CAST(ceil(height / 512.0::DOUBLE) AS BIGINT) AS rows FROM fx_slides) s) t
""")
def u5_points(spark, sf_dir):
    table_functions.register(spark)
    slides = fixture(spark, sf_dir, "fx_slides")
    return spark.sql("SELECT image_id, p.point_idx, p.x, p.y FROM {s} s, LATERAL points(CAST(ceil(width / 512) AS INT), CAST(ceil(height / 512) AS INT), 512) p", s=slides)


@query(nms_sql("fx_dets", "image_id, label", 0.5) + " SELECT k.det_id AS det_id FROM kept")
def u5_suppress(spark, sf_dir):
    table_functions.register(spark)
    return spark.sql("SELECT det_id FROM suppress(TABLE({d}) PARTITION BY (image_id, label) ORDER BY (score DESC, det_id), 0.5D)", d=fixture(spark, sf_dir, "fx_dets"))


# ------------------------------------------------------------------ D13


@query(f"""
WITH f AS (SELECT image_id, CASE WHEN width > height THEN 1 ELSE 0 END AS flag FROM fx_slides),
k AS (SELECT flag, {LCG.format(c='image_id', s=9)} AS r, image_id FROM f WHERE image_id % 7 <> 3),
d AS (SELECT flag, {LCG.format(c='image_id', s=10)} AS q, image_id FROM f WHERE image_id % 7 = 3),
n AS (SELECT d.image_id, d.flag, arg_min(k.image_id, (k.r, k.image_id)) FILTER (WHERE k.r > d.q) AS nxt, arg_min(k.image_id, (k.r, k.image_id)) AS wrap FROM d JOIN k ON k.flag = d.flag GROUP BY d.image_id, d.flag)
SELECT image_id, flag, coalesce(nxt, wrap) AS replacement FROM n
""")
def d13_replacement(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_slides").select("image_id", G.aspect_flag(F.col("width"), F.col("height")).alias("flag"))
    return sampling.replacement(s.where("image_id % 7 = 3"), s, 9)


# ------------------------------------------------------------------ A7, A15, M6, M13, D7, N7, N12: ranges, ignore tests, totals, decoding


IOF = "coalesce(greatest(least({a}x2,{b}x2)-greatest({a}x1,{b}x1)+1,0)*greatest(least({a}y2,{b}y2)-greatest({a}y1,{b}y1)+1,0)/nullif(({a}x2-{a}x1+1)*({a}y2-{a}y1+1),0),0)"


@query(f"""
WITH x AS (SELECT image_id, CAST(floor(det_id/3.0::DOUBLE) AS BIGINT) AS box_id, det_id, x1, y1, x2, y2 FROM fx_dets WHERE x2 >= x1 AND y2 >= y1),
sq AS (SELECT image_id, box_id, arg_min(x1, det_id) AS x1, arg_min(y1, det_id) AS y1, arg_min(x2, det_id) AS x2, arg_min(y2, det_id) AS y2 FROM x GROUP BY 1, 2),
gone AS (SELECT DISTINCT s.box_id FROM sq s JOIN fx_gts g ON g.image_id = s.image_id AND g.is_ignore WHERE {IOF.format(a='s.', b='g.')} > 0.4),
t AS (SELECT * FROM fx_gts WHERE NOT is_ignore),
p AS (SELECT d.image_id, d.box_id, g.gt_id, max({iou_sql('d.', 'g.')}) AS iou FROM x d JOIN t g ON d.image_id = g.image_id WHERE d.box_id NOT IN (SELECT box_id FROM gone) GROUP BY 1, 2, 3),
q AS (SELECT *, max(iou) OVER (PARTITION BY image_id, gt_id) AS best FROM p),
a AS (SELECT box_id, max(iou) AS max_iou, arg_max(gt_id, (iou, -gt_id)) AS own, max(gt_id) FILTER (WHERE iou = best AND best >= 0.2) AS claimed FROM q GROUP BY 1),
r AS (SELECT s.box_id, coalesce(max_iou, 0) AS max_iou, coalesce(claimed, CASE WHEN max_iou >= 0.5 THEN own END) AS gt_id FROM sq s LEFT JOIN a USING (box_id) WHERE s.box_id NOT IN (SELECT box_id FROM gone))
SELECT box_id, round(max_iou, 6) AS max_iou, gt_id, CASE WHEN gt_id IS NOT NULL THEN 1 WHEN max_iou < 0.4 THEN 0 ELSE -1 END AS assigned FROM r
UNION ALL SELECT box_id, -1, NULL, -1 FROM gone
""")
def a7_approx_with_ignores(spark, sf_dir):
    x = fixture(spark, sf_dir, "fx_dets").where("x2 >= x1 AND y2 >= y1").select("image_id", F.floor(F.col("det_id") / 3.0).alias("box_id"), "det_id", *XY)
    squares = x.groupBy("image_id", "box_id").agg(*[F.min_by(c, "det_id").alias(c) for c in XY])
    g = fixture(spark, sf_dir, "fx_gts")
    t = assign.assign_approx_max_iou(x, squares, g.where("NOT is_ignore"), 0.5, 0.4, 0.2, ignores=g.where("is_ignore"), ignore_iof_thr=0.4)
    return t.select("box_id", *r6("max_iou"), "gt_id", "assigned")


@query(f"WITH {ASSIGN_SQL}, i AS (SELECT image_id, count(*) FILTER (WHERE assigned = 1) AS p, count(*) FILTER (WHERE assigned = 0) AS n FROM s GROUP BY image_id) SELECT sum(greatest(p, 1))::BIGINT AS n_pos, sum(greatest(n, 1))::BIGINT AS n_neg FROM i")
def a15_target_totals(spark, sf_dir):
    return assign.target_totals(_assigned(spark, sf_dir))


@query(f"""
WITH m AS ({A2_SQL}), w AS (SELECT m.*, d.label, d.score FROM m JOIN fx_dets d USING (det_id)),
rs AS (SELECT unnest([0,1,2]) AS range_idx, unnest([0.0::DOUBLE,0,2500]) AS lo, unnest([1e10::DOUBLE,2500,1e10]) AS hi),
n AS (SELECT range_idx, label, count(*) FILTER (WHERE NOT is_ignore AND (x2-x1+1)*(y2-y1+1) >= lo AND (x2-x1+1)*(y2-y1+1) < hi) AS n_gts FROM fx_gts, rs GROUP BY 1, 2),
c AS (SELECT range_idx, label, det_id, score, sum(tp) OVER v AS ctp, sum(fp) OVER v AS cfp FROM w WINDOW v AS (PARTITION BY range_idx, label ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT c.range_idx, c.label, det_id, score, ctp / greatest(n_gts, 2.220446049250313e-16) AS recall, ctp / greatest(ctp + cfp, 2.220446049250313e-16) AS precision FROM c JOIN n ON n.range_idx = c.range_idx AND n.label = c.label),
s AS (SELECT range_idx, label, recall, max(precision) AS precision FROM k GROUP BY 1, 2, 3),
e AS (SELECT range_idx, label, recall, max(precision) OVER (PARTITION BY range_idx, label ORDER BY recall DESC) AS env, coalesce(lag(recall) OVER (PARTITION BY range_idx, label ORDER BY recall), 0) AS before FROM s),
ap AS (SELECT range_idx, label, sum((recall - before) * env) AS ap FROM e GROUP BY 1, 2),
last AS (SELECT range_idx, label, count(*) AS n_dets, max(recall) AS recall, arg_min(precision, (score, -det_id)) AS precision FROM k GROUP BY 1, 2),
t AS (SELECT n.range_idx, n.label, n_gts, coalesce(n_dets, 0) AS n_dets, coalesce(recall, 0) AS recall, coalesce(precision, 0) AS precision, coalesce(ap, 0) AS ap FROM n LEFT JOIN last ON last.range_idx = n.range_idx AND last.label = n.label LEFT JOIN ap ON ap.range_idx = n.range_idx AND ap.label = n.label)
SELECT range_idx, label, n_gts, n_dets, round(recall, 6) AS recall, round(precision, 6) AS precision, round(ap, 6) AS ap FROM t
UNION ALL SELECT range_idx, NULL, sum(n_gts)::BIGINT, sum(n_dets)::BIGINT, NULL, NULL, round(coalesce(avg(ap) FILTER (WHERE n_gts > 0), 0), 6) FROM t GROUP BY range_idx
""")
def m6_range_report(spark, sf_dir):
    t = metrics.range_report(fixture(spark, sf_dir, "fx_dets"), fixture(spark, sf_dir, "fx_gts"), [(0, 1e10), (0, 2500), (2500, 1e10)])
    return t.select("range_idx", "label", "n_gts", "n_dets", *r6("recall", "precision", "ap"))


@query("""
WITH l AS (SELECT corruption, severity, 'ap' AS metric, ap AS value FROM fx_corruption UNION ALL SELECT corruption, severity, 'ap50', ap * ap FROM fx_corruption UNION ALL SELECT corruption, severity, 'ar', ap + severity FROM fx_corruption),
a AS (SELECT metric, avg(value) FILTER (WHERE severity = 0 AND corruption = 0) AS p, avg(value) FILTER (WHERE severity >= 1) AS mpc FROM l GROUP BY metric)
SELECT metric, round(p,6) AS p, round(mpc,6) AS mpc, round(mpc/nullif(p, 0),6) AS rpc FROM a
""")
def m13_robustness_by_metric(spark, sf_dir):
    t = fixture(spark, sf_dir, "fx_corruption").select("corruption", "severity", "ap", (F.col("ap") * F.col("ap")).alias("ap50"), (F.col("ap") + F.col("severity")).alias("ar"))
    return logs.robustness_by_metric(logs.unpivot_metrics(t, ["ap", "ap50", "ar"]), "all").select("metric", *r6("p", "mpc", "rpc"))


@query(f"""WITH {ASSIGN_SQL}, u AS (SELECT *, max(max_iou) OVER (PARTITION BY image_id) AS top FROM s),
n_ AS (SELECT *, CASE WHEN max_iou < 0.05 THEN 1 ELSE 0 END AS low, {LCG.format(c='box_id', s=4)} AS r, (top - 0.05::DOUBLE) / 3 AS step FROM u WHERE assigned = 0),
b_ AS (SELECT *, CASE WHEN step > 0 AND floor((max_iou - 0.05::DOUBLE) / step) BETWEEN 0 AND 2 THEN floor((max_iou - 0.05::DOUBLE) / step) END AS bin FROM n_),
k_ AS (SELECT *, row_number() OVER (PARTITION BY image_id, low, bin ORDER BY r, box_id) AS k FROM b_),
l_ AS (SELECT *, CASE WHEN low = 0 AND (bin IS NULL OR k > 2) THEN 1 ELSE 0 END AS late, sum(1 - low) OVER (PARTITION BY image_id) AS high FROM k_),
r_ AS (SELECT *, row_number() OVER (PARTITION BY image_id, low ORDER BY late, r, box_id) AS rank FROM l_),
o_ AS (SELECT *, CASE WHEN rank > (CASE WHEN low = 0 THEN 6 ELSE 9 - least(high, 6) END) THEN 1 ELSE 0 END AS out_ FROM r_),
f_ AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY out_, r, box_id) AS rn FROM o_)
SELECT image_id, box_id FROM f_ WHERE rn <= 9""")
def d7_floor_balanced_negatives(spark, sf_dir):
    return sampling.sample_floor_balanced_neg(_assigned(spark, sf_dir), 9, 3, 0.05, 0.3, 4).select("image_id", "box_id")


POINTS_SQL = """pt AS (SELECT level, st + rr * f + cc AS point_idx, cc * s AS x, rr * s AS y FROM (SELECT *, unnest(range(0, f)) AS cc FROM (SELECT *, unnest(range(0, f)) AS rr FROM (SELECT unnest([0, 1]) AS level, unnest([8.0::DOUBLE, 16]) AS s, unnest([100, 50]) AS f, unnest([0, 10000]) AS st) l) q) z),
once AS (SELECT *, row_number() OVER (PARTITION BY image_id, anchor_idx % 12500 ORDER BY pred_id) AS once FROM fx_raw_preds),
j AS (SELECT image_id, level, pt.point_idx, x, y, s1, s2, abs(dx) * 2 AS c, row_number() OVER (PARTITION BY image_id, level ORDER BY greatest(s1, s2) * (abs(dx) * 2) DESC, pt.point_idx) AS q,
  30 + 10 * dw AS l, 30 + 10 * dh AS t, 40 - 10 * dw AS r, 40 - 10 * dh AS b FROM once JOIN pt ON pt.point_idx = anchor_idx % 12500 WHERE once = 1),
dec AS (SELECT image_id, point_idx AS det_id, s1, s2, c, least(greatest(x-l,0),799)/2 AS x1, least(greatest(y-t,0),799)/2 AS y1, least(greatest(x+r,0),799)/2 AS x2, least(greatest(y+b,0),799)/2 AS y2 FROM j WHERE q <= 30),
cls AS (SELECT image_id, 0 AS label, det_id, s1 * c AS score, x1, y1, x2, y2 FROM dec WHERE s1 > 0.1 UNION ALL SELECT image_id, 1, det_id, s2 * c, x1, y1, x2, y2 FROM dec WHERE s2 > 0.1)"""


def _led_by(first: str, sql: str) -> str:
    return sql.replace("WITH RECURSIVE ", f"WITH RECURSIVE {first}, ", 1)


@query(_led_by(POINTS_SQL, nms_sql("cls", "image_id, label", 0.4)) + """,
f AS (SELECT image_id, label, k.det_id AS det_id, k.score AS score, k.x1 AS x1, row_number() OVER (PARTITION BY image_id ORDER BY k.score DESC, label, k.det_id) AS rn FROM kept)
SELECT image_id, label, det_id, round(score, 6) AS score, round(x1, 6) AS x1 FROM f WHERE rn <= 25""")
def n7_decode_points(spark, sf_dir):
    t = fixture(spark, sf_dir, "fx_raw_preds").withColumn("point_idx", F.col("anchor_idx") % 12_500)
    one = t.groupBy("image_id", "point_idx").agg(F.min_by(F.struct("dx", "dw", "dh", "s1", "s2"), "pred_id").alias("p")).select("image_id", "point_idx", "p.*")
    side = {"l": 30 + 10 * F.col("dw"), "t": 30 + 10 * F.col("dh"), "r": 40 - 10 * F.col("dw"), "b": 40 - 10 * F.col("dh")}
    raw = one.select("image_id", "point_idx", F.array("s1", "s2").alias("scores"), (F.abs("dx") * 2).alias("centerness"), *[v.alias(k) for k, v in side.items()])
    points = grids.point_grid(spark, [(100, 100), (50, 50)], [8, 16])
    return nms.decode_points(raw, points, 30, 0.1, 0.4, 25, 800, 800, 2.0).select("image_id", "label", "det_id", *r6("score", "x1"))


CASCADE_SQL = """st AS (SELECT image_id, label, det_id, avg(score * s) AS score FROM fx_dets, (SELECT unnest([1.0::DOUBLE, 0.5, 0.25]) AS s) v GROUP BY 1, 2, 3),
g0 AS (SELECT image_id, det_id, label, (x1+x2)*0.5+(x2-x1+1)*((det_id%11-5)/50.0::DOUBLE*0.1::DOUBLE) AS gx, (y1+y2)*0.5 AS gy, (x2-x1+1)*exp((det_id%7-3)/10.0::DOUBLE*0.2::DOUBLE) AS gw, (y2-y1+1)*exp(0.0::DOUBLE) AS gh FROM fx_dets WHERE x2 >= x1 AND y2 >= y1),
cls AS (SELECT g0.image_id, g0.label - 1 AS label, det_id, score, least(greatest(gx-gw*0.5+0.5,0),499) AS x1, least(greatest(gy-gh*0.5+0.5,0),399) AS y1, least(greatest(gx+gw*0.5-0.5,0),499) AS x2, least(greatest(gy+gh*0.5-0.5,0),399) AS y2
  FROM g0 JOIN st USING (image_id, det_id) WHERE score > 0.1)"""


@query(_led_by(CASCADE_SQL, nms_sql("cls", "image_id, label", 0.5)) + """,
f AS (SELECT image_id, label, k.det_id AS det_id, k.score AS score, k.x1 AS x1, row_number() OVER (PARTITION BY image_id ORDER BY k.score DESC, label, k.det_id) AS rn FROM kept)
SELECT image_id, label, det_id, round(score, 6) AS score, round(x1, 6) AS x1 FROM f WHERE rn <= 12""")
def n12_decode_cascade(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").where("x2 >= x1 AND y2 >= y1")
    scores = lambda s: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.when(k == F.col("label"), F.col("score") * s).otherwise(F.lit(0.0)))
    stages = d.select("image_id", F.col("det_id").alias("box_idx"), F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), scores(s).alias("scores")) for k, s in enumerate((1.0, 0.5, 0.25))])).alias("v")).select("image_id", "box_idx", "v.*")
    rois = d.select("image_id", F.col("det_id").alias("box_idx"), *XY, ((F.col("det_id") % 11 - 5) / 50.0).alias("dx"), F.lit(0.0).alias("dy"), ((F.col("det_id") % 7 - 3) / 10.0).alias("dw"), F.lit(0.0).alias("dh"))
    return nms.decode_cascade(stages, rois, 0.1, 0.5, 12, max_w=500, max_h=400).select("image_id", "label", "det_id", *r6("score", "x1"))


# ------------------------------------------------------------------ SQL of queries that show another side of one with SQL


def _all_sides(sql: str) -> str:
    """The SQL of voted boxes with all four coordinates."""
    head, tail = sql.split("g AS (SELECT image_id, label, lead", 1)
    sums = ", ".join(f"sum({c}*score)/sum(score) AS v{c}, min({c}) AS s{c}" for c in XY)
    sides = ", ".join(f"round(CASE WHEN members = 1 THEN s{c} ELSE v{c} END, 6) AS {c}" for c in XY)
    return f"""{head}g AS (SELECT image_id, label, lead, count(*) AS members, max(score) AS score, {sums} FROM c GROUP BY 1, 2, 3)
SELECT g.image_id, g.label, d.det_id, members, round(g.score, 6) AS score, {sides} FROM g JOIN d ON d.image_id = g.image_id AND d.label = g.label AND d.rn = g.lead"""


_SQL["n5_bbox_voting"] = _all_sides(_SQL["n5_voted_boxes"])
_SQL["a8_assign_points"] = _SQL["a8_nearest_points"]
_WINDOWS = f"(SELECT image_id, wx1, wy1, wx1 + 200 AS wx2, wy1 + 200 AS wy2 FROM ({_SQL['d14_crop_windows']}) q) w"
_SQL["d14_j7_crop_choice"] = with_views(f"SELECT image_id, gt_id, {CLIPS} FROM fx_gts JOIN {_WINDOWS} USING (image_id) WHERE {COV} > 0.5")
