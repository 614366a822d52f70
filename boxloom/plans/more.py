"""More registered queries: filters, geometry, readers over written files, assignment, sampling, heads and masks."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.operators import assign, grids, losses, masks, match, nms, pairs, sampling
from boxloom.operators.tables import materialise, shared_dir
from boxloom.plans.catalogue import ANCHOR_SQL, ASSIGN_SQL, LCG, XY, R, _assigned, _coco_anns, iou_sql, nms_sql, query, r6
from boxloom.plans.fixtures import fixture
from boxloom.sources import readers


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/boxloom-{uuid.uuid4().hex}/{name}"


# ------------------------------------------------------------------ readers, over files written from the tables


@query("SELECT gt_id, image_id, label, is_ignore, x1, y1, x2, y2 FROM (SELECT gt_id, image_id, label, is_crowd AS is_ignore, x1, y1, x2, y2 FROM fx_gts WHERE NOT is_ignore)")
def s6_read_coco(spark, sf_dir):
    anns, cats = _coco_anns(spark, sf_dir)
    names = ", ".join(f'{{"id": {r["id"]}, "name": "c{r["id"]}"}}' for r in cats.orderBy("id").collect())  # five rows

    def documents(batches):
        """One document a task, written as it comes."""
        yield pa.RecordBatch.from_arrays([pa.array([f'{{"images": [], "categories": [{names}], "annotations": ['])], names=["v"])
        comma = ""
        for b in batches:
            lines = [("" if i else comma) + v + ("," if i + 1 < b.num_rows else "") for i, v in enumerate(b.column(0).to_pylist())]
            comma = "," if lines else comma
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["v"])
        yield pa.RecordBatch.from_arrays([pa.array(["]}"])], names=["v"])

    path = _path(spark, "coco")
    anns.select(F.to_json(F.struct(*anns.columns)).alias("v")).coalesce(2).mapInArrow(documents, "v string").write.text(path)
    _rename(spark, path, ".txt", ".json")
    _, a, c = readers.read_coco(spark, path, range_bytes=1 << 18)
    return readers.clean_coco_annotations(a, c).select("gt_id", "image_id", "label", "is_ignore", *XY)


def _rename(spark, path: str, old: str, new: str) -> None:
    """The files of a folder under another suffix."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for f in store.listStatus(hadoop.Path(path)):
        name = f.getPath().toString()
        if name.endswith(old):
            store.rename(f.getPath(), hadoop.Path(name[: -len(old)] + new))


@query("SELECT image_id, CAST(width AS INT) AS width, CAST(height AS INT) AS height, 24 + image_id % 5000 AS length FROM fx_slides")
def s12_image_catalog(spark, sf_dir):
    path = _path(spark, "pictures")

    def write(batches):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        for b in batches:
            for i, w, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store.create_dir(f"{at}/{i % 16}")
                with store.open_output_stream(f"{at}/{i % 16}/{i}.png") as f:
                    f.write(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x00" * (i % 5000))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    fixture(spark, sf_dir, "fx_slides").select("image_id", F.col("width").cast("int"), F.col("height").cast("int")).repartition(4).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    t = readers.image_catalog(spark, path)
    return t.select(F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long").alias("image_id"), "width", "height", "length")


@query("SELECT CAST(image_id AS VARCHAR) AS id FROM (SELECT DISTINCT image_id FROM fx_gts)")
def s7_image_set(spark, sf_dir):
    path = _path(spark, "set")
    fixture(spark, sf_dir, "fx_gts").select(F.concat(F.lit(" "), F.col("image_id").cast("string"), F.lit(" ")).alias("v")).distinct().write.text(path)
    return readers.read_image_set(spark, path)


@query("SELECT CAST(image_id AS VARCHAR) AS image_id, CAST(printf('%.4f', score) AS DOUBLE) AS score, x1, y1, x2, y2 FROM fx_dets")
def s8_voc_dets(spark, sf_dir):
    path = _path(spark, "dets")
    d = fixture(spark, sf_dir, "fx_dets")
    d.select(F.concat_ws(" ", "image_id", G.fmt4(F.col("score")), *XY).alias("v")).write.text(path)
    return readers.read_voc_dets(spark, path)


@query("SELECT image_id, label*10 AS category_id, round(score, 6) AS score, x1, y1, x2, y2 FROM fx_dets")
def s9_coco_results(spark, sf_dir):
    path = _path(spark, "results")
    d = fixture(spark, sf_dir, "fx_dets")
    row = F.struct("image_id", (F.col("label") * 10).cast("int").alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1).alias("bbox"), "score")
    files = d.groupBy(F.pmod("image_id", F.lit(64)).alias("file")).agg(F.to_json(F.collect_list(row)).alias("json"))  # an array in each file
    files.write.partitionBy("file").text(path)
    return readers.read_coco_results(spark, f"{path}/*").select("image_id", F.col("category_id").cast("long").alias("category_id"), *r6("score", *XY))


@query("SELECT run_id, mode, count(*) AS n, round(sum(time), 4) AS total FROM fx_logs GROUP BY 1, 2")
def s10_x3_train_logs(spark, sf_dir):
    path = _path(spark, "logs")
    t = fixture(spark, sf_dir, "fx_logs").select("run_id", "mode", "epoch", "iter", "time")
    t.write.json(path)
    read = readers.read_train_logs(spark, f"{path}/*.json")
    lines = t.select(F.to_json(F.struct(*t.columns)).alias("line")).select(readers.parse_log_line("line").alias("m")).where("NOT map_contains_key(m, 'mode')")
    n = lines.groupBy(F.col("m")["run_id"].cast("long").alias("run_id")).agg(F.count("*").alias("k"))
    out = read.groupBy("run_id", "mode").agg(F.count("*").alias("n"), F.round(F.sum("time"), 4).alias("total"))
    return out.join(n.where("k > 0"), "run_id", "left_semi")


@query("SELECT gt_id, label, 'c' || label AS name FROM fx_gts WHERE label <= 3")
def f5_known_classes(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts").select("gt_id", F.concat(F.lit("c"), "label").alias("name"))
    return readers.with_labels(g, ["c1", "c2", "c3"], "drop").select("gt_id", F.col("label").cast("long").alias("label"), "name")


# ------------------------------------------------------------------ flags and geometry


@query("SELECT det_id, x1 >= -2 AND y1 >= -2 AND x2 < 402 AND y2 < 302 AS inside, det_id % 50 < ceil(390/8.0::DOUBLE) AND det_id % 40 < ceil(290/8.0::DOUBLE) AS valid FROM fx_dets")
def f11_f12_anchor_flags(spark, sf_dir):
    w, h = F.lit(400.0), F.lit(300.0)
    return fixture(spark, sf_dir, "fx_dets").select("det_id", G.inside_flag(G.box(), w, h, 2).alias("inside"), G.valid_anchor_flag(F.col("det_id") % 50, F.col("det_id") % 40, 8, F.lit(390), F.lit(290)).alias("valid"))


@query("SELECT image_id, label, bool_or(x1 >= 0 AND y1 >= 0 AND x2 < 400 AND y2 < 300) AS inside FROM fx_dets GROUP BY 1, 2")
def f13_any_inside(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").withColumn("inside", G.inside_flag(G.box(), F.lit(400.0), F.lit(300.0)))
    return grids.any_inside(d, ["image_id", "label"])


@query("""
WITH k AS (SELECT * FROM fx_raw_preds WHERE 1/(1+exp(-dx)) >= 0.55),
b AS (SELECT pred_id, greatest(least(dw, -ln(0.000001::DOUBLE)), ln(0.000001::DOUBLE)) AS w, greatest(least(dh, -ln(0.000001::DOUBLE)), ln(0.000001::DOUBLE)) AS h FROM k)
SELECT pred_id, round(8 - 16*exp(w)*0.5 + 0.0, 6) AS x1, round(8 + 16*exp(h)*0.5 - 1, 6) AS y2 FROM b
""")
def f14_location_mask(spark, sf_dir):
    t = fixture(spark, sf_dir, "fx_raw_preds").where(G.loc_mask(F.col("dx"), 0.55))
    z = F.lit(0.0)
    b = G.delta2bbox(G.Box(z, z, F.lit(15.0), F.lit(15.0)), [z, z, F.col("dw"), F.col("dh")], wh_ratio_clip=1e-6)
    return t.select("pred_id", F.round(b.x1, 6).alias("x1"), F.round(b.y2, 6).alias("y2"))


@query(f"""
SELECT det_id, {R('least(greatest(x1-2-label,0),399)', 'lx1')}, {R('least(greatest(x2+2+label,0),399)', 'lx2')}, CAST(ceil((x2-x1)/32)*32 AS BIGINT) AS pw,
  {R('(x1+x2)*0.5-(x2-x1+1)*1.5*0.5+0.5', 'qx1')}, round_even(0.7*x1+0.3*x2, 0) AS cx1, least(greatest(round_even(0.3*y1+0.7*y2, 0),0),299) AS cy2,
  least(x1,x2,y1) AS px1, {R('least(greatest(x1*4+8,0),400)', 'dx1')}, {R('least(greatest(8*(det_id%50)-16*exp(score),0),399)', 'vx1')},
  {R('1/(1+exp(-score))', 'sig')}, {R('exp(score)/(exp(score)+exp(0.25::DOUBLE)+exp(label/5.0::DOUBLE))', 'soft')}, x1+100 AS sx1, y2+50 AS sy2
FROM fx_dets
""")
def g9_g24_scalars(spark, sf_dir):
    b, k, d = G.box(), F.col("label") + 2.0, fixture(spark, sf_dir, "fx_dets")
    n = G.distance2bbox(b.x1, b.y1, k, k, k, k, 400, 300)
    f = G.distance2bbox(b.x2, b.y2, k, k, k, k, 400, 300)
    c = G.calc_region(b, 0.3)
    cc = G.calc_region(b, 0.3, 400, 300)
    pts = G.points2bbox(F.array("y1", "x1", "y2", "x2", "y1", "y1"))
    s = F.col("score")
    fov = G.fovea_decode((F.col("det_id") % 50).cast("double"), F.lit(0.0), F.lit(8.0), F.lit(16.0), [s, s, s, s], 400, 300)
    sh = G.shift_box(b, F.lit(100.0), F.lit(50.0))
    return d.select(
        "det_id", F.round(n.x1, 6).alias("lx1"), F.round(f.x2, 6).alias("lx2"), G.pad_shape(b.x2 - b.x1, b.y2 - b.y1, divisor=32)[0].alias("pw"), F.round(G.roi_rescale(b, 1.5).x1, 6).alias("qx1"),
        c.x1.alias("cx1"), cc.y2.alias("cy2"), pts.x1.alias("px1"), F.round(G.reppoints_decode(b, F.lit(8.0), F.lit(8.0), F.lit(4.0), 400, 300).x1, 6).alias("dx1"), F.round(fov.x1, 6).alias("vx1"),
        F.round(G.sigmoid(s), 6).alias("sig"), F.round(F.element_at(G.softmax(F.array(s, F.lit(0.25), F.col("label") / 5.0)), 1), 6).alias("soft"), sh.x1.alias("sx1"), sh.y2.alias("sy2"),
    )


@query(f"SELECT det_id, {R('avg(v) OVER w - stddev_samp(v) OVER w * exp(0.1::DOUBLE)', 'lo')}, {R('avg(v) OVER w + stddev_samp(v) OVER w * exp(0.1::DOUBLE)', 'hi')} FROM (SELECT det_id, unnest([x1, x2, y1, score]) AS v FROM fx_dets) WINDOW w AS (PARTITION BY det_id)".replace("SELECT det_id", "SELECT DISTINCT det_id", 1))
def g20_points_moment(spark, sf_dir):
    b = G.points2bbox(F.array(*[x for c in ("x1", "x2", "y1", "score") for x in (F.lit(0.0), F.col(c))]), "moment", True, (0.1, 0.1))
    return fixture(spark, sf_dir, "fx_dets").select("det_id", F.round(b.x1, 6).alias("lo"), F.round(b.x2, 6).alias("hi"))


@query("SELECT det_id, 'f' || label || '.b.json' AS swapped, 'gaussian blur ' || label AS pretty, CASE WHEN label % 2 = 0 THEN 2007 ELSE 2012 END AS year FROM fx_dets")
def x1_x5_x6_names(spark, sf_dir):
    n = F.concat(F.lit("f"), "label", F.lit(".b.png"))
    year = G.voc_year(F.concat(F.lit("/data/VOC"), F.when(F.col("label") % 2 == 0, "2007").otherwise("2012")))
    return fixture(spark, sf_dir, "fx_dets").select("det_id", G.swap_ext(n, "json").alias("swapped"), G.pretty_distortion(F.concat(F.lit("gaussian_blur_"), "label")).alias("pretty"), year.alias("year"))


@query("SELECT gt_id, label, CASE WHEN is_ignore THEN 1 ELSE 0 END AS gt_ignore FROM fx_gts")
def x7_u2_flag_ignores(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts")
    keep = sampling.pipeline(lambda d: d.select("gt_id", "label", "is_ignore"), lambda d: d.drop("is_ignore"))
    return sampling.flag_ignores(g.where("NOT is_ignore").transform(keep), g.where("is_ignore").transform(keep))


# ------------------------------------------------------------------ grids and joins


@query("""
WITH v AS (SELECT * FROM (VALUES (0, 4.0::DOUBLE, 30.0::DOUBLE, 60.0::DOUBLE), (1, 8.0, 60.0, 111.0), (2, 16.0, 111.0, 162.0), (3, 32.0, 162.0, 213.0), (4, 50.0, 213.0, 264.0), (5, 150.0, 264.0, 315.0)) t(level, c, small, large)),
a AS (SELECT level, c, 0 AS anchor, small AS w, small AS h FROM v UNION ALL SELECT level, c, 1, sqrt(small*large), sqrt(small*large) FROM v
  UNION ALL SELECT level, c, 2, small/sqrt(0.5::DOUBLE), small*sqrt(0.5::DOUBLE) FROM v UNION ALL SELECT level, c, 3, small/sqrt(2::DOUBLE), small*sqrt(2::DOUBLE) FROM v),
b AS (SELECT level, anchor, round_even(c-(w-1)*0.5, 0) AS ax1, round_even(c-(h-1)*0.5, 0) AS ay1, round_even(c+(w-1)*0.5, 0) AS ax2, round_even(c+(h-1)*0.5, 0) AS ay2 FROM a),
g AS (SELECT gt_id, (x2-x1+1) AS gw, (y2-y1+1) AS gh FROM fx_gts)
SELECT gt_id, level, anchor, ax1, ay1, ax2, ay2 FROM (
  SELECT g.gt_id, b.*, row_number() OVER (PARTITION BY gt_id ORDER BY abs(ln(gw/(ax2-ax1+1))) + abs(ln(gh/(ay2-ay1+1))), level, anchor) AS rn FROM g, b) q WHERE rn = 1
""")
def t8_ssd_anchors(spark, sf_dir):
    """Each truth with the anchor whose sides are nearest to its own, out of all six levels."""
    a = grids.ssd_anchors(spark, 300, (0.2, 0.9), [8, 16, 32, 64, 100, 300], [[2]] * 6).collect()  # 24 rows
    g = fixture(spark, sf_dir, "fx_gts")
    off = lambda lo, hi, r: F.abs(F.ln((F.col(hi) - F.col(lo) + 1) / F.lit(float(r[hi] - r[lo] + 1))))
    each = [F.struct((off("x1", "x2", r) + off("y1", "y2", r)).alias("d"), *[F.lit(int(r[c])).alias(c) for c in ("level", "anchor")], *[F.lit(float(r[c])).alias(c) for c in XY]) for r in a]
    return g.select("gt_id", F.array_min(F.array(*each)).alias("a")).select("gt_id", *[F.col(f"a.{c}") for c in ("level", "anchor")], *[F.col(f"a.{c}").alias("a" + c) for c in XY])


@query("""
SELECT c AS corruption, s AS severity, s > 0 OR c = 'gaussian_noise' AS run, (SELECT count(*) FROM fx_corruption f WHERE f.severity = s) AS results
FROM (SELECT unnest(['gaussian_noise', 'shot_noise', 'impulse_noise']) AS c), (SELECT unnest([0, 1, 2]) AS s)
""")
def t11_corruption_plan(spark, sf_dir):
    n = fixture(spark, sf_dir, "fx_corruption").groupBy(F.col("severity").cast("int").alias("severity")).agg(F.count("*").alias("results"))
    return grids.corruption_plan(spark, "noise", [0, 1, 2]).join(n, "severity", "left").select("corruption", "severity", "run", F.coalesce("results", F.lit(0)).alias("results"))


AX = "a.ax1 AS x1, a.ay1 AS y1, a.ax2 AS x2, a.ay2 AS y2"


@query(f"""
WITH {ANCHOR_SQL}, g AS (SELECT * FROM fx_gts),
q AS (SELECT g.gt_id, a.anchor_idx, {iou_sql('a.', 'g.').replace('a.x1','a.ax1').replace('a.y1','a.ay1').replace('a.x2','a.ax2').replace('a.y2','a.ay2')} AS iou FROM g JOIN anchors a ON a.ax1 <= g.x2 + 1 AND a.ax2 >= g.x1 - 1 AND a.ay1 <= g.y2 + 1 AND a.ay2 >= g.y1 - 1),
r AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, anchor_idx) AS rank, greatest(max(iou) OVER (PARTITION BY gt_id), 0.600000000001::DOUBLE) AS top FROM q WHERE iou > 0)
SELECT gt_id, anchor_idx, rank::INT AS rank, floor(iou*1000000+0.5)/1000000 AS iou, floor(least(greatest((iou-0.6::DOUBLE)/(top-0.6::DOUBLE),0),1)*1000000+0.5)/1000000 AS prob FROM r WHERE rank <= 50
""")
def j4_a12_anchor_bags(spark, sf_dir):
    p = assign.best_anchors(grids.anchor_grid(spark, 800, 800), fixture(spark, sf_dir, "fx_gts"))
    half_up = [(F.floor(F.col(c) * 1_000_000 + 0.5) / 1_000_000).alias(c) for c in ("iou", "prob")]  # many are exact halves
    return p.select("gt_id", "anchor_idx", "rank", *half_up)


COVER = "greatest(least({a}x2,{b}x2)-greatest({a}x1,{b}x1),0)*greatest(least({a}y2,{b}y2)-greatest({a}y1,{b}y1),0)/greatest(({b}x2-{b}x1)*({b}y2-{b}y1),0.000001)"


@query(f"SELECT det_id FROM fx_dets d WHERE NOT EXISTS (SELECT 1 FROM fx_gts g WHERE g.image_id = d.image_id AND ({iou_sql('d.', 'g.', 0)} > 0.05 OR {COVER.format(a='d.', b='g.')} > 0.1 OR {COVER.format(a='g.', b='d.')} > 0.1))")
def j13_placeable(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_dets").select("image_id", "det_id", *[F.col(x).alias("c_" + x) for x in XY])
    return pairs.placeable(c, fixture(spark, sf_dir, "fx_gts").select("image_id", *XY)).select("det_id")


# ------------------------------------------------------------------ assignment


@query(f"""
WITH g AS (SELECT * FROM fx_gts WHERE NOT is_ignore), i AS (SELECT * FROM fx_gts WHERE is_ignore),
e AS (SELECT d.det_id FROM fx_dets d JOIN i ON i.image_id = d.image_id GROUP BY d.det_id HAVING max(greatest(least(d.x2,i.x2)-greatest(d.x1,i.x1)+1,0)*greatest(least(d.y2,i.y2)-greatest(d.y1,i.y1)+1,0)/((d.x2-d.x1+1)*(d.y2-d.y1+1))) > 0.5),
b AS (SELECT * FROM fx_dets WHERE det_id NOT IN (SELECT det_id FROM e)),
p AS (SELECT d.image_id, d.det_id AS box_id, g.gt_id, {iou_sql('d.', 'g.')} AS iou FROM b d JOIN g ON d.image_id = g.image_id),
q AS (SELECT *, max(iou) OVER (PARTITION BY image_id, gt_id) AS best FROM p),
a AS (SELECT box_id, max(iou) AS max_iou, arg_max(gt_id, (iou, -gt_id)) AS own, max(gt_id) FILTER (WHERE iou = best) AS claimed FROM q GROUP BY 1),
t AS (SELECT d.det_id AS box_id, coalesce(max_iou, 0) AS max_iou, coalesce(claimed, CASE WHEN max_iou >= 0.5 THEN own END) AS gt_id FROM b d LEFT JOIN a ON a.box_id = d.det_id)
SELECT box_id, round(max_iou, 6) AS max_iou, gt_id, CASE WHEN gt_id IS NOT NULL THEN 1 WHEN max_iou < 0.4 THEN 0 ELSE -1 END AS assigned FROM t
UNION ALL SELECT det_id, -1, NULL, -1 FROM e
""")
def a6_assign_with_ignores(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts")
    d = fixture(spark, sf_dir, "fx_dets").where("x2 >= x1 AND y2 >= y1").select("image_id", F.col("det_id").alias("box_id"), *XY)
    a = assign.assign_max_iou(d, g.where("NOT is_ignore"), 0.5, 0.4, 0.0, ignores=g.where("is_ignore"), ignore_iof_thr=0.5)
    return a.select("box_id", *r6("max_iou"), "gt_id", "assigned")


@query(f"""
WITH x AS (SELECT image_id, CAST(floor(det_id/3.0::DOUBLE) AS BIGINT) AS box_id, x1, y1, x2, y2 FROM fx_dets),
p AS (SELECT d.image_id, d.box_id, g.gt_id, max({iou_sql('d.', 'g.')}) AS iou FROM x d JOIN fx_gts g ON d.image_id = g.image_id GROUP BY 1, 2, 3),
q AS (SELECT *, max(iou) OVER (PARTITION BY image_id, gt_id) AS best FROM p),
a AS (SELECT box_id, max(iou) AS max_iou, arg_max(gt_id, (iou, -gt_id)) AS own, max(gt_id) FILTER (WHERE iou = best AND best >= 0.2) AS claimed FROM q GROUP BY 1),
t AS (SELECT s.box_id, coalesce(max_iou, 0) AS max_iou, coalesce(claimed, CASE WHEN max_iou >= 0.5 THEN own END) AS gt_id FROM (SELECT DISTINCT box_id FROM x) s LEFT JOIN a USING (box_id))
SELECT box_id, round(max_iou, 6) AS max_iou, gt_id, CASE WHEN gt_id IS NOT NULL THEN 1 WHEN max_iou < 0.4 THEN 0 ELSE -1 END AS assigned FROM t
""")
def a7_assign_approx(spark, sf_dir):
    x = fixture(spark, sf_dir, "fx_dets").select("image_id", F.floor(F.col("det_id") / 3.0).alias("box_id"), *XY)
    return assign.assign_approx_max_iou(x, x.select("image_id", "box_id").distinct(), fixture(spark, sf_dir, "fx_gts"), 0.5, 0.4, 0.2).select("box_id", *r6("max_iou"), "gt_id", "assigned")


@query("""
WITH lv AS (SELECT unnest([3,4,5]) AS level, unnest([8,16,32]) AS s, unnest([50,25,13]) AS f, unnest([0,2500,3125]) AS st),
r AS (SELECT *, unnest(range(0,f)) AS rr FROM lv), c AS (SELECT *, unnest(range(0,f)) AS cc FROM r), pt AS (SELECT st+rr*f+cc AS point_idx, level, (cc*s)::DOUBLE AS x, (rr*s)::DOUBLE AS y FROM c),
g AS (SELECT image_id, gt_id, (x1+x2)/2 AS gx, (y1+y2)/2 AS gy, greatest(x2-x1,0.000001) AS w, greatest(y2-y1,0.000001) AS h FROM fx_gts),
l AS (SELECT *, greatest(least(floor((log2(w/4)+log2(h/4))/2),5),3)::INT AS level FROM g),
d AS (SELECT image_id, gt_id, point_idx, sqrt(((x-gx)/w)*((x-gx)/w)+((y-gy)/h)*((y-gy)/h)) AS dist FROM l JOIN pt ON pt.level = l.level AND abs(x-gx) < 900),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY dist, point_idx) AS rn FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY image_id, point_idx ORDER BY dist, gt_id) AS q FROM k WHERE rn <= 3)
SELECT image_id, point_idx, gt_id, round(dist, 6) AS dist FROM m WHERE q = 1
""")
def a8_nearest_points(spark, sf_dir):
    pts = grids.point_grid(spark, [(50, 50), (25, 25), (13, 13)], [8, 16, 32]).withColumn("level", F.col("level") + 3)
    return assign.assign_points(pts, fixture(spark, sf_dir, "fx_gts")).select("image_id", "point_idx", "gt_id", *r6("dist"))


@query(f"""WITH {ASSIGN_SQL}, d AS (SELECT s.*, dd.x1, dd.y1, dd.x2, dd.y2 FROM s JOIN fx_dets dd ON dd.det_id = s.box_id WHERE dd.x2 >= dd.x1 AND dd.y2 >= dd.y1)
SELECT d.box_id, CASE WHEN d.assigned = 1 THEN g.label ELSE 0 END AS label, CASE WHEN d.assigned = 1 THEN g.x1 ELSE 0 END AS t_x1, CASE WHEN d.assigned = 1 THEN g.y2 ELSE 0 END AS t_y2,
  row_number() OVER (PARTITION BY d.box_id % 3 ORDER BY d.image_id, d.box_id) - 1 AS position FROM d LEFT JOIN fx_gts g ON g.gt_id = d.gt_id""")
def a17_a18_point_targets(spark, sf_dir):
    t = assign.point_targets(_assigned(spark, sf_dir), fixture(spark, sf_dir, "fx_gts"))
    return assign.by_level(t.withColumn("level", F.col("box_id") % 3)).select("box_id", "label", "t_x1", "t_y2", "position")


@query(f"""WITH {ASSIGN_SQL}, d AS (SELECT s.box_id, s.assigned, g.label, dd.x1, dd.x2, g.x1 AS gx1, g.x2 AS gx2 FROM s JOIN fx_dets dd ON dd.det_id = s.box_id LEFT JOIN fx_gts g ON g.gt_id = s.gt_id WHERE dd.x2 >= dd.x1 AND dd.y2 >= dd.y1)
SELECT box_id, k, round(CASE WHEN assigned = 1 AND k = label THEN ((gx1+gx2)-(x1+x2))/2/(x2-x1+1) ELSE 0 END, 6) AS dx, CASE WHEN assigned = 1 AND k = label THEN 1.0::DOUBLE ELSE 0 END AS weight
FROM d, (SELECT unnest(range(0, 6)) AS k)""")
def a16_roi_targets(spark, sf_dir):
    a = _assigned(spark, sf_dir).where("x2 >= x1 AND y2 >= y1")
    t = assign.roi_targets(assign.anchor_targets(a, fixture(spark, sf_dir, "fx_gts")), 6)
    k = t.select("box_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("k"), "deltas", "weights")
    at = lambda c: F.element_at(c, (F.col("k") * 4 + 1).cast("int"))
    return k.select("box_id", "k", F.round(at("deltas"), 6).alias("dx"), at("weights").alias("weight"))


@query("""
WITH lv AS (SELECT unnest([0,1,2]) AS level, unnest([8,16,32]) AS s, unnest([32.0::DOUBLE,64,128]) AS base, unnest([16.0::DOUBLE,32,64]) AS lo, unnest([64.0::DOUBLE,128,256]) AS hi, unnest([49,24,12]) AS lr, unnest([62,31,15]) AS lc),
g AS (SELECT *, sqrt((x2-x1)*(y2-y1)) AS size, x1/s AS fx, (x2/s-x1/s)*0.5::DOUBLE AS hw, y1/s AS fy, (y2/s-y1/s)*0.5::DOUBLE AS hh FROM fx_gts, lv WHERE sqrt((x2-x1)*(y2-y1)) BETWEEN lo AND hi),
p AS (SELECT *, CAST(least(greatest(ceil(fx+hw*0.6::DOUBLE-0.5::DOUBLE),0),lc) AS BIGINT) AS c1, CAST(least(greatest(floor(fx+hw*1.4::DOUBLE-0.5::DOUBLE),0),lc) AS BIGINT) AS c2,
  CAST(least(greatest(ceil(fy+hh*0.6::DOUBLE-0.5::DOUBLE),0),lr) AS BIGINT) AS r1, CAST(least(greatest(floor(fy+hh*1.4::DOUBLE-0.5::DOUBLE),0),lr) AS BIGINT) AS r2 FROM g),
r AS (SELECT *, unnest(range(r1, r2+1)) AS "row" FROM p), c AS (SELECT *, unnest(range(c1, c2+1)) AS col FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, level, "row", col ORDER BY size, gt_id) AS rn, (col+0.5::DOUBLE)*s AS x, ("row"+0.5::DOUBLE)*s AS y FROM c)
SELECT image_id, level, "row", col, gt_id, label, round(ln(least(greatest((x-x1)/base,1/16.0::DOUBLE),16)),6) AS t0, round(ln(least(greatest((y-y1)/base,1/16.0::DOUBLE),16)),6) AS t1,
  round(ln(least(greatest((x2-x)/base,1/16.0::DOUBLE),16)),6) AS t2, round(ln(least(greatest((y2-y)/base,1/16.0::DOUBLE),16)),6) AS t3 FROM k WHERE rn = 1
""")
def a10_fovea_targets(spark, sf_dir):
    t = assign.fovea_targets(fixture(spark, sf_dir, "fx_gts"), [(50, 63), (25, 32), (13, 16)], assign.FOVEA_LEVELS[1:4])
    return t.select("image_id", "level", "row", "col", "gt_id", "label", *r6("t0", "t1", "t2", "t3"))


# ------------------------------------------------------------------ losses


def _far_sql(v: str) -> str:
    return f"abs((g.{v}1+g.{v}2)*0.5::DOUBLE-(d.{v}1+d.{v}2)*0.5::DOUBLE)*2"


def _centre_sql(v: str) -> str:
    return f"1-greatest((g.{v}2-g.{v}1+1-{_far_sql(v)})/(g.{v}2-g.{v}1+1+{_far_sql(v)}+0.001::DOUBLE),0)"


def _side_sql(v: str) -> str:
    a, b = f"(d.{v}2-d.{v}1+1)", f"(g.{v}2-g.{v}1+1)"
    return f"1-least({b}/({a}+0.001::DOUBLE),{a}/({b}+0.001::DOUBLE))"


def _smooth_sql(v: str) -> str:
    return f"CASE WHEN abs({v}) < 0.2 THEN {v}*{v}*0.5/0.2::DOUBLE ELSE abs({v})-0.1::DOUBLE END"


@query(f"""
WITH b AS (SELECT d.det_id, {_centre_sql('x')} AS a0, {_centre_sql('y')} AS a1, {_side_sql('x')} AS a2, {_side_sql('y')} AS a3 FROM fx_dets d JOIN fx_gts g ON g.gt_id = d.det_id // 3)
SELECT det_id, {', '.join(R(_smooth_sql(f'a{i}'), f'l{i}') for i in range(4))} FROM b
""")
def m16_bounded_iou(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").select("det_id", F.floor(F.col("det_id") / 3).alias("gt_id"), *XY)
    j = d.join(fixture(spark, sf_dir, "fx_gts").select("gt_id", *[F.col(c).alias("t_" + c) for c in XY]), "gt_id")
    return j.select("det_id", *[F.round(v, 6).alias(f"l{i}") for i, v in enumerate(losses.bounded_iou("", "t_"))])


# ------------------------------------------------------------------ suppression and heads


@query(f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) AS rn FROM fx_dets),
p AS (SELECT a.image_id, a.label, a.rn AS i, b.rn AS j FROM d a JOIN d b ON a.image_id = b.image_id AND a.label = b.label AND a.rn < b.rn WHERE {iou_sql('a.', 'b.')} > 0.5),
o AS (SELECT image_id, label, j, list(i ORDER BY i) AS above FROM p GROUP BY 1, 2, 3),
r AS (SELECT image_id, label, 1::BIGINT AS rn, [1::BIGINT] AS lead, [1::BIGINT] AS own FROM d WHERE rn = 1
  UNION ALL SELECT d.image_id, d.label, d.rn, CASE WHEN len(list_filter(coalesce(o.above, []), lambda x: list_contains(r.lead, x))) > 0 THEN r.lead ELSE list_append(r.lead, d.rn) END,
    list_append(r.own, coalesce(list_filter(coalesce(o.above, []), lambda x: list_contains(r.lead, x))[1], d.rn))
  FROM r JOIN d ON d.image_id = r.image_id AND d.label = r.label AND d.rn = r.rn + 1 LEFT JOIN o ON o.image_id = d.image_id AND o.label = d.label AND o.j = d.rn),
t AS (SELECT image_id, label, arg_max(own, rn) AS own FROM r GROUP BY 1, 2),
u AS (SELECT image_id, label, unnest(own) AS lead, unnest(range(1, len(own) + 1)) AS rn FROM t),
c AS (SELECT d.*, u.lead FROM d JOIN u USING (image_id, label, rn)),
g AS (SELECT image_id, label, lead, count(*) AS members, max(score) AS score, sum(x1*score)/sum(score) AS vx1, sum(y2*score)/sum(score) AS vy2, min(x1) AS sx1, min(y2) AS sy2 FROM c GROUP BY 1, 2, 3)
SELECT g.image_id, g.label, d.det_id, members, round(g.score, 6) AS score, round(CASE WHEN members = 1 THEN sx1 ELSE vx1 END, 6) AS x1, round(CASE WHEN members = 1 THEN sy2 ELSE vy2 END, 6) AS y2
FROM g JOIN d ON d.image_id = g.image_id AND d.label = g.label AND d.rn = g.lead
""")
def n5_voted_boxes(spark, sf_dir):
    return nms.bbox_voting(fixture(spark, sf_dir, "fx_dets"), ["image_id", "label"], 0.5).select("image_id", "label", "det_id", "members", *r6("score", "x1", "y2"))


HEAD = f"""{ANCHOR_SQL},
raw AS (SELECT image_id, anchor_idx, s1, s2, greatest(s1, s2) AS score, dx, dy, dw, dh FROM (SELECT *, row_number() OVER (PARTITION BY image_id, anchor_idx ORDER BY pred_id) AS once FROM fx_raw_preds) WHERE once = 1),
j AS (SELECT r.*, a.level, ax1, ay1, ax2, ay2, row_number() OVER (PARTITION BY image_id, a.level ORDER BY score DESC, r.anchor_idx) AS q FROM raw r JOIN anchors a ON a.anchor_idx = r.anchor_idx),
d0 AS (SELECT *, (ax1+ax2)*0.5+(ax2-ax1+1)*dx AS gx, (ay1+ay2)*0.5+(ay2-ay1+1)*dy AS gy, (ax2-ax1+1)*exp(dw) AS gw, (ay2-ay1+1)*exp(dh) AS gh FROM j WHERE q <= 20),
dec AS (SELECT image_id, level, anchor_idx AS det_id, s1, s2, score, least(greatest(gx-gw*0.5+0.5,0),799) AS x1, least(greatest(gy-gh*0.5+0.5,0),799) AS y1, least(greatest(gx+gw*0.5-0.5,0),799) AS x2, least(greatest(gy+gh*0.5-0.5,0),799) AS y2 FROM d0)"""


def _raw(spark, sf_dir):
    t = fixture(spark, sf_dir, "fx_raw_preds")
    once = t.groupBy("image_id", "anchor_idx").agg(F.min_by(F.struct("dx", "dy", "dw", "dh", "s1", "s2"), "pred_id").alias("p"))
    return once.select("image_id", "anchor_idx", "p.*").withColumn("scores", F.array("s1", "s2")).withColumn("score", F.greatest("s1", "s2"))


def _after(first: str, sql: str) -> str:
    """The suppression's SQL with common table expressions before its own."""
    return sql.replace("WITH RECURSIVE ", f"WITH RECURSIVE {first}, ", 1)


@query(_after(HEAD + ", cls AS (SELECT image_id, 0 AS label, det_id, s1/2 AS score, x1/2 AS x1, y1/2 AS y1, x2/2 AS x2, y2/2 AS y2 FROM dec WHERE s1 > 0.3 UNION ALL SELECT image_id, 1, det_id, s2/2, x1/2, y1/2, x2/2, y2/2 FROM dec WHERE s2 > 0.3)", nms_sql("cls", "image_id, label", 0.3)) + """,
f AS (SELECT image_id, label, k.det_id AS det_id, k.score * 2 AS score, k.x1 AS x1, row_number() OVER (PARTITION BY image_id ORDER BY k.score DESC, label, k.det_id) AS rn FROM kept)
SELECT image_id, label, det_id, round(score, 6) AS score, round(x1, 6) AS x1 FROM f WHERE rn <= 30""")
def n7_decode_head(spark, sf_dir):
    t = nms.decode_head(_raw(spark, sf_dir), grids.anchor_grid(spark, 800, 800), nms_pre=20, score_thr=0.3, iou_thr=0.3, max_per_img=30, max_w=800, max_h=800, scale=2.0)
    return t.select("image_id", "label", "det_id", *r6("score", "x1"))


@query(_after(HEAD + ", big AS (SELECT image_id, level, det_id, score, x1, y1, x2, y2 FROM dec WHERE x2-x1+1 >= 20 AND y2-y1+1 >= 20)", nms_sql("big", "image_id, level", 0.4)) + """,
f AS (SELECT image_id, k.det_id AS det_id, k.score AS score, k.x1 AS x1, row_number() OVER (PARTITION BY image_id, level ORDER BY k.score DESC, k.det_id) AS rn FROM kept),
h AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS q FROM f WHERE rn <= 15)
SELECT image_id, det_id, round(score, 6) AS score, round(x1, 6) AS x1 FROM h WHERE q <= 40""")
def n8_rpn_proposals(spark, sf_dir):
    t = nms.rpn_proposals(_raw(spark, sf_dir), grids.anchor_grid(spark, 800, 800), 20, 15, 40, 0.4, 20, max_w=800, max_h=800)
    return t.select("image_id", "det_id", *r6("score", "x1"))


@query(nms_sql("(SELECT image_id, det_id, score, (CASE WHEN det_id % 2 = 0 THEN 800-x2*2-1 ELSE x1*2 END)/2 AS x1, y1*2/2 AS y1, (CASE WHEN det_id % 2 = 0 THEN 800-x1*2-1 ELSE x2*2 END)/2 AS x2, y2*2/2 AS y2 FROM fx_dets)", "image_id", 0.3) + """,
f AS (SELECT image_id, k.det_id AS det_id, k.score AS score, row_number() OVER (PARTITION BY image_id ORDER BY k.score DESC, k.det_id) AS rn FROM kept) SELECT image_id, det_id, round(score, 6) AS score FROM f WHERE rn <= 12""")
def n9_merge_proposals(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").select("image_id", "det_id", "score", *[(F.col(c) * 2).alias(c) for c in XY], F.lit(800.0).alias("img_w"), F.lit(2.0).alias("scale"), (F.col("det_id") % 2 == 0).alias("flip"))
    return nms.merge_aug_proposals(d, 0.3, 12).select("image_id", "det_id", *r6("score"))


@query("""
WITH v AS (SELECT image_id, gt_id AS mask_id, unnest([x1, y1, x2, y2, 1.0::DOUBLE, 2.0::DOUBLE]) AS v, unnest(range(0, 6)) AS p FROM fx_gts),
f AS (SELECT image_id, mask_id, v, CASE WHEN p < 3 THEN 2 - p ELSE 8 - p END AS p FROM v)
SELECT v.image_id, v.mask_id, v.p, round((v.v * 1 + f.v * 3) / 4, 6) AS value FROM v JOIN f USING (image_id, mask_id, p)
""")
def n11_merge_masks(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts").select("image_id", F.col("gt_id").alias("mask_id"), F.lit(3).alias("width"), F.array(*XY, F.lit(1.0), F.lit(2.0)).alias("values"))
    both = g.withColumns({"flip": F.lit(False), "weight": F.lit(1.0)}).unionByName(g.withColumns({"flip": F.lit(True), "weight": F.lit(3.0)}))
    return nms.merge_aug_masks(both, weights=True).select("image_id", "mask_id", F.posexplode("values").alias("p", "v")).select("image_id", "mask_id", F.col("p").cast("long").alias("p"), F.round("v", 6).alias("value"))


@query(f"SELECT det_id AS box_id, label, {R('(x1+x2)*0.5+(x2-x1+1)*label*0.01-(x2-x1+1)*0.5+0.5', 'x1')} FROM fx_dets WHERE det_id % 7 > 0")
def g8_n13_refine(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").withColumn("label", F.col("label").cast("int"))
    deltas = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.array(k * 0.01, F.lit(0.0), F.lit(0.0), F.lit(0.0))))
    t = nms.refine_bboxes(d.select("image_id", F.col("det_id").alias("box_id"), *XY, "label", deltas.alias("deltas"), (F.col("det_id") % 7 == 0).alias("is_gt")))
    return t.select("box_id", F.col("label").cast("long").alias("label"), *r6("x1"))


# ------------------------------------------------------------------ sampling


@query("SELECT image_id, det_id AS box_id, false AS is_gt, NULL::DOUBLE AS max_iou FROM fx_dets UNION ALL SELECT image_id, gt_id, true, 1.0 FROM fx_gts")
def d3_add_truths(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").select("image_id", F.col("det_id").alias("box_id"), *XY)
    return sampling.add_gt_as_proposals(d, fixture(spark, sf_dir, "fx_gts")).select("image_id", "box_id", "is_gt", "max_iou")


@query("""
WITH a AS (SELECT det_id, 0 AS rank, row_number() OVER (ORDER BY det_id) - 1 AS n FROM fx_dets WHERE det_id % 2 = 0 UNION ALL SELECT det_id, 1, row_number() OVER (ORDER BY det_id) - 1 FROM fx_dets WHERE det_id % 2 = 1)
SELECT det_id, rank, n * 2 + rank AS position FROM a WHERE n * 2 + rank < (SELECT count(*) FROM fx_gts)
""")
def d4_interleave(spark, sf_dir):
    d = fixture(spark, sf_dir, "fx_dets").select("det_id")
    size = fixture(spark, sf_dir, "fx_gts").count()
    return sampling.interleave([d.where("det_id % 2 = 0"), d.where("det_id % 2 = 1")], size, "det_id")


@query(f"""WITH {ASSIGN_SQL}, p_ AS (SELECT *, {LCG.format(c='box_id', s=4)} AS r FROM s WHERE assigned = 1),
g_ AS (SELECT *, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY r, box_id) AS k FROM p_), n_ AS (SELECT image_id, count(DISTINCT gt_id) AS n FROM p_ GROUP BY 1),
q_ AS (SELECT g.*, CASE WHEN k > round_even(8.0::DOUBLE / n_.n, 0) + 1 THEN 1 ELSE 0 END AS late FROM g_ AS g JOIN n_ USING (image_id)),
pos AS (SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY late, r, box_id) AS rn FROM q_),
e_ AS (SELECT *, {LCG.format(c='box_id', s=4)} AS r, max(max_iou) OVER (PARTITION BY image_id) AS top FROM s WHERE assigned = 0),
b_ AS (SELECT *, CASE WHEN top > 0 THEN least(floor(max_iou/top*3), 2) ELSE 0 END AS bin FROM e_),
c_ AS (SELECT *, row_number() OVER (PARTITION BY image_id, bin ORDER BY r, box_id) AS k FROM b_),
neg AS (SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN k > 3 THEN 1 ELSE 0 END, r, box_id) AS rn FROM c_)
SELECT image_id, box_id, 1 AS assigned FROM pos WHERE rn <= 8 UNION ALL SELECT image_id, box_id, 0 FROM neg WHERE rn <= 9""")
def d6_d7_d8_balanced_samples(spark, sf_dir):
    a = materialise(_assigned(spark, sf_dir))
    t = sampling.sample_combined(sampling.sample_instance_balanced(a, 8, 4), sampling.sample_iou_balanced_neg(a, 9, 3, 4))
    return t.select("image_id", "box_id", "assigned")


@query(f"""WITH {ASSIGN_SQL}, u AS (SELECT s.*, row_number() OVER (PARTITION BY s.image_id, assigned ORDER BY d.score DESC, box_id) AS rn, sum(CASE WHEN assigned = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY s.image_id) AS n FROM s JOIN fx_dets d ON d.det_id = box_id WHERE assigned >= 0)
SELECT image_id, box_id, assigned FROM u WHERE assigned = 1 OR rn <= n * 0.5::DOUBLE""")
def d10_hard_negatives(spark, sf_dir):
    a = _assigned(spark, sf_dir).join(fixture(spark, sf_dir, "fx_dets").select(F.col("det_id").alias("box_id"), F.col("score").alias("loss")), "box_id")
    return sampling.hard_negatives(a, 0.5).select("image_id", "box_id", "assigned")


@query(f"""
WITH f AS (SELECT image_id, CASE WHEN width > height THEN 1 ELSE 0 END AS flag FROM fx_slides),
o AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY {LCG.format(c='image_id', s=6)}, image_id)-1 AS i, count(*) OVER (PARTITION BY flag) AS n FROM f),
t AS (SELECT *, CAST(ceil(n/8.0::DOUBLE) AS BIGINT)*8 AS total FROM o)
SELECT image_id, flag, p AS position, p // 8 AS batch, {LCG.format(c='(p // 8)*2+flag', s=6)} AS batch_key FROM t, LATERAL (SELECT unnest(range(i, total, n)) AS p)
""")
def d11_group_batches(spark, sf_dir):
    s = fixture(spark, sf_dir, "fx_slides").withColumn("flag", G.aspect_flag(F.col("width"), F.col("height")))
    return sampling.group_batches(s.select("image_id", "flag"), 8, 6).select("image_id", "flag", "position", "batch", "batch_key")


def _start(lo: str, hi: str, size: int, p: int, k: int) -> str:
    a = f"greatest({hi}-{p}, 0)"
    return f"floor({a} + {LCG.format(c='image_id', s=5 + k)}/1000003.0::DOUBLE*(greatest(least({lo}+1, {size}-{p}+1), {a}+1) - {a}))"


@query(f"""
WITH g AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {LCG.format(c='gt_id', s=5)}, gt_id) AS rn FROM fx_gts)
SELECT image_id, gt_id, {_start('x1', 'x2', 500, 200, 1)} AS wx1, {_start('y1', 'y2', 400, 200, 2)} AS wy1 FROM g WHERE rn = 1
""")
def d14_crop_windows(spark, sf_dir):
    i = fixture(spark, sf_dir, "fx_gts").select("image_id").distinct().withColumn("width", F.lit(500)).withColumn("height", F.lit(400))
    return sampling.choose_crops(i, fixture(spark, sf_dir, "fx_gts"), (200, 200), 5).select("image_id", "gt_id", "wx1", "wy1")


# ------------------------------------------------------------------ masks


@query("""
SELECT gt_id, CAST(x1 AS BIGINT)+3 AS area, round(score * (CASE label WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 0.2 WHEN 3 THEN 0.3 WHEN 4 THEN 0.4 ELSE 0.5 END), 6) AS mask_score,
  round(10/(20+30/greatest(0.5::DOUBLE,0.0000001)-10), 6) AS target, CAST(x1 AS BIGINT) AS first_part
FROM (SELECT gt_id, label, x1, (gt_id % 100)/100.0::DOUBLE AS score FROM fx_gts)
""")
def p1_p3_x4_masks(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts").withColumn("score", (F.col("gt_id") % 100) / 100.0)
    rle = F.array(F.lit(5).cast("long"), F.col("x1").cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"))
    parts = masks.split_polys(F.array("x1", "y1", "x2", "y2"), F.array(F.lit(1), F.lit(3)))
    lit = lambda v: F.lit(float(v))
    return g.select(
        "gt_id", masks.rle_area(rle).alias("area"), F.round(masks.mask_score(F.col("score"), F.array(*[lit(v / 10) for v in range(1, 6)]), F.col("label").cast("int")), 6).alias("mask_score"),
        F.round(masks.mask_iou_target(lit(20), lit(10), lit(30), lit(0.5)), 6).alias("target"), F.element_at(F.element_at(parts, 1), 1).cast("long").alias("first_part"),
    )


@query("""
WITH a AS (SELECT gt_id, gt_id % 7 AS s, 3 + gt_id % 5 AS n, gt_id % 11 AS t, 2 + gt_id % 9 AS m FROM fx_gts)
SELECT gt_id, round(coalesce(greatest(least(s+n, t+m)-greatest(s, t), 0)::DOUBLE/nullif(n+m-greatest(least(s+n, t+m)-greatest(s, t), 0), 0), 0), 6) AS iou FROM a
""")
def p1_rle_iou(spark, sf_dir):
    g = fixture(spark, sf_dir, "fx_gts")
    run = lambda s, n: F.array((F.col("gt_id") % s).cast("long"), n.cast("long"), F.lit(30).cast("long"))
    return g.select("gt_id", F.round(masks.rle_iou(run(7, 3 + F.col("gt_id") % 5), run(11, 2 + F.col("gt_id") % 9)), 6).alias("iou"))
