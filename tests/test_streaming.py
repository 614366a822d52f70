import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from boxloom.operators import nms
from boxloom.plans.fixtures import fixture
from boxloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def run(q, name, mode, wait=None):
    """All given files. A query with timeouts runs empty batches for ever, so it is stopped after ``wait`` seconds."""
    s = q.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    s.awaitTermination(wait) if wait else s.awaitTermination()
    s.stop()


def source(spark, df):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.repartition(3).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def files(spark, batches, schema):
    """A stream that gets one file a micro-batch, in this order, and the function that adds one more."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def add(rows):
        rows = rows if hasattr(rows, "write") else spark.createDataFrame(rows, schema)
        rows.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time of change

    for rows in batches:
        add(rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), add


def until(q, name, enough, most=120):
    """Rows of the memory sink once there are ``enough``, or what there is after ``most`` seconds."""
    end = time.time() + most
    while time.time() < end and q.exception() is None:
        rows = SparkSession.active().sql(f"select * from {name}").collect()
        if len(rows) >= enough:
            break
        time.sleep(1)
    assert q.exception() is None
    return rows


TILES = "image_id long, tile_idx long, tile_x long, tile_y long, tile_dets long, det_id long, score double, x1 double, y1 double, x2 double, y2 double"


def test_merge_tiles_equals_batch(spark):
    d = fixture(spark, SF, "fx_dets").where("x2 >= x1 AND y2 >= y1")
    t = d.select("image_id", (F.col("det_id") % 2).cast("long").alias("tile_idx"), F.lit(0).cast("long").alias("tile_x"), F.lit(0).cast("long").alias("tile_y"), "det_id", "score", "x1", "y1", "x2", "y2")
    n = t.groupBy("image_id", "tile_idx").agg(F.count("*").alias("tile_dets"))
    t = t.join(n, ["image_id", "tile_idx"]).select(*[c.split()[0] for c in TILES.split(", ")])
    plans = t.groupBy("image_id").agg(F.countDistinct("tile_idx").cast("int").alias("n_tiles"))
    half = (F.col("det_id") % 4) < 2
    # the detections of a tile come in two files, and the first file twice
    s, _ = files(spark, [t.where(half), t.where(half), t.where(~half)], t.schema)
    q = jobs.stream_merge_tiles(s, plans, timeout_ms=600_000).writeStream.format("memory").queryName("merged").outputMode("append").start()
    first = nms.nms(t, ["image_id", "tile_idx"], 0.5, keep_top_k=100)
    exp = sorted((r.image_id, r.det_id, True) for r in nms.nms(first, ["image_id"], 0.5).collect())
    got = until(q, "merged", len(exp))
    q.stop()
    assert sorted((r.image_id, r.det_id, r.complete) for r in got) == exp and exp


def test_merge_tiles_waits_for_whole_tiles(spark):
    """One tile's detections in two files, repeats, an empty tile, a missing tile, and rows after the end."""
    box = lambda k: (k / 10, 50.0 * k, 0.0, 50.0 * k + 20, 20.0)
    none = (None,) * 6
    batches = [[(1, 0, 0, 0, 2, 1, *box(1))], [(1, 0, 0, 0, 2, 2, *box(2)), (1, 0, 0, 0, 2, 2, *box(2))], [(1, 0, 0, 0, 2, 1, *box(1)), (3, 0, 0, 0, 0, *none), (3, 1, 0, 0, 1, 8, *box(4))], [(1, 1, 800, 0, 1, 3, *box(3))], [(1, 1, 800, 0, 1, 3, *box(3)), (2, 0, 0, 0, 2, 9, *box(1))]]
    plans = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "image_id long, n_tiles int")
    s, add = files(spark, batches, TILES)
    q = jobs.stream_merge_tiles(s, plans, timeout_ms=20_000).writeStream.format("memory").queryName("whole").outputMode("append").trigger(processingTime="1 second").start()
    want = {(1, 1, True), (1, 2, True), (1, 3, True), (3, 8, True), (2, 9, False)}
    assert {(r.image_id, r.det_id, r.complete) for r in until(q, "whole", 5)} == want
    add([(2, 0, 0, 0, 2, 10, *box(2)), (2, 1, 0, 0, 1, 11, *box(5)), (1, 0, 0, 0, 2, 12, *box(6))])  # too late
    add([(4, 0, 0, 0, 1, 13, *box(1))])  # of no plan
    time.sleep(12)
    rows = spark.sql("select * from whole").collect()
    q.stop()
    assert len(rows) == 5 and {(r.image_id, r.det_id, r.complete) for r in rows} == want
    assert {r.det_id: r.x1 for r in rows}[3] == 800 + 150


def test_histogram_with_momentum(spark):
    import numpy as np

    from boxloom.operators import losses

    rng = np.random.RandomState(1)
    batches = [[(int(k), float(v)) for k, v in zip(rng.randint(0, 2, n), rng.rand(n) ** 2 * 1.05, strict=True)] for n in (200, 1, 90)]
    batches[0] += [(0, None), (0, 1.0)]
    s, _ = files(spark, batches, "run_id long, g double")
    run(jobs.stream_histogram(s, ["run_id"], "g", 10, 0.75), "bins", "update")
    acc = np.zeros((2, 10))
    want = set()
    for rows in batches:
        n = np.zeros((2, 10), int)
        for k, v in rows:
            if v is not None and v <= 1:
                n[k, min(int(v * 10), 9)] += 1
        acc = np.where(n > 0, 0.75 * acc + 0.25 * n, acc)
        want |= {(k, b, int(n[k, b]), round(acc[k, b], 9), int(n[k].sum())) for k in range(2) for b in range(10) if n[k, b]}
    got = spark.table("bins")
    assert {(r.run_id, r.bin, r.n, round(r.acc, 9), r.total) for r in got.collect()} == want
    # the running counts weigh the examples of the next batch
    last = spark.createDataFrame([(b, float(acc[0, b])) for b in range(10)], "bin int, acc double")
    t = spark.createDataFrame([(0.05,), (0.06,), (0.55,)], "g double")
    w = {round(r.g, 2): r.weight for r in losses.ghm_weights(t, F.col("g"), counts=last).collect()}
    assert abs(w[0.05] - 3 / (acc[0, 0] * 2)) < 1e-9 and abs(w[0.55] - 3 / (acc[0, 5] * 2)) < 1e-9


def test_hits_and_other_windows(spark):
    from boxloom.functions.geometry import Box, box, iou

    d, g = fixture(spark, SF, "fx_dets"), fixture(spark, SF, "fx_gts")
    run(jobs.stream_hits(source(spark, d), g, 0.5), "hits", "complete")
    pair = d.join(g.select("image_id", "label", *[F.col(c).alias("g_" + c) for c in ("x1", "y1", "x2", "y2")]), ["image_id", "label"], "left")
    hit = pair.groupBy("label", "det_id").agg(F.max(F.coalesce((iou(box(), Box(*[F.col("g_" + c) for c in ("x1", "y1", "x2", "y2")])) >= 0.5).cast("long"), F.lit(0))).alias("hit"))
    exp = hit.groupBy("label").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).collect()
    assert sorted(map(tuple, spark.table("hits").collect())) == sorted(map(tuple, exp))
    t = fixture(spark, SF, "fx_logs").withColumn("ts", F.col("ts").cast("timestamp"))
    run(jobs.stream_log_windows(source(spark, t), "session", watermark="900 days"), "w_session", "complete")
    key = lambda r: (r["start"], r["end"], r["run_id"], r["n"], round(r["mean"], 9))
    assert sorted(map(key, spark.table("w_session").collect())) == sorted(map(key, jobs.stream_log_windows(t, "session").collect()))


def test_exponential_mean(spark):
    s, _ = files(spark, [[(1, 4.0)], [(1, 8.0), (2, 1.0)], [(1, 2.0)]], "run_id long, time double")
    run(jobs.stream_running_mean(s, ["run_id"], momentum=0.5), "decayed", "update")
    assert {(r.run_id, r.n): r["mean"] for r in spark.table("decayed").collect()} == {(1, 1): 4.0, (1, 2): 6.0, (2, 1): 1.0, (1, 3): 4.0}


def test_log_windows_equal_batch(spark):
    t = fixture(spark, SF, "fx_logs").withColumn("ts", F.col("ts").cast("timestamp"))
    for kind in ("tumbling", "sliding"):
        run(jobs.stream_log_windows(source(spark, t), kind, watermark="900 days"), f"w_{kind}", "complete")
        key = lambda r: (r["start"], r["end"], r["run_id"], r["n"], round(r["mean"], 9))
        assert sorted(map(key, spark.table(f"w_{kind}").collect())) == sorted(map(key, jobs.stream_log_windows(t, kind).collect()))


def test_dedupe(spark):
    t = fixture(spark, SF, "fx_logs").withColumn("ts", F.col("ts").cast("timestamp"))
    run(jobs.stream_dedupe(source(spark, t.unionByName(t)), ["event_id"], bound="900 days"), "once", "append")
    assert spark.table("once").count() == t.count()


def test_running_mean(spark):
    t = fixture(spark, SF, "fx_logs").select("run_id", "time")
    run(jobs.stream_running_mean(source(spark, t), ["run_id"]), "means", "update")
    got = {r.run_id: (r.n, r.mean) for r in spark.sql("select run_id, max_by(n, n) n, max_by(mean, n) mean from means group by run_id").collect()}
    for r in t.groupBy("run_id").agg(F.count("*").alias("n"), F.avg("time").alias("m")).collect():
        assert got[r.run_id][0] == r.n and abs(got[r.run_id][1] - r.m) < 1e-9
