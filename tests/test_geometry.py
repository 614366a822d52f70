import pytest
from pyspark.sql import functions as F

from boxloom.functions import geometry as G
from boxloom.operators import grids, kernels, losses, masks, nms

B = "x1 double, y1 double, x2 double, y2 double"


def test_delta2bbox_exact_values(spark):
    rows = [(0.0, 0.0, 1.0, 1.0, [0.0, 0, 0, 0]), (0.0, 0.0, 1.0, 1.0, [1.0, 1, 1, 1]), (0.0, 0.0, 1.0, 1.0, [0.0, 0, 2, -1]), (5.0, 5.0, 5.0, 5.0, [0.7, -1.9, -0.5, 0.3])]
    rows = [(*r[:4], [float(x) for x in r[4]]) for r in rows]
    d = spark.createDataFrame(rows, B + ", d array<double>")
    b = G.delta2bbox(G.box(), [F.col("d")[i] for i in range(4)], max_w=32, max_h=32)
    got = [tuple(round(v, 4) for v in r) for r in d.select(*G.named(b)).collect()]
    assert got == [(0, 0, 1, 1), (0.2817, 0.2817, 4.7183, 4.7183), (0, 0.6321, 7.3891, 0.3679), (5.8967, 2.9251, 5.5033, 3.2749)]


def test_flip_twice_is_identity(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0, 9.0)], B)
    for way in ("horizontal", "vertical"):
        b = G.flip_box(G.flip_box(G.box(), F.lit(20), F.lit(30), way), F.lit(20), F.lit(30), way)
        assert tuple(d.select(*G.named(b)).first()) == (1, 2, 5, 9)
    with pytest.raises(ValueError):
        G.flip_box(G.box(), F.lit(1), F.lit(1), "diagonal")


def test_iou_of_empty_boxes_is_zero(spark):
    d = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], B)
    assert d.select(G.iou(G.box(), G.box(), offset=0)).first()[0] == 0
    assert d.select(G.iou(G.box(), G.box())).first()[0] == 1


def test_anchor_grid_2x2(spark):
    got = grids.anchor_grid(spark, 32, 32, (16,), (9 / 16,), (1.0,)).orderBy("anchor_idx").collect()
    # base 9: centre at 0.5 * (16 - 1) with the stride's own centre rule
    assert [(r.x2 - r.x1, r.y2 - r.y1) for r in got] == [(8, 8)] * 4
    assert [(r.row, r.col) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_anchor_count_of_a_tile(spark):
    assert grids.anchor_grid(spark, 800, 800).count() == 120_087


NMS4 = [(49.1, 32.4, 51.0, 35.9, 0.9), (49.3, 32.9, 51.0, 35.3, 0.9), (35.3, 11.5, 39.9, 14.5, 0.4), (35.2, 11.7, 39.7, 15.7, 0.3)]
NMS7 = NMS4[:2] + [(49.2, 31.8, 51.0, 35.4, 0.5), (35.1, 11.5, 39.1, 15.7, 0.5), (35.6, 11.8, 39.3, 14.2, 0.5)] + NMS4[2:]


@pytest.mark.parametrize("rows", [NMS4, NMS7])
@pytest.mark.parametrize("engine", ["fold", "numpy"])
def test_nms_golden(spark, rows, engine):
    d = spark.createDataFrame([(0, i, s, *b) for i, (*b, s) in enumerate(rows)], "image_id long, det_id long, score double, " + B)
    out = nms.nms(d, ["image_id"], 0.7, engine=engine)
    assert out.count() == 3
    assert sorted(r.det_id for r in nms.nms(out, ["image_id"], 0.7, engine=engine).collect()) == sorted(r.det_id for r in out.collect())


def test_soft_nms_keeps_order_and_decays(spark):
    d = spark.createDataFrame([(0, 0, 0.9, 0.0, 0.0, 9.0, 9.0), (0, 1, 0.8, 0.0, 0.0, 9.0, 9.0), (0, 2, 0.7, 50.0, 50.0, 59.0, 59.0)], "image_id long, det_id long, score double, " + B)
    got = {r.det_id: r.score for r in nms.soft_nms(d, ["image_id"], 0.3).collect()}
    assert got == {0: 0.9, 2: 0.7}  # an exact copy decays to nothing


def test_weighted_loss_values(spark):
    d = spark.createDataFrame([(0.0, 1.0, 1.0), (2.0, 1.0, 0.0), (3.0, 1.0, 1.0)], "p double, t double, w double")
    l1 = F.abs(F.col("p") - F.col("t"))
    one = lambda *a, **k: round(losses.loss_report(d, l1, *a, **k).first()["loss"], 4)
    assert one() == 1.3333
    assert one(F.col("w")) == 1.0
    assert one(F.col("w"), avg_factor=2) == 1.5
    with pytest.raises(ValueError):
        losses.loss_report(d, l1, reduction="sum", avg_factor=2)


def test_rle(spark):
    d = spark.createDataFrame([([2, 3, 5], [4, 4, 2])], "a array<int>, b array<int>")
    r = d.select(masks.rle_area(F.col("a")), masks.rle_intersection(F.col("a"), F.col("b")), masks.rle_iou(F.col("a"), F.col("b"))).first()
    assert (r[0], r[1], round(r[2], 4)) == (3, 1, round(1 / 6, 4))


def test_split_polys(spark):
    d = spark.createDataFrame([([1, 2, 3, 4, 5], [2, 3])], "p array<int>, n array<int>")
    assert d.select(masks.split_polys(F.col("p"), F.col("n"))).first()[0] == [[1, 2], [3, 4, 5]]


def test_pixels(spark):
    raw = bytes(range(12))
    d = spark.createDataFrame([(1, 2, 2, 3, bytearray(raw))], "image_id long, h int, w int, c int, pixels binary")
    assert bytes(masks.flip_pixels(d).first()["pixels"]) == bytes([3, 4, 5, 0, 1, 2, 9, 10, 11, 6, 7, 8])
    p = masks.pad_pixels(d, 4).first()
    assert (p["h"], p["w"], len(p["pixels"])) == (4, 4, 48)
    t = spark.createDataFrame([(1, 0, 1, 0)], "image_id long, tile_idx long, x long, y long")
    assert bytes(masks.cut_tiles(d, t, (1, 2)).first()["pixels"]) == bytes([3, 4, 5, 9, 10, 11])


def test_recall_kernel_takes_best_pairs():
    import numpy as np

    assert kernels.match_recall(np.array([[0.9, 0.8], [0.85, 0.1]])).tolist() == [0.9, 0.1]
