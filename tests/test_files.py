"""COCO documents read by byte ranges, wherever a range cuts them; headers of pictures."""

import json

import pytest

from boxloom.sources import files, readers

ANNS = [
    {"id": 1, "image_id": 10, "category_id": 3, "bbox": [1, 2.5, 3, 4], "area": 12, "iscrowd": 0, "segmentation": [[1, 2, 3, 4, 5, 6]]},
    {"segmentation": {"counts": [5, 6], "size": [20, 30]}, "id": 2, "image_id": 10, "category_id": 7, "bbox": [0, 0, 5, 5], "area": 25.5, "iscrowd": 1},
    {"id": 3, "image_id": 11, "category_id": 3, "bbox": [0, 0, 2, 2], "area": 4, "iscrowd": 0, "ignore": True, "note": 'a { "brace" } in a text, ünïcödé 中 😀'},
]
DOC = {
    "info": {"description": "x {y}", "id": 5}, "licenses": [{"id": 1, "url": "u"}],
    "images": [{"id": 10, "file_name": "ä{.jpg", "width": 20, "height": 30, "license": 1}, {"id": 11, "file_name": "中文.png", "width": 5, "height": 6}],
    "annotations": ANNS, "categories": [{"id": 7, "name": "zürich", "supercategory": "b"}, {"id": 3, "name": "cé", "supercategory": "a"}],
}


def read_all(path, size):
    reader = files.CocoReader({"path": str(path), "rangeBytes": str(size)})
    parts = reader.partitions()
    return len(parts), [r for p in parts for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("escaped", [True, False])
@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_of_every_size(tmp_path, escaped, indent, monkeypatch):
    monkeypatch.setattr(files, "TAIL", 7)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(DOC, ensure_ascii=escaped, indent=indent), encoding="utf-8")
    want = None
    for size in (10**6, 1, 2, 3, 5, 17, 64, 100, 333):
        n, rows = read_all(path, size)
        rows = sorted(rows, key=lambda r: (r["kind"], r["id"]))
        want = want or rows
        assert rows == want and n == -(-path.stat().st_size // size)
    assert [(r["kind"], r["id"]) for r in want] == [("annotation", 1), ("annotation", 2), ("annotation", 3), ("category", 3), ("category", 7), ("image", 10), ("image", 11)]
    assert want[0]["bbox"] == [1.0, 2.5, 3.0, 4.0] and want[2]["ignore"] is True and want[4]["name"] == "zürich" and want[6]["file_name"] == "中文.png"


def test_one_document_over_several_tasks(spark, tmp_path):
    anns = [{"id": i, "image_id": i // 7, "category_id": 3 + 4 * (i % 2), "bbox": [i, 1, 10, 20], "area": 200, "iscrowd": 0} for i in range(5000)]
    (tmp_path / "big.json").write_text(json.dumps({**DOC, "annotations": anns}))
    images, a, cats = readers.read_coco(spark, str(tmp_path / "big.json"), range_bytes=20_000)
    src = spark.read.format("coco_objects").option("rangeBytes", 20_000).load(str(tmp_path / "big.json"))
    assert src.rdd.getNumPartitions() > 10
    whole = readers.read_coco_whole(spark, str(tmp_path / "big.json"))
    for got, exp in zip((images, a, cats), whole, strict=True):
        assert sorted(map(str, got.select(*exp.columns).collect())) == sorted(map(str, exp.collect()))
    assert {(r.id, r.label) for r in cats.collect()} == {(3, 1), (7, 2)} and a.count() == 5000


def test_headers(spark, tmp_path):
    head = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(head + b"x" * 1000)
    (tmp_path / "b.png").write_bytes(b"no picture at all, but long enough")
    (tmp_path / "c.png").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(head)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.width, r.height) for r in readers.image_catalog(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (1024, 640, 480), "b.png": (34, None, None), "c.png": (0, None, None)}
