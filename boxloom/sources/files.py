"""Data sources that plan byte ranges: one large COCO document over many tasks, and picture headers without the pictures.

Paths are what pyarrow opens: local and mounted folders, s3://, gs://, hdfs://. Files are listed once, by the driver; tasks read their ranges.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The keys by which the three kinds of COCO objects are told from others.
KINDS = {"annotation": ("id", "image_id", "category_id"), "image": ("id", "file_name"), "category": ("id", "name")}
COCO_ROWS = (
    "kind string, id bigint, image_id bigint, category_id int, bbox array<double>, area double, iscrowd int, ignore boolean, "
    "file_name string, width int, height int, name string, supercategory string"
)
_FRAME = re.compile(r'\s*"(?:images|annotations|categories|info|licenses)"\s*:')
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in COCO_ROWS.split(", "))])
#: What a task reads at a time beyond its range to finish an object that began in it.
TAIL = 1 << 20


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files at or below ``path``, in order."""
    store, at = fs.FileSystem.from_uri(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith(("_", ".")))


class Range(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def objects(text: str, end: int, more: Callable[[], str]) -> Iterator[tuple[str, dict]]:
    """(kind, object) of every COCO object of ``text`` whose brace opens before ``end``.

    ``more()`` gives what follows the text, and nothing at the end of the file; it is asked while an object runs out of the text. A
    brace that opens something else (the frame of the document, a mask, a brace within a name) is passed by, and what it holds is looked at.
    """
    decoder, at = json.JSONDecoder(), 0
    while (m := text.find("{", at)) >= 0 and m < end:
        at = m + 1
        if _FRAME.match(text, at):
            continue
        while True:
            try:
                found, stop = decoder.raw_decode(text, m)
            except json.JSONDecodeError as e:
                # cut off at the end of the text, or no object at all
                rest = more() if e.msg.startswith("Unterminated string") or e.pos >= len(text) - 16 else ""
                if rest:
                    text += rest
                    continue
                found, stop = {}, at
            break
        kind = next((k for k in KINDS if all(x in found for x in KINDS[k])), None)
        if kind:
            yield kind, found
            at = stop


class CocoReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", 32 << 20))

    def partitions(self):
        return [Range([(path, at, min(at + self.size, size))]) for path, size in listed(self.path, ".json") for at in range(0, size, self.size)] or [Range([])]

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.path)
        for path, start, end in partition.files:
            with store.open_input_file(path) as f:
                f.seek(start)
                raw = f.read(end - start)
                # a letter that the range cuts belongs to a text of an object that began before it
                text, over = raw.decode("utf-8", "ignore"), io.TextIOWrapper(_Tail(raw, f), "utf-8", "ignore")
                cols: dict[str, list] = {n: [] for n in _SCHEMA.names}
                for kind, o in objects(text, len(text), lambda over=over: over.read(TAIL)):
                    box = o.get("bbox")
                    row = {**o, "kind": kind, "bbox": [float(v) for v in box] if box else None, "ignore": bool(o["ignore"]) if o.get("ignore") is not None else None}
                    for n, c in cols.items():
                        c.append(row.get(n))
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(_SCHEMA.names, _SCHEMA.types, strict=True)], schema=_SCHEMA)


class _Tail(io.RawIOBase):
    """What follows a range, led by the bytes of a letter that the range's end cuts."""

    def __init__(self, raw: bytes, f):
        cut = next((k for k in range(1, min(4, len(raw)) + 1) if raw[-k] >= 0xC0), 0)
        whole = not cut or cut >= (2 if raw[-cut] < 0xE0 else 3 if raw[-cut] < 0xF0 else 4)
        self.head, self.f = b"" if whole else raw[-cut:], f

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.head or self.f.read(len(b))
        self.head = b""
        b[: len(got)] = got
        return len(got)


class CocoSource(DataSource):
    """``spark.read.format("coco_objects").option("rangeBytes", n).load(path)``: images, annotations and categories of one or more documents."""

    @classmethod
    def name(cls) -> str:
        return "coco_objects"

    def schema(self) -> str:
        return COCO_ROWS

    def reader(self, schema):
        return CocoReader(self.options)


class HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.many = options["path"], int(options.get("filesPerTask", 1000))

    def partitions(self):
        files = [(path, 0, size) for path, size in listed(self.path, ".png")]
        return [Range(files[i : i + self.many]) for i in range(0, len(files), self.many)] or [Range([])]

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.path)
        for path, _, size in partition.files:
            with store.open_input_file(path) as f:
                head = f.read(24)
            known = len(head) == 24 and head[:8] == b"\x89PNG\r\n\x1a\n"
            yield path, size, int.from_bytes(head[16:20], "big") if known else None, int.from_bytes(head[20:24], "big") if known else None


class HeaderSource(DataSource):
    """``spark.read.format("png_headers").load(path)``: path, length, width and height of pictures, from 24 bytes of each; nulls for what is no picture."""

    @classmethod
    def name(cls) -> str:
        return "png_headers"

    def schema(self) -> str:
        return "path string, length bigint, width int, height int"

    def reader(self, schema):
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (CocoSource, HeaderSource):
        spark.dataSource.register(source)
