"""Shared helpers: tables in the shared folder, and vectorised hashing of words inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
WS_RUN = "[\\x20\\x09-\\x0D]+"


#: Lets Spark delete the shuffle files of a query at its end; tables written here never need them again.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); where that is unset, one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tables").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/boxloom-{uuid.uuid4().hex}/{name}"


def write_table(df: DataFrame, name: str, done: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``done``: tables of :func:`write_table` that nothing needs after this; their files are deleted.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    for old in done:
        drop_table(old)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame that came from :func:`write_table`."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent().getParent()
        path.getFileSystem(conf).delete(path, True)


#: At most so many hot keys: each holds at least this share of the rows.
HOT_KEYS = 10_000


def hot_keys(df: DataFrame, key: str, per: int) -> DataFrame:
    """(key, parts): the keys with more than max(``per``, rows / HOT_KEYS) rows, and how many parts of that size they make.

    There are at most ``HOT_KEYS`` of them at any size of ``df``, so the table may be broadcast. Counts are combined before the shuffle.
    """
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_k"))
    size = F.greatest(F.lit(per), F.lit(df.count() / HOT_KEYS).cast("long"))
    return n.where(F.col("_k") > size).select(key, F.ceil(F.col("_k") / size).cast("int").alias("parts"))


def salted(df: DataFrame, hot: DataFrame, key: str | list[str], by: str, salt: str = "salt") -> DataFrame:
    """``df`` with a salt: 0, or for a hot key one of its parts by the hash of ``by``."""
    out = df.join(F.broadcast(hot), key, "left")
    return out.withColumn(salt, F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))).drop("parts")


def over_salts(df: DataFrame, hot: DataFrame, key: str | list[str], salt: str = "salt") -> DataFrame:
    """``df`` (a row per key) with a row for each salt of its key."""
    out = df.join(F.broadcast(hot), key, "left")
    return out.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# ------------------------------------------------------------------ numpy word hashing

_T = np.random.RandomState(20240611).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_K = U(0x9E3779B97F4A7C15)
_KINV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WS = np.zeros(256, bool)
_IS_WS[[32, 9, 10, 11, 12, 13]] = True
_pw = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pw[0]) < n:
        for k, base in enumerate((_K, _KINV)):
            a = np.full(n, base, U)
            a[0] = 1
            _pw[k] = np.cumprod(a, dtype=U)
    return _pw[0][:n], _pw[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_table(texts: list[bytes], lower: bool = False, breaks: np.ndarray | None = None):
    """Words of several texts at once, words being runs of bytes that are not in [\\x20\\x09-\\x0D].

    Returns (buffer, starts, ends, hashes, first): word i is buffer[starts[i]:ends[i]], and the words of
    text t are first[t]:first[t+1]. ``lower`` folds A-Z only. ``breaks``: a table of 256 booleans to use instead of
    white space.
    """
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    ws = (_IS_WS if breaks is None else breaks)[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], ws)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    first = np.searchsorted(starts, at)
    pw, pinv = _powers(len(buf) + 1)
    table = _T[_LOWER] if lower else _T
    s = np.empty(len(buf) + 1, U)
    s[0] = 0
    np.cumsum(table[buf] * pw[: len(buf)], out=s[1:])
    return raw, starts, ends, mix((s[ends] - s[starts]) * pinv[starts]), first


_C = mix(np.arange(1, 65, dtype=U)) | U(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (runs across texts are the caller's to leave out)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for j in range(k):
        h += words[j : j + n] * _C[j]
    return mix(h)


def chunks(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as UTF-8) in pieces of about ``most`` bytes; null counts as empty."""
    at, size, out = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if out and size + len(b) > most:
            yield at, out
            at, size, out = i, 0, []
        out.append(b)
        size += len(b)
    if out:
        yield at, out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Only the columns that are asked for, with ``column`` as text where it is missing or of another type."""
    return df.select(*[F.col(c) for c in keep], F.col(column).cast("string").alias(column))
