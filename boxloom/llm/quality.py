"""Quality classifier by compression.

From labelled texts one zstandard dictionary is trained for each label. A text is cut into pieces of ``CHUNK`` bytes that
cover all of it; each piece is compressed with either dictionary and with none. The differences of the compressed sizes,
normalised by the size without a dictionary and by the text's length, and the two sizes by the length, go through a logistic
calibration fitted on labelled rows that the dictionaries have not seen. Together they hold the plain ratio too. Labels come only from
rows whose crc32(doc_id) mod 5 is not 0; the score uses the text alone. ``CHUNK`` was picked on the calibration's own rows.

Training takes at most ``TRAIN_ROWS`` rows of each label (one of each id) and ``TRAIN_BYTES`` bytes of text, the first ones in the order of
a hash of the id: a bounded sample of whole texts of up to ``TRAIN_TEXT`` bytes (longer ones are passed over, not cut).

Defined results: null texts count as empty; an empty text gets the share of good labels in the sample. Without labelled rows of
both kinds every score is 0.5; if there are some but all of one kind are above ``TRAIN_TEXT``, fitting is an error. Ties at the
threshold count as good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN_ROWS = 2_000
TRAIN_BYTES = 6_000_000
TRAIN_TEXT = 100_000
DICT_BYTES = 112_640
CHUNK = 512
LEVEL = 3
THRESHOLD = 0.3


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _pieces(b: bytes) -> list[bytes]:
    return [b[i : i + CHUNK] for i in range(0, len(b), CHUNK)]


def features(texts: list[bytes], model: dict) -> np.ndarray:
    """(n, 6): what the good dictionary saves against the bad one, and against none, by plain size and by length; either size by length."""
    good = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(model["good"]), write_content_size=False)
    bad = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(model["bad"]), write_content_size=False)
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    out = np.zeros((len(texts), 6))
    for i, b in enumerate(texts):
        if b:
            p = _pieces(b)
            g, d, n = (sum(len(z.compress(x)) for x in p) for z in (good, bad, plain))
            out[i] = (d - g) / n, (n - g) / n, (d - g) / len(b), (n - g) / len(b), g / len(b), d / len(b)
    return out


def _logit_fit(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / std]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = p * (1 - p) + 1e-6
        w += np.linalg.solve(z.T @ (z * s[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return w, mean, std


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model: two dictionaries and a calibration. None without both labels."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lab = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    samples = []
    for q in (0, 1):
        # ids first, so that only the sampled texts travel
        ids = lab.where(F.col("quality") == q).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(TRAIN_ROWS).select("doc_id")
        got = rows.join(F.broadcast(ids), "doc_id").select("doc_id", F.octet_length("text").alias("n"), F.when(F.octet_length("text") <= TRAIN_TEXT, F.col("text")).alias("text"))
        # one row of an id, its shortest text: as many rows as ids, however often one repeats
        got = got.groupBy("doc_id").agg(F.min_by(F.struct("n", "text"), F.struct("n", F.md5("text"))).alias("r")).select(F.md5(F.col("doc_id").cast("string")).alias("k"), "doc_id", "r.*")
        w = F.sum(F.octet_length("text")).over(Window.orderBy("k", "doc_id", "n").rowsBetween(Window.unboundedPreceding, 0))
        got = got.withColumn("b", w).where(F.coalesce("b", F.lit(0)) <= TRAIN_BYTES).orderBy("k", "doc_id", "n").collect()
        samples.append([r["text"].encode("utf-8", "surrogatepass") for r in got if r["text"] is not None])
        if got and not samples[-1]:
            raise ValueError(f"all {len(got)} labelled texts of quality {q} in the sample are above {TRAIN_TEXT} bytes")
    if not all(samples):
        return None
    # even rows train the dictionaries, odd rows the calibration
    model = {}
    for name, texts in zip(("bad", "good"), samples, strict=True):
        parts = [p for t in texts[0::2] for p in _pieces(t)] or [b" "]
        try:
            model[name] = zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: its end is used as it is
            model[name] = b"".join(parts)[-DICT_BYTES:].rjust(16, b" ")
    odd = [t[1::2] or t for t in samples]
    x = features(odd[0] + odd[1], model)
    y = np.r_[np.zeros(len(odd[0])), np.ones(len(odd[1]))]
    model["w"], model["mean"], model["std"] = _logit_fit(x, y)
    model["prior"] = len(samples[1]) / (len(samples[0]) + len(samples[1]))
    return model


def score_texts(texts: list[bytes], model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    x = features(texts, model)
    z = np.c_[np.ones(len(x)), (x - model["mean"]) / model["std"]] @ model["w"]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return np.where([len(t) > 0 for t in texts], p, model["prior"])


def score(docs: DataFrame, model: dict | None, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` and score, over whole texts."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score_texts(texts, m.value), pa.float64())], names=[*b.schema.names[:-1], "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_scored_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}{', ' if fields else ''}score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels), "doc_id")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns of ``docs``."""
    cols = docs.columns
    if "score" in cols:
        docs = docs.withColumnRenamed("score", "_old_score")
    out = score(docs, fit(docs, labels), *docs.columns).where(F.col("score") >= THRESHOLD)
    return out.drop("score").withColumnRenamed("_old_score", "score").select(*cols)
