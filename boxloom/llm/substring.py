"""Substring dedup with one compressed FM-index per shard.

A window is ``WINDOW`` consecutive words (runs outside ``[\\x20\\x09-\\x0D]``, unchanged) of one document. A word goes if a window
covers it whose word sequence also starts in a document with a smaller doc_id. Windows are judged on the input.

1. The minimizer of a window is the least hash among its ``GRAM``-word runs. It depends on the window's words only, so equal
   windows have equal minimizers. Minimizers that occur in one document only cannot belong to a repeated window: only
   the others' *segments* (runs of windows with the same minimizer) travel on.
2. Hot minimizers, found on a sample of the documents (which decides about balance only, never about results), get a second
   minimizer by another hash: their windows are dealt by both. What is then still frequent is equal segments; a task
   answers those that it has seen in a document with a smaller id at once, so that they never meet in one task.
3. Segments are dealt to shards by minimizer. Equal segments are settled by their smallest document; the distinct ones
   are gathered into shards of about ``SHARD_WORDS`` words.
4. Each shard is indexed, and its segments are streamed against the index by backward search over its wavelet matrix. The
   search keeps the matching statistic of each position up to the threshold: positions whose longest match reaches ``WINDOW``
   words are reported with the smallest document of their interval. A minimizer with more distinct segments than
   a shard holds is indexed in parts, and its segments are streamed against each part.
5. The documents take back which of their windows are repeats, and drop the words under them.

Defined results: null and empty texts have no words; fewer than 13 words are no window; a null doc_id is never smaller
than another and loses nothing; rows that repeat a doc_id are judged alike and don't repeat each other; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import U, chunks, gram_hashes, hot_keys, mix, partitions, word_table, write_table
from boxloom.llm.fmindex import FMIndex

WINDOW = 13
GRAM = 5
SHARD_WORDS = 1 << 20
#: Minimizers are taken in this many shares, one after the other, so that only one share's segments are on disk.
ROUNDS = 2
_SPAN = WINDOW - GRAM + 1
#: Documents with a minimizer from which it counts as hot, judged on one document in ``SAMPLE``.
HOT_ROWS, SAMPLE = 1_024, 16
#: Hot segments that a task remembers to settle copies early; beyond, they are settled in their shard.
REMEMBERED = 1 << 17


def _minimizers(words: np.ndarray, second: bool = False) -> np.ndarray:
    """The least gram hash of each window of ``words`` (windows across texts are the caller's to leave out)."""
    g = mix(gram_hashes(words, GRAM))
    if second:
        g = mix(g ^ U(0x5851F42D4C957F2D))
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, U)
    m, k = g, 1
    while 2 * k <= _SPAN:  # least of 2, 4, 8 grams
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[:n], m[_SPAN - k : _SPAN - k + n])


def _window_rows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all windows that lie within one text."""
    n = np.maximum(np.diff(first) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return doc, np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def document_minimizers(docs: DataFrame) -> DataFrame:
    """(doc_id, h): the distinct minimizers of each document."""

    def run(batches):
        for b in batches:
            for at, texts in chunks(b.column(1).to_pylist()):
                _, _, _, words, first = word_table(texts)
                doc, pos = _window_rows(first)
                if len(doc):
                    m = _minimizers(words)[pos]
                    new = np.ones(len(m), bool)
                    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
                    m, doc = m[new], doc[new]
                    order = np.lexsort((m, doc))
                    m, doc = m[order], doc[order]
                    new = np.ones(len(m), bool)
                    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + doc[new])), pa.array(m[new].view(np.int64), pa.int64())], names=["doc_id", "h"])

    return docs.mapInArrow(run, "doc_id long, h long")


def hot_minimizers(docs: DataFrame) -> list[int]:
    """The hot minimizers: a bounded list (at most ``HOT_KEYS``), each of several documents of the sample."""
    rows = write_table(document_minimizers(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)), "sampled_minimizers")
    return sorted(r["h"] for r in hot_keys(rows, "h", max(2, HOT_ROWS // SAMPLE)).collect())


def shared_minimizers(docs: DataFrame, hot: list[int]) -> DataFrame:
    """(doc_id, hs): for each document its minimizers that another document has too. Hot ones are known to be shared."""
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(h,) for h in hot], "h long").withColumn("hot", F.lit(True)))
    rows = document_minimizers(docs).join(known, "h", "left")
    w = Window.partitionBy("h", F.when(F.col("hot"), F.xxhash64("doc_id")))
    rows = rows.withColumn("a", F.min("doc_id").over(w)).withColumn("b", F.max("doc_id").over(w)).where("hot OR a < b")
    return rows.groupBy("doc_id").agg(F.collect_list("h").alias("hs"))


def _segments_of(words: np.ndarray, first: np.ndarray, wanted: list[np.ndarray], hot: np.ndarray):
    """(text, key, first word, one past the last word, hot) of each segment whose minimizer its text wants.

    The key is the minimizer; windows of a hot one are told apart by their second minimizer too.
    """
    doc, pos = _window_rows(first)
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, U), z, z, np.zeros(0, bool)
    m = _minimizers(words)[pos]
    key, is_hot = m, np.isin(m, hot) if len(hot) else np.zeros(len(m), bool)
    if is_hot.any():
        key = np.where(is_hot, mix(m ^ _minimizers(words, True)[pos]), m)
    new = np.ones(len(m), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(m))
    d, h = doc[a], m[a]
    n = np.array([len(x) for x in wanted])
    all_w = np.concatenate([np.asarray(x, np.int64).view(U) for x in wanted]) if n.sum() else np.zeros(0, U)
    # a text's own list only: both sides are keyed by text and minimizer
    own = mix(all_w ^ (np.repeat(np.arange(len(wanted)), n).astype(U) * U(0x9E3779B97F4A7C15)))
    ask = mix(h ^ (d.astype(U) * U(0x9E3779B97F4A7C15)))
    ok = np.isin(ask, own)
    return d[ok], key[a[ok]], pos[a[ok]], pos[z[ok] - 1] + WINDOW, is_hot[a[ok]]


def _segment_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each run words[lo:hi] and its length."""
    out = (hi - lo).astype(U)
    for j in range(int((hi - lo).max(initial=0))):
        ok = lo + j < hi
        out[ok] = mix(out[ok] * U(0x100000001B3) + words[lo[ok] + j])
    return out


def segments(docs: DataFrame, hot) -> DataFrame:
    """``docs``: doc_id, text, hs; ``hot``: broadcast array. Returns (h, doc_id, words, copy), one row per segment.

    A hot segment that the task has seen in a document with a smaller id is a copy: its hash is in ``copy``, it carries no
    words, and its key spreads it over the shards.
    """

    def run(batches):
        seen: dict[int, int] = {}
        for b in batches:
            wanted_all = b.column(2).to_pylist()
            for at, texts in chunks(b.column(1).to_pylist()):
                raw, starts, ends, words, first = word_table(texts)
                d, h, lo, hi, is_hot = _segments_of(words, first, wanted_all[at : at + len(texts)], hot.value)
                if not len(d):
                    continue
                ids = b.column(0).take(pa.array(at + d))
                copy: list = [None] * len(d)
                k = np.flatnonzero(is_hot)
                if len(k):
                    seg = _segment_hashes(words, lo[k], hi[k]).view(np.int64).tolist()
                    for x, s, doc in zip(k.tolist(), seg, ids.take(pa.array(k)).to_pylist(), strict=True):
                        before = seen.get(s)
                        if before is not None and before < doc:
                            copy[x] = s
                            h[x] = U(s & 0xFFFFFFFFFFFFFFFF) ^ U(doc & 0xFFFFFFFFFFFFFFFF)
                        elif before is not None or len(seen) < REMEMBERED:
                            seen[s] = doc
                s, e = starts[lo], ends[hi - 1]
                # one space between words, so that equal word sequences are equal strings
                text = [None if c is not None else b" ".join(raw[x:y].split()).decode("utf-8", "surrogatepass") for x, y, c in zip(s.tolist(), e.tolist(), copy, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array(text, pa.string()), pa.array(copy, pa.int64())], names=["h", "doc_id", "words", "copy"])

    return docs.select("doc_id", "text", "hs").mapInArrow(run, "h long, doc_id long, words string, copy long")


class _Shard:
    """Distinct segments of some minimizers, indexed and streamed when there are enough."""

    def __init__(self):
        self.words, self.docs, self.copies, self.size = [], [], [], 0

    def add(self, doc: int, words: str) -> None:
        self.words.append(words.encode("utf-8", "surrogatepass"))
        self.docs.append(doc)
        self.copies.append([])
        self.size += words.count(" ") + 1

    def answers(self):
        """(doc, seg, windows as bits): the windows of each segment that a smaller document holds; seg is the hash of its words."""
        if not self.docs:
            return
        docs = np.array(self.docs, np.int64)
        _, _, _, h, first = word_table(self.words)
        n = np.diff(first)
        seg = _segment_hashes(h, first[:-1], first[1:]).view(np.int64).tolist()
        _, sym = np.unique(h, return_inverse=True)
        # each segment with its closing 0
        starts = first[:-1] + np.arange(len(n))
        flat = np.zeros(len(h) + len(n), np.int64)
        flat[np.repeat(starts - first[:-1], n) + np.arange(len(h))] = sym + 1
        owner = np.repeat(docs, n + 1)
        least = np.full(len(flat), np.iinfo(np.int64).max)
        at = 0
        while at < len(n):  # parts of a shard that has grown too large for one index
            z = max(at + 1, int(np.searchsorted(starts, starts[at] + 2 * SHARD_WORDS)))
            a, b = starts[at], starts[z] if z < len(n) else len(flat)
            got = FMIndex(flat[a:b], owner[a:b], WINDOW).matching(flat, starts, n)
            np.minimum(least, np.where(got >= 0, got, least), out=least)
            at = z
        bad = least < owner
        some = np.logical_or.reduceat(bad, starts)
        for i in range(len(n)):
            if some[i]:
                yield int(docs[i]), seg[i], np.packbits(bad[starts[i] : starts[i] + n[i] - WINDOW + 1], bitorder="little").tobytes()
            for doc in self.copies[i]:  # a smaller document has the same segment
                yield doc, seg[i], None


def repeated(segs: DataFrame) -> DataFrame:
    """(doc_id, seg, bits) of the segments with repeated windows; null bits: all windows."""
    n = partitions(segs.sparkSession)
    w = Window.partitionBy("h", "words").orderBy("doc_id")  # the same order as below: sorted once
    rows = segs.repartition(n, "h").withColumn("first_doc", F.first("doc_id").over(w))
    # only the first row of equal segments carries its words to Python
    rows = rows.sortWithinPartitions("h", "words", "doc_id").select("h", "doc_id", "first_doc", F.when(F.col("doc_id") == F.col("first_doc"), F.col("words")).alias("words"), "copy")

    def run(batches):
        shard, last_h, last_words = _Shard(), None, None
        for b in batches:
            early = b.filter(b.column(4).is_valid())
            if early.num_rows:
                yield pa.RecordBatch.from_arrays([early.column(1), early.column(4), pa.nulls(early.num_rows, pa.binary())], names=["doc_id", "seg", "bits"])
                b = b.filter(b.column(4).is_null())
            for h, doc, first, words in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if doc != first:
                    if len(shard.copies[-1]) >= COPIES:  # a hot segment: its copies so far are answered at once
                        seg = int(_segment_hashes(*_one(shard.words[-1])).view(np.int64)[0])
                        yield _answer_batch([(d, seg, None) for d in shard.copies[-1]])
                        shard.copies[-1] = []
                    shard.copies[-1].append(doc)
                elif h != last_h or words != last_words:  # else the document holds it twice
                    if shard.size >= SHARD_WORDS and h != last_h:
                        yield from _answer_batches(shard)
                        shard = _Shard()
                    shard.add(doc, words)
                    last_h, last_words = h, words
        yield from _answer_batches(shard)

    return rows.mapInArrow(run, "doc_id long, seg long, bits binary")


#: Copies of one segment that a shard holds before it answers them.
COPIES = 1 << 16


def _one(words: bytes):
    _, _, _, h, first = word_table([words])
    return h, first[:-1], first[1:]


def _answer_batches(shard: _Shard, most: int = 8192):
    out = []
    for x in shard.answers():
        out.append(x)
        if len(out) >= most:
            yield _answer_batch(out)
            out = []
    if out:
        yield _answer_batch(out)


def _answer_batch(rows) -> pa.RecordBatch:
    d, s, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(b, pa.binary())], names=["doc_id", "seg", "bits"])


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cut(docs: DataFrame, with_text: bool, hot) -> DataFrame:
    """``docs``: doc_id, text, hs, found(seg, bits)."""

    def run(batches):
        for b in batches:
            hs_all, found_all = b.column(2).to_pylist(), b.column(3).to_pylist()
            out = []
            for at, texts in chunks(b.column(1).to_pylist()):
                raw, starts, ends, words, first = word_table(texts)
                gone = np.zeros(len(words) + 1, np.int64)
                hs = [x or [] for x in hs_all[at : at + len(texts)]]
                if any(hs):
                    d, _, lo, hi, _ = _segments_of(words, first, hs, hot.value)
                    key = _segment_hashes(words, lo, hi).view(np.int64)
                    maps = [{f["seg"]: f["bits"] for f in (x or [])} for x in found_all[at : at + len(texts)]]
                    for t, k, a, z in zip(d.tolist(), key.tolist(), lo.tolist(), hi.tolist(), strict=True):
                        m = maps[t]
                        if k in m:
                            bits = m[k]
                            if bits is None:
                                gone[a] += 1
                                gone[z] -= 1
                            else:
                                p = a + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a - WINDOW + 1, bitorder="little"))
                                np.add.at(gone, p, 1)
                                np.add.at(gone, p + WINDOW, -1)
                cut = np.cumsum(gone[:-1]) > 0
                for t in range(len(texts)):
                    a, z = first[t], first[t + 1]
                    k = np.flatnonzero(~cut[a:z]) + a
                    if len(k) == z - a:
                        kept = b" ".join(texts[t].split())
                    else:
                        kept = b" ".join([raw[x:y] for x, y in zip(starts[k].tolist(), ends[k].tolist(), strict=True)])
                    out.append((z - a, z - a - len(k), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None))
            if out:
                n, r, s, k = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.string()), pa.array(k, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return docs.select("doc_id", "text", "hs", "found").mapInArrow(run, SCHEMA)


def substring_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = texts.where("doc_id IS NOT NULL")
    hot = hot_minimizers(named)
    shared = write_table(shared_minimizers(named, hot), "shared_minimizers")
    hot = spark.sparkContext.broadcast(np.array(hot, np.int64).view(U))
    # the texts are dealt by document once; each round then shuffles the segments of its share of the minimizers only
    marked = write_table(named.join(shared.hint("merge"), "doc_id"), "marked")
    found = []
    for k in range(ROUNDS):
        own = marked.withColumn("hs", F.expr(f"filter(hs, h -> pmod(h, {ROUNDS}) = {k})")).where(F.size("hs") > 0)
        found.append(write_table(repeated(segments(own, hot)), "repeated", [marked] if k == ROUNDS - 1 else []))
    answers = reduce(DataFrame.unionByName, found)
    by_doc = answers.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("seg", "bits")).alias("found")).join(shared.hint("merge"), "doc_id")
    out = _cut(texts.join(by_doc.hint("merge"), "doc_id", "left"), with_text, hot)
    return out if with_text else out.drop("kept_text")
