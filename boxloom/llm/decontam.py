"""Benchmark decontamination: CGK random walks, bit sampling over item-sized windows, exact edit distance.

Texts become words: ASCII letters lower-cased, ASCII punctuation and white space between words dropped. A document is
contaminated by an item of n words if some run of its words is within ``floor(MAX_EDITS * n)`` word edits of the item.

1. Places. An item of n words edited at most k times keeps at least n - q + 1 - qk of its runs of q words (``RUN``; all words of a shorter
   item). A place where the n + k words ahead begin with one, and hold so many, that occur in any of the items of n words can hold one of these
   items from up to qk words before it on; no other place can. Windows of n words begin at each of these words.
2. Embedding. The CGK walk reads a sequence by a pointer that rests or moves on by a random bit of (step, word read); on two
   sequences with the same bits it meets again after an edit, so that edit distance becomes Hamming distance of the
   words read. Windows and items walk ``REPS`` times with different bits.
3. Bit sampling. Of each walk ``BITS`` steps are sampled, within the first ``1.5 n``. Items and windows of n words meet in the buckets (n,
   walk, words read at its sampled steps): a pair is a candidate if it shares one. For the most edits allowed and any item length this
   misses under 1 per cent of the items (``TARGET_RECALL``; measured by number and kind of edits in the tests, figures in the README).
4. Candidates of an item that lie together are one stretch of the text, verified exactly: it must hold the runs of this item that k edits
   leave, and then a run within k edits (semi-global edit distance, on words).

The items of a block travel to the tasks: at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text; a larger benchmark takes
several blocks, through which the documents pass one after the other in one scan.

Defined results: null and empty texts hold nothing; items without words match nothing; items of under ``1/MAX_EDITS``
words match without edits only; a null doc_id is kept as it is; repeated rows give repeated results; of several runs the one with
the fewest edits counts, then the first; its shortest form gives the start. No other column is read; ``drop_contaminated`` judges each row by its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import U, chunks, gram_hashes, mix, spread, word_table

MAX_EDITS = 0.15
TARGET_RECALL = 0.99
BITS, REPS = 1, 24
SEED = 29
RUN = 3
BLOCK_ITEMS = 5_000
BLOCK_BYTES = 8 << 20

_BREAK = np.zeros(256, bool)
_BREAK[:128] = [not chr(c).isalnum() for c in range(128)]


def words_of(texts: list[bytes]):
    """(hashes, first): words of the normalised texts."""
    _, _, _, h, first = word_table(texts, lower=True, breaks=_BREAK)
    return h, first


def substring_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least word edits between ``item`` and a run of ``text``, where that run ends)."""
    n = len(item)
    col = np.arange(n + 1)
    best, end = n, 0
    ramp = np.arange(n + 1)
    for j, w in enumerate(text):
        new = np.empty(n + 1, np.int64)
        new[0] = 0
        np.minimum(col[1:] + 1, col[:-1] + (item != w), out=new[1:])
        new = np.minimum.accumulate(new - ramp) + ramp
        col = new
        if col[n] < best:
            best, end = int(col[n]), j + 1
    return best, end


class Items:
    """A block of items: their words, the runs of words in them by the items' length, and their buckets."""

    def __init__(self, rows: list[tuple[int, str]]):
        texts = [t.encode("utf-8", "surrogatepass") for _, t in rows]
        h, first = words_of(texts) if texts else (np.zeros(0, U), np.zeros(1, np.int64))
        use = [i for i in range(len(rows)) if first[i + 1] > first[i]]
        self.ids = [rows[i][0] for i in use]
        self.words = [h[first[i] : first[i + 1]] for i in use]
        self.n = n = np.array([len(w) for w in self.words], np.int64)
        self.runs = [np.unique(gram_hashes(w, min(RUN, len(w)))) for w in self.words]
        flat, at = np.concatenate([*self.words, np.zeros(1, U)]), np.cumsum(n) - n
        self.buckets, by_size = {}, {}
        for m in np.unique(n).tolist():
            k = np.flatnonzero(n == m)
            got = self.walks(m, flat, at[k], at[k], at[k] + m)
            order = np.argsort(got, axis=0, kind="stable")
            self.buckets[m] = np.take_along_axis(got, order, 0), k[order]
            by_size.setdefault(min(RUN, m), {})[m] = np.unique(np.concatenate([self.runs[i] for i in k]))
        # for each size of run: all of them, sorted, and for each length of item which are its own
        self.known = {}
        for q, own in by_size.items():
            every = np.unique(np.concatenate(list(own.values())))
            small = np.zeros(1 << 20, bool)
            small[(every >> U(44)).astype(np.int64)] = True
            self.known[q] = every, small, {m: np.isin(every, g) for m, g in own.items()}

    def walks(self, n: int, words: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(window, walk): a hash of the words that the walks of windows of ``n`` words read at their sampled steps, 0 where one lies beyond the
        window or its text [low, high)."""
        u = mix(np.arange(REPS * BITS, dtype=U) + U(SEED)).astype(np.float64) / 2.0**64
        want = (u.reshape(REPS, BITS) * 1.5 * n).astype(np.int64)
        out, read = np.zeros((len(start), REPS), U), np.ones((len(start), REPS), bool)
        at = np.zeros((len(start), REPS), np.int64)
        for t in range(int(want.max()) + 1):
            pos = start[:, None] + at
            ok = (at < n) & (pos >= low[:, None]) & (pos < high[:, None])
            w = np.where(ok, words[np.where(ok, pos, 0)], U(0))
            for r, b in zip(*np.nonzero(want == t), strict=True):
                out[:, r] += mix(w[:, r] + U(b))
                read[:, r] &= ok[:, r]
            bits = mix(np.arange(REPS, dtype=U) + U(t * REPS) + (U(SEED) << U(32)))
            at += (((w + bits) * U(0x9E3779B97F4A7C15)) >> U(63)).astype(np.int64)
        return np.where(read, out, U(0))

    def places(self, words: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        """Where windows begin, by their number of words."""
        out = {}
        for q, (every, small, own) in self.known.items():
            x = gram_hashes(words, q)
            at = np.flatnonzero(small[(x >> U(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(every, x[at]), len(every) - 1)
            hit = every[k] == x[at]
            at, k = at[hit], k[hit]
            end = first[np.searchsorted(first, at, "right")]
            hit = at + q <= end  # not across two texts
            at, k, end = at[hit], k[hit], end[hit]
            low = first[np.searchsorted(first, at, "right") - 1]
            for n, mine in own.items():
                e = int(MAX_EDITS * n)
                sel = mine[k]
                p = at[sel]
                ahead = np.searchsorted(p, np.minimum(p + n + e, end[sel]) - q, "right") - np.arange(len(p))
                enough = ahead >= n - q + 1 - q * e
                s, floor = p[enough], low[sel][enough]
                if e and len(s):
                    back = s[:, None] - np.arange(q * e + 1)
                    s = np.unique(back[back >= floor[:, None]])
                out[n] = s
        return out

    def candidates(self, words: np.ndarray, first: np.ndarray, n: int, s: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of the windows of ``n`` words that share a bucket with an item."""
        keys, items = self.buckets[n]
        found = []
        for k in range(0, len(s), step):
            x = s[k : k + step]
            d = np.searchsorted(first, x, "right") - 1
            got = self.walks(n, words, x, first[d], first[d + 1])
            pairs = []
            for r in range(REPS):
                lo, hi = np.searchsorted(keys[:, r], got[:, r], "left"), np.searchsorted(keys[:, r], got[:, r], "right")
                m = np.where(got[:, r] == 0, 0, hi - lo)
                at = np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                pairs.append(items[at, r] * len(words) + np.repeat(x, m))
            found.append(np.unique(np.concatenate(pairs)))
        u = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
        return u // len(words), u % len(words)

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, start, words of the item, edits): for each text and item the best verified match."""
        if not self.words:
            return []
        words, first = words_of(texts)
        if not len(words):
            return []
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, places in self.places(words, first).items():
            k, q = int(MAX_EDITS * n), min(RUN, n)
            it, s = self.candidates(words, first, n, places)
            if not len(s):
                continue
            d = np.searchsorted(first, s, "right") - 1
            lo, hi = np.maximum(s - k, first[d]), np.minimum(s + n + 2 * k, first[d + 1])
            # windows of an item that overlap in a text are one stretch
            new = np.ones(len(s), bool)
            new[1:] = (it[1:] != it[:-1]) | (d[1:] != d[:-1]) | (lo[1:] > hi[:-1])
            heads = np.flatnonzero(new)
            for a, z in zip(heads.tolist(), np.concatenate((heads[1:], [len(s)])).tolist(), strict=True):
                i, doc, run = int(it[a]), int(d[a]), words[lo[a] : hi[z - 1]]
                if np.isin(gram_hashes(run, q), self.runs[i]).sum() < n - q + 1 - q * k:
                    continue
                edits, end = substring_edits(self.words[i], run)
                if edits <= k:
                    start = end - substring_edits(self.words[i][::-1], run[:end][::-1])[1]
                    got = (edits, int(lo[a] + start - first[doc]))
                    best[doc, i] = min(best.get((doc, i), got), got)
        return [(doc, self.ids[i], st, int(self.n[i]), e) for (doc, i), (e, st) in sorted(best.items())]


_HIT = "array<struct<item_id:long,start:long,n_words:long,edits:long>>"
_HITS = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "n_words", "edits")]))


def _blocks(benchmark: DataFrame) -> list:
    """The items as broadcast blocks of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0]
    n = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["b"] // BLOCK_BYTES))
    part = lambda k: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
    return [spark.sparkContext.broadcast([tuple(r) for r in part(k)]) for k in range(n)]


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, start (word), n_words of the item, edits."""
    out = spread(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "text", "doc_id").withColumn("hits", F.array().cast(_HIT))
    for block in _blocks(benchmark):  # one scan: every block adds its hits to the documents that pass

        def run(batches, block=block):
            found = Items(block.value)
            for b in batches:
                hits = b.column(2).to_pylist()
                for at, texts in chunks(b.column(1).to_pylist()):
                    for t, i, s, n, e in found.find(texts):
                        hits[at + t].append({"item_id": i, "start": s, "n_words": n, "edits": e})
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, _HITS)], names=["doc_id", "text", "hits"])

        out = out.mapInArrow(run, f"doc_id long, text string, hits {_HIT}")
    return out.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.start", "h.n_words", "h.edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item, with the columns of ``docs``. Nothing is shuffled."""
    at, out = docs.columns.index("text"), docs
    for block in _blocks(benchmark):

        def run(batches, block=block):
            found = Items(block.value)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for k, texts in chunks(b.column(at).cast(pa.string()).to_pylist()):
                    clean[[k + hit[0] for hit in found.find(texts)]] = False
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
