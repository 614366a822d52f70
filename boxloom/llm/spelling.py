"""Spelling variants by a variable-length gram index.

Words are counted over all documents. Two words are near if one inserted, deleted or replaced code point makes one the other. A word's
form is its most frequent near word, if that is at least twice as frequent; following forms leads to its root.

1. Dictionary. Substrings of 2 to ``QMAX`` letters of all words (with an end mark at either side) are counted. A gram is frequent above
   max(``RARE``, positions / ``DICT``); the dictionary holds all pairs of letters and each frequent gram's extensions by a letter. There are at most
   ``DICT`` frequent grams of a length, so they may be broadcast.
2. Decomposition. At each position the longest gram of the dictionary, left out where an earlier one covers it. Whether a gram is
   extended depends on its own letters alone, so an edit changes the grams that contain it, and those right of it that a gram
   beginning at or before it could newly cover: for that, the letters between must end a frequent gram. The most that one edit anywhere can
   affect is a word's bound b.
3. Merging. Words that are near share all grams but b of either. So the rarest b + 1 grams of both, in an order that all words share, have one in
   common, at the same place or one further. Words meet by (gram, place, length); pairs of a list are compared in blocks.
4. Verification compares the letters of a pair; it is counted at the first place the two share, so once.

Words whose bound leaves no gram in common, words of ``LONGEST`` letters and more, and words on a list of more than ``HOT`` rows are
also compared with each other by equal variants with a letter left out; pairs among them are left out of the lists. So nothing is
capped, and no list is larger than a task can hold.

Defined results: null texts have no words; a null doc_id counts as the empty text in the hash. Repeated rows count as rows of their own.
Without words the result is empty. Other columns are left alone. A word that repeats a letter loses the one at the hashed place.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import write_table

LEAST_LETTERS, LEAST_COUNT = 5, 3
QMIN, QMAX = 2, 4
RARE, DICT = 16, 4096
LONGEST = 30
HOT = 8192
#: Entries of a task's counts, and pairs of a comparison, that are held at a time.
HELD, BLOCK = 200_000, 1 << 19
_RUN = re.compile("[a-zÀ-ÿ]+")
_OPEN, _CLOSE = "\x02", "\x03"


# ------------------------------------------------------------------ words


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): all runs, lower-cased (A-Z only), the letters that the hash picks left out. Counted in the tasks first."""

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                # whole lists of short texts, one match at a time in long ones
                found = Counter(_RUN.findall(low) if len(low) < 1_000_000 else (m.group() for m in _RUN.finditer(low)))
                at = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, k in found.items():
                    h = zlib.crc32(w.encode(), at)
                    if h % 97 == 0:
                        p = h % len(w)
                        w = w[:p] + w[p + 1 :]
                    held[w] += k
                if len(held) > HELD:
                    yield emit(held)
                    held = Counter()
        if held:
            yield emit(held)

    def emit(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    parts = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    words = parts.groupBy("word").agg(F.sum("n").alias("n"))
    return words.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT))


# ------------------------------------------------------------------ the gram dictionary


class Grams:
    """Frequent grams with their counts, and the endings of the frequent grams that can be extended."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.endings = {g[k:] for g in counts if len(g) < QMAX for k in range(1, len(g))}

    def decompose(self, padded: str) -> list[tuple[int, int]]:
        """(start, end) of the grams that stay, in order."""
        n, out, last = len(padded), [], 0
        for p in range(n - QMIN + 1):
            e = p + QMIN
            while e < n and e - p < QMAX and padded[p:e] in self.counts:
                e += 1
            if e > last:
                out.append((p, e))
                last = e
        return out

    def bound(self, padded: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit between the end marks can affect."""
        n, most, ends = len(padded), 0, self.endings
        for i in range(n - 1):
            # letter i replaced or deleted (not the mark), or a letter put in after i
            inside = here = right = 0
            for p, e in grams:
                if p > i:
                    right += padded[i + 1 : e - 1] in ends
                elif e > i:
                    here += 1
                    inside += e > i + 1
            most = max(most, right + (here if i else inside))
        return most

    def chosen(self, word: str) -> tuple[list[tuple[int, int]], bool]:
        """The grams a word is listed by, in order of place, and whether its bound leaves one for certain."""
        padded = _OPEN + word + _CLOSE
        grams = self.decompose(padded)
        b = self.bound(padded, grams)
        order = sorted(grams, key=lambda g: (self.counts.get(padded[g[0] : g[1]], 0), padded[g[0] : g[1]], g[0]))
        return sorted(order[: b + 1]), len(grams) > b


def gram_dictionary(words: DataFrame) -> Grams:
    """Counted in the tasks first. At most DICT grams of a length are above positions / DICT, and only those reach the driver."""

    def run(batches):
        for b in batches:
            held: Counter = Counter()
            for w in b.column(0).to_pylist():
                w = _OPEN + w + _CLOSE
                for q in range(QMIN, QMAX + 1):
                    held.update(w[i : i + q] for i in range(len(w) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"])

    positions = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    often = max(RARE, -(-positions // DICT))
    got = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > often).collect()
    return Grams({r["gram"]: r["n"] for r in got})


# ------------------------------------------------------------------ lists


def listed(words: DataFrame, grams: Grams) -> DataFrame:
    """A row per word and list: key, kind (0: by its own length; 1, 2: as the longer word, same place or one further), place, word, n, starts and
    sizes (of all grams it is listed by, as bits), aside (is it also compared by variants)."""
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        g = shared.value
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = len(w)
                if k > LONGEST:
                    continue
                chosen, certain = g.chosen(w)
                padded = _OPEN + w + _CLOSE
                starts = sum(1 << p for p, _ in chosen)
                sizes = sum((e - p - QMIN) << 2 * p for p, e in chosen)
                for p, e in chosen:
                    for kind, at, length in ((0, p, k), (1, p, k - 1), (2, p - 1, k - 1)):
                        if at >= 0:
                            for c, v in zip(cols, (padded[p:e], at, length, kind, p, w, n, starts, sizes, not certain or k >= LONGEST), strict=True):
                                c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = ["gram", "at", "length", "kind", "place", "word", "n", "starts", "sizes", "aside"]
    types = (pa.string(), *[pa.int32()] * 4, pa.string(), *[pa.int64()] * 3, pa.bool_())
    rows = words.select("word", "n").mapInArrow(run, "gram string, at int, length int, kind int, place int, word string, n long, starts long, sizes long, aside boolean")
    return rows.select(F.xxhash64("gram", "at", "length").alias("key"), *names[3:])


_ONE = np.uint64(1)


def _lowest(m: np.ndarray) -> np.ndarray:
    """Place of the lowest bit that is set; 63 for none."""
    low = m & (~m + _ONE)
    return np.where(m == 0, 63, np.log2(np.maximum(low, _ONE).astype(np.float64))).astype(np.int64)


def _ends(sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    return place + QMIN + ((sizes >> (2 * np.minimum(place, 31)).astype(np.uint64)) & np.uint64(3)).astype(np.int64)


def _linked(letters, n_letters, starts, sizes, place, kind, a, b):
    """Which pairs (a, b) of rows of one list are near and are to be counted at this list. a is by its own length."""
    same = kind[b] == 0
    la, lb = letters[a], letters[b]
    differ = la != lb
    count, first = differ.sum(1), differ.argmax(1)
    out = np.zeros(len(a), bool)
    # replaced letter; places count from the opening mark
    k = np.flatnonzero(same & (count == 1))
    x, y, i = a[k], b[k], first[k] + 1
    both = starts[x] & starts[y]
    p = _lowest(both)
    left = (p < 63) & (_ends(sizes[x], p) <= i)
    right = _lowest(both & ~((np.uint64(2) << i.astype(np.uint64)) - _ONE))
    out[k] = np.where(left, p, right) == place[x]
    # a letter more in b: equal up to the first difference, and from there on one further
    k = np.flatnonzero(~same)
    x, y, i = a[k], b[k], first[k]
    moved = np.zeros_like(la[k])
    moved[:, 1:] = la[k][:, :-1]
    off = moved != lb[k]
    last = off.shape[1] - 1 - off[:, ::-1].argmax(1)  # the last place where they differ; the letter at 0 differs always
    near = (last <= i) & (n_letters[y] == n_letters[x] + 1)
    k, x, y, i, last = k[near], x[near], y[near], i[near], last[near]
    p = _lowest(starts[x] & starts[y])
    left = (p < 63) & (_ends(sizes[x], p) <= i + 1)
    # from this place of a on, marks counted, b is the same one further
    right = _lowest(starts[x] & (starts[y] >> _ONE) & ~((_ONE << (last + 1).astype(np.uint64)) - _ONE))
    out[k] = np.where(left, (kind[y] == 1) & (p == place[x]), (kind[y] == 2) & (right == place[x]))
    return out


def merge_lists(rows: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): the near words found in the lists, summed up by batch. ``rows`` are those of :func:`listed`."""
    width = LONGEST + 2

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows:
                held = b if held is None else pa.concat_batches([held, b])
                key = held.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # rows are sorted by key; the last list may go on
                if cut and held.num_rows >= 20_000:
                    yield from work(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None:
            yield from work(held)

    def work(b):
        key, kind, place = (b.column(i).to_numpy() for i in range(3))
        n, starts, sizes = (b.column(i).to_numpy() for i in (4, 5, 6))
        starts, sizes = starts.view(np.uint64), sizes.view(np.uint64)
        aside = b.column(7).to_numpy(zero_copy_only=False)
        names = b.column(3).to_pylist()
        fixed = np.array([w.encode("latin-1") for w in names], f"S{width}")
        letters = fixed.view(np.uint8).reshape(len(names), width)
        n_letters = np.array([len(w) for w in names])
        end = np.searchsorted(key, key, side="right")
        pairs = np.where(kind == 0, end - np.arange(len(key)) - 1, 0)
        if not pairs.any():
            return
        done = np.concatenate(([0], np.cumsum(pairs)))
        total, best, near = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.full(len(key), -1)
        at = 0
        links = []
        while at < len(key):
            to = max(int(np.searchsorted(done, done[at] + BLOCK, side="right")) - 1, at + 1)
            k = pairs[at:to]
            a = np.repeat(np.arange(at, to), k)
            j = np.arange(len(a)) - np.repeat(done[at:to] - done[at], k) + a + 1
            ok = ~(aside[a] & aside[j])
            a, j = a[ok], j[ok]
            ok = _linked(letters, n_letters, starts, sizes, place, kind, a, j)
            links.append((a[ok], j[ok]))
            at = to
        a, j = (np.concatenate(x) for x in zip(*links, strict=True))
        if not len(a):
            return
        me, other = np.concatenate([a, j]), np.concatenate([j, a])
        # by word: the most frequent near word, the first of equals
        _, who = np.unique(fixed, return_inverse=True)
        order = np.lexsort((who[other], -n[other], who[me]))
        me, other = me[order], other[order]
        new = np.concatenate(([True], who[me][1:] != who[me][:-1]))
        heads = np.flatnonzero(new)
        total = np.diff(np.concatenate((heads, [len(me)])))
        best, near = n[other[heads]], other[heads]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in me[heads]], pa.string()), pa.array(total, pa.int64()), pa.array(best, pa.int64()), pa.array([names[i] for i in near], pa.string())],
            names=["word", "n_near", "best_n", "best"],
        )

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = rows.select("key", "kind", "place", "word", "n", "starts", "sizes", "aside")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "kind", "word", "place")
    return rows.mapInArrow(run, "word string, n_near long, best_n long, best string")


def by_variants(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) among ``words`` (word, n): pairs that are equal after leaving out a letter of one or both."""
    i = F.sequence(F.lit(1), F.length("word"))
    less = words.select("word", "n", F.explode(i).alias("i"))
    less = less.select("word", "n", "i", F.concat(F.expr("left(word, i - 1)"), F.expr("substr(word, i + 1)")).alias("less"))
    other = less.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "i", "less")
    replaced = less.join(other.hint("merge"), ["less", "i"]).where("word <> other").select("word", "other", "other_n")
    whole = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    longer = less.join(whole.hint("merge"), F.col("less") == F.col("other")).select("word", "n", "other", "other_n").distinct()
    both = replaced.unionByName(longer.select("word", "other", "other_n")).unionByName(longer.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return _best(both.select("word", F.lit(1).cast("long").alias("n_near"), F.col("other_n").alias("best_n"), F.col("other").alias("best")))


def _best(found: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has near words. ``words``: a table (word, n) of letters up to U+00FF."""
    rows = write_table(listed(words, gram_dictionary(words)), "gram_lists")
    large = write_table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("key"), "large_lists")
    crowded = rows.join(large.hint("merge"), "key").select("word").distinct()
    asides = rows.where("aside").select("word").unionByName(words.where(F.length("word") >= LONGEST).select("word")).unionByName(crowded).distinct()
    asides = write_table(asides, "aside_words")
    if not large.isEmpty():
        kept = rows.join(large.hint("merge"), "key", "left_anti").drop("aside")
        mark = asides.select("word", F.lit(True).alias("aside"))
        rows = write_table(kept.join(mark.hint("merge"), "word", "left").withColumn("aside", F.coalesce("aside", F.lit(False))), "gram_lists", [rows])
    found = merge_lists(rows).unionByName(by_variants(words.join(asides.hint("merge"), "word", "left_semi")))
    return write_table(_best(found), "near_words", [rows, large, asides])


# ------------------------------------------------------------------ forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """``forms``: a table (word, form). (word, form, root): n at least doubles with each form, so pointers double to their ends in few rounds."""
    at = write_table(forms.select("word", "form", F.col("form").alias("root")), "roots")
    while True:
        nxt = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = write_table(at.join(nxt.hint("merge"), "root", "left").select("word", "form", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots", [at])
        at = step
        if step.where("moved").isEmpty():
            return at.select("word", "form", "root")


def spelling_groups(words: DataFrame) -> DataFrame:
    """One row per word of ``words``, a table (word, n): word, form, root, n, n_near, form_n."""
    near = near_words(words)
    known = write_table(words.join(near.hint("merge"), "word", "left"), "known_words", [near])
    ok = F.col("best_n") >= 2 * F.col("n")
    ends = roots(known.where(ok).select("word", F.col("best").alias("form")))
    return known.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).cast("long").alias("form_n"),
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """All words of ``docs`` with their forms and roots."""
    return spelling_groups(write_table(count_words(docs), "words"))

