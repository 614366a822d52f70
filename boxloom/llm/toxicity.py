"""Toxicity by weak supervision.

1. Terms. From labelled learning rows (crc32(doc_id) mod 3 is not 1; at most ``SAMPLE`` texts of each label, near copies
   taken once) come words and word beginnings of 4 to 7 bytes that toxic texts hold more often: at most ``TERMS``, by how sure their log odds are.
2. Scan. Every whole text is read once. A row keeps its hits (terms and counts), its number of words and a few counts for patterns.
3. Voters. Lexicons (learned words, learned beginnings, a general list of insults) and patterns (several different terms, share of hits,
   exclamation, shouting). A voter fires or abstains.
4. Label model. Two hidden classes; a voter fires at a rate of its own in each. Rates, prior and the voters' correlations within a class are
   estimated by EM over all documents' votes, starting from and anchored by the learning rows. A voter that moves with others counts for less:
   its log odds are divided by one plus its correlations. The posterior is the label.
5. A logistic model on terms and shares is fitted to the posteriors of a bounded sample of learning rows; its output is the score.

What grows with the corpus stays in Spark: hits are a table in the shared folder, votes are counted by pattern, EM adds up in the
tasks. The driver gets term counts of at most ``TERMS`` terms, sums by voter and pair of voters, and the rows of the bounded sample.

Defined results: null texts count as empty and score what a text without hits does. Without learning rows of both kinds every
score is 0.5. Labels other than 0 and 1 and null ids in ``labels`` are passed over; a document with both labels counts as toxic. Documents with a
null id are scored and not held out. Repeated rows are rows of their own. Empty table: empty result. Other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import U, drop_table, gram_hashes, mix, word_table, write_table

SAMPLE = 3_000
TERMS = 256
FIT_ROWS = 12_000
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7)
LEXICONS = 8
#: A term is taken when its log odds are at least this, and so many standard errors above 0, in as many texts.
ODDS, SURE, SUPPORT = 1.8, 2.8, 4
EM_ROUNDS = 8
#: A labelled row counts as much as so many unlabelled ones, and its label is a vote that is right this often.
ANCHOR, LABEL_TRUST = 5.0, 0.9
#: Words in which one hit counts half.
HALF = 200
_PIECE = 1 << 20

#: General insults in four languages, for one voter of its own.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumb fool jerk creep "
    "filth vermin garbage "
    "idiota imbécil estúpido estúpida basura asqueroso "
    "crétin imbécile ordure stupide "
    "dummkopf abschaum trottel widerlich"
).split()

_BREAK = np.ones(256, bool)
_BREAK[65:91] = _BREAK[97:123] = False
_BREAK[128:] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


# ------------------------------------------------------------------ terms in texts


def _pieces(texts):
    """(owner of each piece, pieces) of about ``_PIECE`` bytes together; a long text is cut between words."""
    owners, out, size = [], [], 0
    for i, t in enumerate(texts):
        b, at = (t or "").encode("utf-8", "surrogatepass"), 0
        while at < len(b):
            end = min(at + _PIECE, len(b))
            if end < len(b):
                near = np.flatnonzero(_BREAK[np.frombuffer(b, np.uint8, end - at, at)])
                if len(near):
                    end = at + int(near[-1]) + 1
                else:  # a word of a piece's size: to its end
                    while end < len(b) and not _BREAK[b[end]]:
                        end += 1
            if out and size + end - at > _PIECE:
                yield np.array(owners), out
                owners, out, size = [], [], 0
            owners.append(i)
            out.append(b[at:end])
            size += end - at
            at = end
    if out:
        yield np.array(owners), out


def _terms(pieces: list[bytes]):
    """(owning piece, term hash) of every word and word beginning, the number of words of a piece, and the words' hashes."""
    raw, starts, ends, words, first = word_table(pieces, lower=True, breaks=_BREAK)
    owner = np.repeat(np.arange(len(pieces)), np.diff(first))
    who, what = [owner], [words]
    buf = np.frombuffer(raw, np.uint8)
    packed, at = np.zeros(len(starts), U), 0
    for q in BEGINNINGS:
        while at < q:
            packed = (packed << U(8)) | _FOLD[buf[np.minimum(starts + at, len(buf) - 1)]].astype(U)
            at += 1
        longer = ends - starts > q
        who.append(owner[longer])
        what.append(mix(packed[longer] | U(q << 56)))
    return np.concatenate(who), np.concatenate(what), np.diff(first), words


def _signature(words: np.ndarray) -> list[int]:
    """Three minwise hashes over five words: near copies share one of them nearly always."""
    g = gram_hashes(words, 5) if len(words) >= 5 else words
    return [int(mix(g ^ U(17 * k + 1)).min() >> U(1)) if len(g) else -1 for k in range(3)]


def insult_hashes() -> np.ndarray:
    return word_table([w.encode() for w in INSULTS], lower=True, breaks=_BREAK)[3]


def sample_terms(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the learning sample: (y, k, terms) in a table, and (doc_id, toxic) of all learning rows."""
    lab = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    lab = write_table(lab.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")), "learning")
    k = F.md5(F.col("doc_id").cast("string"))
    ids = [lab.where(F.col("y") == y).orderBy(k, "doc_id").limit(SAMPLE) for y in (0, 1)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")

    def run(batches):
        for b in batches:
            y, key = b.column(0), b.column(1)
            found = [(set(), [np.zeros(0, U)]) for _ in range(b.num_rows)]
            for owners, pieces in _pieces(b.column(2).to_pylist()):
                who, what, n, words = _terms(pieces)
                cut = np.cumsum(n)[:-1]
                for i, w in zip(owners.tolist(), np.split(words, cut), strict=True):
                    found[i][1].append(w)
                order = np.argsort(who, kind="stable")
                for i, t in zip(owners.tolist(), np.split(what[order], np.searchsorted(who[order], np.arange(1, len(pieces)))), strict=True):
                    found[i][0].update(np.unique(t).view(np.int64).tolist())
            sig = [_signature(np.concatenate(w)) for _, w in found]
            yield pa.RecordBatch.from_arrays([y, key, pa.array(sig, pa.list_(pa.int64())), pa.array([list(t) for t, _ in found], pa.list_(pa.int64()))], names=["y", "k", "sig", "terms"])

    sample = rows.select("y", k.alias("k"), "text").mapInArrow(run, "y int, k string, sig array<long>, terms array<long>")
    return write_table(sample, "toxic_sample"), lab


def learn_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(hashes of at most TERMS terms, best first; is it an insult of the general list). None without both labels."""
    # near copies go by one of three minwise hashes: the first row of each hash stays
    for i in range(3):
        first = sample.groupBy(F.col("sig")[i].alias("s")).agg(F.min(F.struct("k", "y")).alias("f"))
        sample = sample.join(first.select(F.col("s").alias("_s"), F.col("f.k").alias("_k")), F.col("sig")[i] == F.col("_s")).where("k = _k").drop("_s", "_k").dropDuplicates(["k"])
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not (n0 and n1):
        return None
    df = sample.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    seeds = insult_hashes()
    sure = df.where(F.col("a") >= SUPPORT).withColumn("z", z).where((F.col("z") >= SURE) & (odds >= ODDS))
    got = sure.orderBy(F.desc("z"), "t").limit(TERMS).collect()
    terms = np.array([r["t"] for r in got], np.int64).view(U)
    rest = np.setdiff1d(seeds, terms)
    terms = np.concatenate([terms, rest])
    return terms, np.isin(terms, seeds)


class Terms:
    """Sorted lookup of the terms, and their lexicons."""

    def __init__(self, terms: np.ndarray, insult: np.ndarray):
        self.order = np.argsort(terms)
        self.sorted = terms[self.order]
        self.insult = insult
        self.n = len(terms)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes`` that are terms, the terms' numbers)."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.n - 1)
        hit = np.flatnonzero(self.sorted[at] == hashes)
        return hit, self.order[at[hit]]


def scan(docs: DataFrame, terms: Terms, *keep: str) -> DataFrame:
    """``keep`` columns and hits of every row: terms, counts, n_words, n_bang, n_caps."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        known = shared.value
        for b in batches:
            n = b.num_rows
            words, bang, caps = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys, counts = [], []
            for owners, pieces in _pieces(b.column(b.num_columns - 1).to_pylist()):
                who, what, k, _ = _terms(pieces)
                np.add.at(words, owners, k)
                for i, p in zip(owners.tolist(), pieces, strict=True):
                    raw = np.frombuffer(p, np.uint8)
                    bang[i] += int((raw == 33).sum())
                    caps[i] += int(((raw[1:] >= 65) & (raw[1:] <= 90) & (raw[:-1] >= 65) & (raw[:-1] <= 90)).sum())
                hit, term = known.find(what)
                key, c = np.unique(owners[who[hit]] * known.n + term, return_counts=True)
                keys.append(key)
                counts.append(c)
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            c = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            key, at = np.unique(key, return_inverse=True)  # a long text comes in several pieces
            total = np.bincount(at, weights=c, minlength=len(key)).astype(np.int64)
            offsets = np.searchsorted(key // known.n, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(key % known.n, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(total, pa.int64())),
                    pa.array(words), pa.array(bang), pa.array(caps),
                ],
                names=[*b.schema.names[:-1], "terms", "counts", "n_words", "n_bang", "n_caps"],
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, fields + "terms array<int>, counts array<long>, n_words long, n_bang long, n_caps long")


# ------------------------------------------------------------------ voters and the label model


def voters(terms: Terms) -> list[Column]:
    """Conditions on a row of :func:`scan`, each a voter that fires or abstains."""
    learned = [i for i in range(terms.n)]
    out = []
    for k in range(LEXICONS):  # the terms dealt in turn by rank, so that all lexicons are about as strong
        mine = F.array(*[F.lit(i) for i in learned[k::LEXICONS]]) if learned[k::LEXICONS] else F.array().cast("array<int>")
        out.append(F.arrays_overlap("terms", mine))
    insults = np.flatnonzero(terms.insult).tolist()
    out.append(F.arrays_overlap("terms", F.array(*[F.lit(i) for i in insults])))
    hits, different = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.size("terms")
    share = hits / F.greatest(F.col("n_words"), F.lit(1))
    out += [different >= 2, different >= 4, hits >= 3, share >= 1 / 300, share >= 1 / 60]
    out += [F.col("n_bang") * 50 >= F.greatest(F.col("n_words"), F.lit(10)), F.col("n_caps") * 10 >= F.greatest(F.col("n_words"), F.lit(10))]
    return [F.coalesce(v, F.lit(False)) for v in out]


def _bits(mask: np.ndarray, m: int) -> np.ndarray:
    return ((mask[:, None] >> np.arange(m)) & 1).astype(np.float64)


class LabelModel:
    """Prior, fire rates by class and the share of its log odds that each voter keeps."""

    def __init__(self, prior: float, rates: np.ndarray, keeps: np.ndarray):
        self.prior, self.rates, self.keeps = prior, rates, keeps

    def posterior(self, fired: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """Of votes, and of labels where there are any (nan: none)."""
        r = self.rates
        on, off = np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))
        z = np.log(self.prior / (1 - self.prior)) + fired @ (self.keeps * on) + (1 - fired) @ (self.keeps * off)
        if label is not None:
            z = z + np.nan_to_num(2 * label - 1) * np.log(LABEL_TRUST / (1 - LABEL_TRUST))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _moments(patterns: DataFrame, model: LabelModel | None, m: int) -> np.ndarray:
    """(2, m + 1, m + 1): by class, sums of pairs of voters that fire together; the last row and column stand for all rows.

    ``patterns``: (mask, n, y), y null where no label is known. Added up in the tasks.
    """

    def run(batches):
        total = np.zeros((2, m + 1, m + 1))
        for b in batches:
            mask, n, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fired = np.c_[_bits(mask.astype(np.int64), m), np.ones(len(mask))]
            y = y.astype(np.float64)
            known = ~np.isnan(y)
            p = model.posterior(fired[:, :m]) if model else np.zeros(len(mask))
            p = np.where(known, np.nan_to_num(y), p)
            w = np.where(known, ANCHOR * n, n if model else 0.0)
            for c, q in enumerate((1 - p, p)):
                total[c] += fired.T @ (fired * (q * w)[:, None])
        c, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[c, i, j])], names=["c", "i", "j", "s"])

    got = patterns.select("mask", "n", "y").mapInArrow(run, "c int, i int, j int, s double").groupBy("c", "i", "j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((2, m + 1, m + 1))
    for r in got:
        out[r["c"], r["i"], r["j"]] = r["s"]
    return out


def _estimate(moments: np.ndarray) -> LabelModel:
    """Rates, prior and correlations from weighted moments."""
    m = moments.shape[1] - 1
    n = moments[:, m, m]
    rates = np.stack([(moments[c, m, :m] + 0.5) / (n[c] + 1.0) for c in (0, 1)])
    spread = np.zeros((m, m))
    for c in (0, 1):
        cov = moments[c, :m, :m] / max(n[c], 1.0) - np.outer(rates[c], rates[c])
        sd = np.sqrt(np.maximum(rates[c] * (1 - rates[c]), 1e-9))
        spread += np.clip(cov / np.outer(sd, sd), 0, 1) / 2
    np.fill_diagonal(spread, 0)
    return LabelModel(float(np.clip((n[1] + 0.5) / (n.sum() + 1.0), 1e-4, 0.9999)), np.clip(rates, 1e-4, 1 - 1e-4), 1 / (1 + spread.sum(1)))


def label_model(votes: DataFrame, m: int) -> LabelModel:
    """EM over (mask, y) of all documents, y null where it is not known."""
    patterns = write_table(votes.groupBy("mask", "y").agg(F.count(F.lit(1)).alias("n")), "vote_patterns")
    model = _estimate(_moments(patterns, None, m))
    prior = model.prior
    for _ in range(EM_ROUNDS):
        model = _estimate(_moments(patterns, model, m))
        model.prior = prior  # the share of toxic texts is known from the learning rows
    drop_table(patterns)
    return model


# ------------------------------------------------------------------ the linear classifier


def _features(terms: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, n: int) -> np.ndarray:
    """Each term's share of the words, saturating at one in ``HALF``; the share of all hits and of different terms; a constant."""
    x = np.zeros((len(terms), n + 3))
    per = np.maximum(words, 1) / HALF
    hits = np.zeros(len(terms))
    for i, (t, c) in enumerate(zip(terms, counts, strict=True)):
        x[i, t] = c / (c + per[i])
        hits[i] = c.sum()
    x[:, n], x[:, n + 1], x[:, n + 2] = np.log1p(hits / per), np.log1p([len(t) for t in terms] / per), 1
    return x


def _fit(x: np.ndarray, p: np.ndarray, w: np.ndarray, steps: int = 30, ridge: float = 2.0) -> np.ndarray:
    """Logistic regression on soft labels ``p`` with row weights, by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * (q * (1 - q) + 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (w * (p - q)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _columns(rows: list, n: int) -> np.ndarray:
    return _features([np.array(r["terms"], np.int64) for r in rows], [np.array(r["counts"], float) for r in rows], np.array([r["n_words"] for r in rows], float), n)


def train(hits: DataFrame, lab: DataFrame, terms: Terms) -> np.ndarray:
    """Coefficients of the linear classifier, from the hits of all rows of a corpus."""
    votes = voters(terms)
    m = len(votes)
    mask = sum((F.when(v, F.lit(1 << k).cast("long")).otherwise(0) for k, v in enumerate(votes)), F.lit(0).cast("long"))
    rows = hits.withColumn("mask", mask).join(lab, "doc_id", "left")
    model = label_model(rows.select("mask", F.col("y").cast("double").alias("y")), m)
    # the classifier sees learning rows and their posteriors: as many with a hit as without
    k = F.xxhash64(F.col("doc_id"), F.lit(29))
    pool = rows.where(~F.coalesce(held_out(), F.lit(False))).select("terms", "counts", "n_words", "mask", F.col("y").cast("double").alias("y"), k.alias("k"), "doc_id")
    some = F.size("terms") > 0
    parts, sizes = [], {r["s"]: r["n"] for r in pool.groupBy(some.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    for s in (True, False):
        got = pool.where(some if s else ~some).orderBy("k", "doc_id", "mask", "terms", "counts").limit(FIT_ROWS // 2).collect()
        parts.append((got, sizes.get(s, 0) / max(len(got), 1)))
    rows = [r for got, _ in parts for r in got]
    weight = np.concatenate([np.full(len(got), w) for got, w in parts])
    p = model.posterior(_bits(np.array([r["mask"] for r in rows], np.int64), m), np.array([np.nan if r["y"] is None else r["y"] for r in rows]))
    return _fit(_columns(rows, terms.n), p, weight * len(rows) / weight.sum())


def score_hits(hits: DataFrame, beta: np.ndarray, n: int) -> DataFrame:
    """``hits`` with score in place of the columns of :func:`scan`."""
    rows = hits.drop("n_bang", "n_caps").select(*[c for c in hits.columns if c not in ("terms", "counts", "n_words", "n_bang", "n_caps")], "terms", "counts", "n_words")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                cols = {"terms": b.column(b.num_columns - 3).to_pylist(), "counts": b.column(b.num_columns - 2).to_pylist(), "n_words": b.column(b.num_columns - 1).to_pylist()}
                x = _columns([dict(zip(cols, r, strict=True)) for r in zip(*cols.values(), strict=True)], n)
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(p, pa.float64())], names=[*b.schema.names[:-3], "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-3])
    return rows.mapInArrow(run, fields + "score double")


def score(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns (doc_id first) and score of every row of ``docs``, the model fitted on these documents and labels."""
    sample, lab = sample_terms(docs, labels)
    learned = learn_terms(sample)
    if learned is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    terms = Terms(*learned)
    hits = write_table(scan(docs, terms, *keep), "hits", [sample])
    return score_hits(hits, train(hits.select("doc_id", "terms", "counts", "n_words", "n_bang", "n_caps"), lab, terms), terms.n)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), labels, "doc_id")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
