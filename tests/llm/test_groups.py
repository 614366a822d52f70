"""Spelling variants, centroid clustering and weak supervision on small tables with hard rows, held against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from boxloom.llm import clustering, spelling, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ------------------------------------------------------------------ 11


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    out = {}
    for w in n:
        other = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form = other[0] if other and n[other[0]] >= 2 * n[w] else None
        out[w] = [form, n[w], len(other), n[form] if form else None]
    for w, v in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        v.insert(1, root)
    return {w: tuple(v) for w, v in out.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary(rng, size, letters, syllables):
    words = set()
    while len(words) < size:
        w = "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 6)))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w = w[:i] + rng.choice(letters) * rng.randrange(2) + w[i + rng.randrange(2) :]
        if len(w) >= 5:
            words.add(w)
    return {w: rng.choice([3, 4, 5, 8, 20, 50, 400]) for w in words}


@pytest.mark.parametrize("dictionary, hot", [(4096, 8192), (8, 8192), (64, 30), (4096, 2)])
def test_spelling_groups_against_plain_loop(spark, monkeypatch, dictionary, hot):
    """Coarse and fine dictionaries, and lists that are too large and go by variants."""
    rng = random.Random(dictionary + hot)
    n = vocabulary(rng, 700, "abñ", ["ab", "ba", "aab", "ñan", "nab", "aaa"])
    n |= {"a" * k: 10 * k for k in range(5, 36)} | {"ab" * k + "b": 7 + k for k in range(13, 18)}
    monkeypatch.setattr(spelling, "DICT", dictionary)
    near_words = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda words: near_words(words, hot))
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling.spelling_groups(table)) == plain_groups(n)


def test_most_words_go_by_their_grams():
    rng = random.Random(5)
    n = vocabulary(rng, 3000, "abcdefgh", ["the", "re", "tion", "an", "ou", "ing", "sh", "ed", "ly", "hea"])
    counts = Counter(p[i : i + q] for w in n for p in [f"\x02{w}\x03"] for q in (2, 3, 4) for i in range(len(p) - q + 1))
    g = spelling.Grams({x: k for x, k in counts.items() if k > 60})
    certain = sum(g.chosen(w)[1] for w in n)
    assert certain >= 0.9 * len(n)
    assert {e - p for w in n for p, e in g.decompose(f"\x02{w}\x03")} == {2, 3, 4}


def test_bound_holds_for_every_edit():
    rng = random.Random(7)
    n = vocabulary(rng, 300, "abc", ["ab", "bc", "cab", "aa"])
    counts = Counter(p[i : i + q] for w in n for p in [f"\x02{w}\x03"] for q in (2, 3, 4) for i in range(len(p) - q + 1))
    g = spelling.Grams({x: k for x, k in counts.items() if k > 25})
    for w in n:
        p = f"\x02{w}\x03"
        mine = g.decompose(p)
        b = g.bound(p, mine)
        for i in range(len(w) + 1):
            for t in {w[:i] + w[i + 1 :]} | {w[:i] + c + w[i + k :] for c in "abc" for k in (0, 1)}:
                q = f"\x02{t}\x03"
                shift = len(t) - len(w)
                other = {(x, q[x:y]) for x, y in g.decompose(q)}
                kept = sum((x, p[x:y]) in other or (x + shift, p[x:y]) in other for x, y in mine)
                assert len(mine) - kept <= b, (w, t)


def test_spelling_of_documents(spark):
    rng = random.Random(9)
    words = list(vocabulary(rng, 60, "abé", ["Abé", "zon", "tra", "éla"]))
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "9", "Ā", "ß×"]) for _ in range(400))) for i in range(60)]
    rows += [(7, rows[7][1]), (None, "zontra " * 5), (100, None), (101, ""), (102, "x y é " * 200), (103, "TRAZON " * 90_000)]
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    assert found(spelling.spelling_variants(docs)) == plain_groups({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})
    empty = spelling.spelling_variants(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


# ------------------------------------------------------------------ 12


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, np.array([int(x) for x in v], object)) for i, v in kept]
    fits = [(i, v) for i, v in kept if all(abs(x) < 2**27 for x in v)]
    start = sorted(fits, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), list(r[1])))
    c = [v for _, v in start[:k]]
    nearest = lambda v: min((int(((v - x) ** 2).sum()), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in fits:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [sum(groups[j]) // len(groups[j]) if j in groups else c[j] for j in range(len(c))]
    got = [(i, *nearest(v)) for i, v in fits]
    per = Counter()
    for _, d, j in got:
        per[j] += d
    total = sum(per.values())
    sha = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return sorted([(i, j, d, per[j], total, sha(j)) for i, d, j in got] + [(i, None, None, None, None, None) for i, v in kept if not all(abs(x) < 2**27 for x in v)], key=str)


def test_clusters_against_plain_loop(spark):
    rng = np.random.RandomState(4)
    rows = [(i, (rng.randn(64) * 0.2).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 340)] + [(5, rows[5][1]), (5, rows[6][1])]  # equal vectors, a repeated id
    grid = [[float(x)] + [0.0] * 63 for x in (-2, -1, 0, 1, 2)]
    rows += [(400 + i, grid[i % 5]) for i in range(30)]  # ties
    rows += [(500, None), (501, [0.1] * 63), (502, [0.1] * 65), (503, [None] + [0.0] * 63), (504, [float("nan")] * 64), (505, [float("inf")] + [0.0] * 63)]
    rows += [(506, [3e6] + [0.0] * 63), (None, [-0.5] * 64), (508, []), (509, [-1000.25] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int")
    got = sorted([tuple(r) for r in clustering.cluster(df).collect()], key=str)
    assert got == plain_clusters(rows)
    few = df.where("vec_id < 3")
    assert sorted([tuple(r) for r in clustering.cluster(few).collect()], key=str) == plain_clusters(rows[:3])
    assert clustering.cluster(df.limit(0)).count() == 0


def test_tree_answers_like_all_distances_and_looks_at_fewer():
    rng = np.random.RandomState(8)
    centres = rng.randint(-200, 200, (40, 64))
    points = np.concatenate([c + rng.randint(-12, 13, (30, 64)) for c in centres] + [centres, (centres[:1] + centres[1:2]) // 2])
    points = points.astype(np.int64)
    centres[7] = centres[3]  # a tie everywhere
    who, d, looked = clustering.VantageTree(centres).nearest(points)
    every = ((points[:, None, :] - centres[None]) ** 2).sum(2)
    assert (who == every.argmin(1)).all() and (d == every.min(1)).all()
    assert looked < 0.8 * every.size


# ------------------------------------------------------------------ 13


def toxic_corpus(n=900, seed=1):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(4)) for _ in range(300)]
    bad = ["grobbel", "snarfik", "vlektor", "idiot", "moron", "quzzan"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(clean) for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(rng.randrange(3, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "a", "os"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus()
    rows = docs + [(5000, None), (5001, ""), (None, docs[0][1]), (5, docs[5][1]), (5002, "grobbel " * 300_000), (5003, "badekilo " * 300_000)]
    d = spark.createDataFrame([(i, t, "en", 0.5, 1, [1]) for i, t in rows], "doc_id long, text string, lang string, score double, y int, terms array<int>")
    # labels of held-out rows are turned round: the scores must not know
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    given = [(i, q, 1 - t if held(i) else t) for i, q, t in labels] + [(None, 1, 1), (3, 1, None), (9999, 1, 1), (4, 0, 7)]
    got = toxicity.classify(d, spark.createDataFrame(given, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    by = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and held(r.doc_id))
    tests = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in tests) >= 0.97 * len(tests) and len(tests) > 200
    assert by[5002].predicted == 1 and by[5003].predicted == by[5000].predicted == by[5001].predicted == 0
    assert by[5000].score == by[5001].score
    one = toxicity.classify(d, spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int"))
    assert {r.score for r in one.collect()} == {0.5}
    assert toxicity.classify(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_label_model_finds_rates_and_correlations(spark):
    """Votes drawn from known rates; voter 5 repeats voter 4."""
    rng = np.random.RandomState(2)
    y = rng.rand(20_000) < 0.15
    on, off = np.array([0.8, 0.7, 0.6, 0.9, 0.5]), np.array([0.05, 0.1, 0.02, 0.2, 0.01])
    fired = rng.rand(len(y), 5) < np.where(y[:, None], on, off)
    fired = np.c_[fired, fired[:, 4]]
    mask = (fired * (1 << np.arange(6))).sum(1)
    known = np.where(np.arange(len(y)) < 600, y.astype(float), np.nan)
    rows = [(int(m), None if np.isnan(k) else float(k)) for m, k in zip(mask, known, strict=True)]
    model = toxicity.label_model(spark.createDataFrame(rows, "mask long, y double"), 6)
    assert np.abs(model.rates[1][:5] - on).max() < 0.06 and np.abs(model.rates[0][:5] - off).max() < 0.03
    assert abs(model.prior - 0.15) < 0.05
    assert model.keeps[4] < 0.6 and model.keeps[5] < 0.6 and model.keeps[:4].min() > 0.8
    p = model.posterior(fired.astype(float))
    assert ((p > 0.5) == y).mean() > 0.96


def test_pieces_cover_long_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "_PIECE", 64)
    texts = ["one two three " * 40, None, "x" * 500 + " end", "", "short"]
    got = {}
    for owners, pieces in toxicity._pieces(texts):
        for i, p in zip(owners.tolist(), pieces, strict=True):
            got[i] = got.get(i, b"") + p
    assert {i: b.decode() for i, b in got.items()} == {i: t for i, t in enumerate(texts) if t}
