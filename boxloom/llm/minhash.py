"""MinHash near-dedup: a chosen-path set similarity join, and the components of its links.

A document's set holds the hashes (64 bits) of its distinct runs of five words, words being runs outside
``[\\x20\\x09-\\x0D]`` with A-Z folded; fewer words make one run. Two documents are linked if
``100 * intersection >= 75 * union``; every link is confirmed on the full sets, computed from the texts.

1. Equal sets form a class; its smallest doc_id stands for it.
2. Chosen paths. Each of ``TREES`` independent trees chooses minwise positions (1/lambda of them on average); documents that
   agree in the minwise token of a chosen position meet in a node.
3. Contraction. In each node every document is offered to the node's smallest document; the one that it meets in most nodes, ``SHARED``
   at least, is verified. Linked documents form components, and a node within one component is done. This settles large
   groups of copies in work linear in their size; what it leaves out is compared in the nodes.
4. Recursion. A node of at most ``NODE_SIZE`` documents is compared exhaustively, between components only: first by sketches
   (``POSITIONS`` minwise tokens of 16 bits), then on full sets. A larger one branches: its path draws ``BRANCH`` positions, and its
   documents go on to the children of their tokens there. What a level has linked needs no comparing in the next. A level costs
   a dozen shuffles, so a child that makes one block (below) is compared exhaustively too and does not branch again.
5. A large node whose children would hold as many pairs as itself (its documents are alike without being linked), and what is
   large after ``DEPTH`` levels, is cut into blocks instead, and every pair of blocks is compared in a task of its own. Documents
   with the same largest node of this kind are compared there, and not again in the others; those with different ones are.

Recall. A pair at the threshold agrees in a position with 0.75, so it stays together in a child at each level with
1 - 0.25 ** BRANCH = 0.984. It is missed if it meets in none of the ``len(ROOTS)`` = 10 roots or is parted below each: with
probability 0.25 ** 10 = 1e-6 where nodes are small, (1 - 0.75 * 0.984 ** DEPTH) ** 10 = 1e-5 where all of them branch to the end.

Defined results: documents without words (null and empty texts) have empty sets and are linked with nothing; rows that
repeat a doc_id are in its class; a null doc_id takes no part and is its own component (null); an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import HOT_KEYS, U, chunks, gram_hashes, hot_keys, mix, over_salts, partitions, salted, word_table, write_table
from boxloom.llm.components import components, extend

SHINGLE = 5
THRESHOLD = 0.75
POSITIONS = 64
TREES = 8
SEED = 11
#: Documents up to which a node is compared exhaustively; positions a larger one branches on; levels of branching.
NODE_SIZE = 128
BRANCH, DEPTH = 3, 6
#: Documents times shingles of a pair of blocks that one task compares, and documents of a block.
NODE_WORK, BLOCK_ROWS = 1 << 28, 512.0
#: Members of a node from which its rows are dealt over several tasks.
HOT_ROWS = 2_000
#: Keys of nodes that are broadcast; more are joined by salts.
BROADCAST_NODES = HOT_KEYS
_A = mix(np.arange(1, POSITIONS + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(SEED)) | U(1)


def chosen(path: int, positions: int = POSITIONS, lam: float = THRESHOLD) -> list[int]:
    """Positions that a node of this path branches on: each with probability 1 / (lam * positions), one at least."""
    u = mix(np.arange(positions, dtype=U) + U(path % 2**63) * U(1_000_003)).astype(np.float64) / 2.0**64
    got = np.flatnonzero(u < 1 / (lam * positions))
    return got.tolist() or [int(u.argmin())]


#: Root branches of all trees: the distinct chosen positions.
ROOTS = sorted({p for t in range(TREES) for p in chosen(t + 1)})
#: Roots in which a document meets the one that it is verified with in the contraction; a pair at the threshold does with 0.98.
SHARED = len(ROOTS) // 2


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = _shingles(texts)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, with repeats, and where each text's begin."""
    _, _, _, words, first = word_table(texts, lower=True)
    g = gram_hashes(words, SHINGLE)
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(at[-1], U)
    pos = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    full = np.repeat(n >= SHINGLE, count)
    out[full] = g[pos[full]]
    for t in np.flatnonzero((n > 0) & (n < SHINGLE)):  # one run of the whole sequence
        out[at[t]] = gram_hashes(words[first[t] : first[t + 1]], int(n[t]))[0] ^ U(n[t])
    return out, at


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, own (the rest of ``docs``: one column), n_shingles, fp (16 bytes, of the set), sketch (128 bytes), roots (array of long)."""
    roots = np.array(ROOTS)

    def run(batches):
        for b in batches:
            for at, texts in chunks(b.column(1).to_pylist(), 1 << 20):
                h, first = _shingles(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(first))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[new], doc[new]
                n = np.bincount(doc, minlength=len(texts))
                has = np.flatnonzero(n)
                low = np.zeros((len(texts), POSITIONS), U)
                fp = np.zeros((len(texts), 2), U)
                if len(has):
                    start = (np.cumsum(n) - n)[has]
                    for j in range(POSITIONS):
                        low[has, j] = np.minimum.reduceat(h * _A[j], start)
                    fp[has, 0], fp[has, 1] = np.add.reduceat(mix(h), start), np.add.reduceat(mix(h ^ U(0xABCDEF0123456789)), start)
                sk = (mix(low) >> U(48)).astype(np.uint16)
                keys = mix(low[:, roots] ^ (roots.astype(U) << U(32))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(texts)), b.column(2).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array([x.tobytes() for x in sk], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(roots), pa.int32()), pa.array(keys.ravel(), pa.int64())),
                    ],
                    names=["doc_id", "own", "n_shingles", "fp", "sketch", "roots"],
                )

    return docs.select("doc_id", "text", "own").mapInArrow(run, "doc_id long, own long, n_shingles long, fp binary, sketch binary, roots array<long>")


# ------------------------------------------------------------------ sketches

_AGREE_SD = (THRESHOLD * (1 - THRESHOLD) / POSITIONS) ** 0.5
#: Agreeing sketch tokens that a linked pair has except with a probability of about 1e-5 (4.3 deviations below the mean).
AGREE = int(np.floor(POSITIONS * (THRESHOLD - 4.3 * _AGREE_SD)))


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on full sets."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < 75 * max(len(a), len(b)):
        return False
    c = np.concatenate((a, b))
    c.sort(kind="stable")
    inter = int((c[1:] == c[:-1]).sum())
    return 100 * inter >= 75 * (len(a) + len(b) - inter)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` that are links. A text that stands in many pairs is joined where Spark can split it."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    needed = write_table(texts.join(ids.hint("merge"), "doc_id"), "pair_texts")  # the corpus moves once
    hot = hot_keys(pairs, "b", HOT_ROWS)  # a family's smallest document stands in the pairs of all of it
    left = salted(pairs.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a"), hot, "b", "a")
    right = over_salts(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), hot, "b")

    def run(batches):
        for x in batches:
            ids = x.column(0), x.column(1)
            ok = []
            ta, tb = x.column(2).to_pylist(), x.column(3).to_pylist()
            for at, part in chunks(ta):
                sa, sb = shingle_sets(part), shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in tb[at : at + len(part)]])
                ok += [at + i for i, (p, q) in enumerate(zip(sa, sb, strict=True)) if linked(p, q)]
            yield pa.RecordBatch.from_arrays([i.take(pa.array(ok, pa.int64())) for i in ids], names=["a", "b"])

    return left.join(right.hint("merge"), ["b", "salt"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


# ------------------------------------------------------------------ nodes in tasks


class _Union:
    def __init__(self, labels: np.ndarray):
        _, self.p = np.unique(labels, return_inverse=True)

    def join(self, i: int, j: int) -> None:
        a, b = self.p[i], self.p[j]
        if a != b:
            self.p[self.p == max(a, b)] = min(a, b)


def plausible(sk: np.ndarray, comp: np.ndarray, n: np.ndarray, step: int = 256) -> np.ndarray:
    """Members that could be linked with a member of another component, judging by sketches and sizes."""
    hit = np.zeros(len(sk), bool)
    for lo in range(0, len(sk), step):
        part = sk[lo : lo + step]
        agree = np.zeros((len(part), len(sk)), np.uint8)
        for j in range(POSITIONS):
            agree += part[:, j, None] == sk[None, :, j]
        ok = (agree >= AGREE) & (comp[lo : lo + step, None] != comp[None, :])
        ok &= (np.minimum(n[lo : lo + step, None], n[None, :]) * 100 >= 75 * np.maximum(n[lo : lo + step, None], n[None, :]))
        hit[lo : lo + step] |= ok.any(1)
        hit |= ok.any(0)
    return hit


def node_links(sets: list[np.ndarray], comp: np.ndarray) -> list[tuple[int, int]]:
    """Links between components, enough to join all components of the node that are linked: exhaustive on full sets.

    Counts of common shingles come from an inverted index of the members before; members whose unshared shingles
    alone rule out a link are left out first.
    """
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, U)
    _, inv, df = np.unique(flat, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(doc, weights=(df[inv] > 1), minlength=len(sets))
    live = (n > 0) & (shared * 100 >= 75 * n)
    # postings of live members, by shingle, in the members' order
    keep = live[doc] & (df[inv] > 1)
    inv, doc = inv[keep], doc[keep]
    order = np.lexsort((doc, inv))
    post = doc[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(inv, minlength=len(df)))))
    own = np.split(inv, np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []
    members = doc[np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1))] if len(doc) else []
    uf, out = _Union(comp), []
    for x, terms in zip(members, own, strict=True):
        if (uf.p[live] == uf.p[x]).all():
            continue
        lo, hi = bounds[terms], bounds[terms + 1]
        k = hi - lo
        at = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        inter = np.bincount(post[at], minlength=len(sets))
        ok = np.flatnonzero((100 * inter >= 75 * (n[x] + n - inter)) & (uf.p != uf.p[x]) & live)
        for y in ok:
            if uf.p[y] != uf.p[x]:
                out.append((int(x), int(y)))
                uf.join(x, y)
    return out


def _groups(batches, keys: int = 1):
    """Consecutive rows with equal first column, across batches, as lists of columns."""
    cur, rows = None, None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            part = b.slice(a, z - a)
            if rows is not None and key[a] == cur:
                rows.append(part)
            else:
                if rows is not None:
                    yield cur, pa.Table.from_batches(rows).combine_chunks()
                cur, rows = key[a], [part]
    if rows is not None:
        yield cur, pa.Table.from_batches(rows).combine_chunks()


def _sketch_pass(nodes: DataFrame) -> DataFrame:
    """(node, rep, comp, n, sketch) to the members (node, rep, comp) that need full sets."""

    def run(batches):
        for _, t in _groups(batches):
            hit = plausible(_matrix(t.column("sketch")), t.column("comp").to_numpy(), t.column("n").to_numpy())
            if hit.any():
                yield from t.filter(pa.array(hit)).select(["node", "rep", "comp"]).to_batches()

    return nodes.select("node", "rep", "comp", "n", "sketch").repartition(partitions(nodes.sparkSession), "node").sortWithinPartitions("node", "rep").mapInArrow(run, "node long, rep long, comp long")


def _exact_pass(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components (their ids, not documents') within each node."""
    rows = members.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("node", "rep", "comp", "text")

    def run(batches):
        for _, t in _groups(batches):
            ids = t.column("comp").to_numpy()
            sets: list[np.ndarray] = []
            for _, part in chunks(t.column("text").to_pylist()):
                sets += shingle_sets(part)
            pairs = node_links(sets, ids)
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(a)], pa.int64()), pa.array(ids[list(b)], pa.int64())], names=["a", "b"])

    return rows.repartition(partitions(rows.sparkSession), "node").sortWithinPartitions("node", "rep").mapInArrow(run, "a long, b long")


def _size(rows: int) -> int:
    """Rows of one key that stay together: at most ``HOT_KEYS`` keys are larger."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def _parts(counts: DataFrame, key: str, count: str, size: int) -> DataFrame:
    """(key, parts) of the keys with more than ``size`` rows; if there are none, of the largest one.

    Spark drops a join with an empty table at run time. With a row always there, the plan and its row counts do not hang on whether a key is hot.
    """
    top = counts.agg(F.max(F.struct(count, key)).alias("x")).select("x.*").where(F.col(count) <= size)
    return counts.select(key, count).where(F.col(count) > size).unionByName(top.select(key, count)).select(key, F.ceil(F.col(count) / size).cast("int").alias("parts"))


def _with_sums(rows: DataFrame, sums: DataFrame, key: str, count: str, size: int) -> DataFrame:
    """``rows`` joined with ``sums`` (a row per key, ``count`` its rows), the rows of large keys dealt over several tasks."""
    hot = _parts(sums, key, count, size)
    return salted(rows, hot, key, "rep").join(over_salts(sums, hot, key).hint("merge"), [key, "salt"]).drop("salt")


def _block_size():
    """Documents of a block of a node (m, work)."""
    return F.least(F.greatest(F.col("m") / F.ceil(2 * F.sqrt(F.col("work") / F.lit(NODE_WORK))), F.lit(1.0)), F.lit(BLOCK_ROWS))


def block_pairs(large: DataFrame) -> DataFrame:
    """Large nodes (node, rep, comp, n, work, m) to one node (node, rep, comp, n) for each pair of their blocks.

    Two blocks are within ``NODE_WORK`` together. Components above a block's size have blocks of their own, the others share.
    Documents that are alike meet in many large nodes. The largest node of each is its home; the members of a node that share another home
    have blocks of their own if they fill one, and these are not compared with each other here: their home does it.
    """
    home = F.max(F.struct("m", "node")).over(Window.partitionBy("rep"))["node"]
    large = write_table(large.select("node", "rep", "comp", "n", _block_size().alias("per"), home.alias("home")), "homes")
    large = large.withColumn("cell", F.xxhash64("node", "home", "comp"))
    cells = write_table(large.groupBy("node", "home", "comp", "cell").agg(F.count(F.lit(1)).alias("c"), F.max("per").alias("per")), "cells")
    away = cells.groupBy("node", "home").agg(F.when(F.sum("c") >= F.max("per"), F.col("home")).otherwise(F.col("node")).alias("part"))
    parted = write_table(cells.join(away, ["node", "home"]).drop("home"), "cells", [cells])
    size = parted.groupBy("node", "part", "comp").agg(F.sum("c").alias("k"), F.max("per").alias("per"))
    few = size.where("k <= per").groupBy("node", "part").agg(F.ceil(F.sum("k") / F.max("per")).alias("shared"))
    size = size.drop("per").join(few, ["node", "part"], "left")
    size = write_table(parted.join(size, ["node", "part", "comp"]).select("cell", "part", "c", "k", "shared"), "cells", [parted])
    own = F.xxhash64("node", "part", "comp", F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / F.col("per"))))
    block = F.when(F.col("k") > F.col("per"), own).otherwise(F.xxhash64("node", "part", F.lit("shared"), F.pmod(F.xxhash64("comp"), "shared")))
    rows = write_table(_with_sums(large, size, "cell", "c", _size(large.count())).select("node", "part", "rep", "comp", "n", block.alias("block")), "blocks", [size, large])
    blocks = rows.groupBy("node", "part", "block").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    other = blocks.select("node", F.col("part").alias("part2"), F.col("block").alias("other"), F.col("c1").alias("d1"), F.col("c2").alias("d2"))
    pairs = blocks.join(other, "node").where("block <= other AND least(c1, d1) < greatest(c2, d2) AND (part <> part2 OR part = node)")
    pairs = pairs.select(F.xxhash64("node", "block", "other").alias("pair"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return rows.select("rep", "comp", "n", "block").join(pairs, "block").select(F.col("pair").alias("node"), "rep", "comp", "n")


def branch(large: DataFrame, sk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large nodes (node, rep, comp, n, work, m): (children's members (node, rep, n), the nodes that gain nothing by branching).

    The path (a node's key) draws the positions; a child's key is that of path, position and token.
    """
    rows = large.join(sk.select(F.col("doc_id").alias("rep"), "sketch"), "rep")
    draw = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(BRANCH - 1)), lambda j: F.pmod(F.xxhash64("node", j), F.lit(POSITIONS)).cast("int")))
    rows = rows.select("node", "m", "rep", "n", "sketch", F.explode(draw).alias("at"))
    child = F.xxhash64("node", "at", F.substring("sketch", F.col("at") * 2 + 1, F.lit(2)))
    rows = write_table(rows.select("node", "m", child.alias("child"), "rep", "n"), "children")
    sizes = rows.groupBy("node", "m", "child").agg(F.count(F.lit(1)).alias("k"))
    gains = sizes.groupBy("node", "m").agg(F.sum(F.col("k") * F.col("k")).alias("pairs"))
    stuck = write_table(gains.where("pairs * 2 > m * m").select("node", F.col("m").alias("k")), "stuck_nodes")
    keys = stuck.select("node")
    if stuck.count() <= BROADCAST_NODES:
        gone = F.broadcast(keys)
        return rows.join(gone, "node", "left_anti").select(F.col("child").alias("node"), "rep", "n"), large.join(gone, "node", "left_semi")
    size = _size(rows.count())  # nodes are large: anti- and semi-joins of hot ones are left to salts
    hot = stuck.where(F.col("k") > size).select("node", F.ceil(F.col("k") / size).cast("int").alias("parts"))
    gone = over_salts(keys, hot, "node").hint("merge")
    kept = salted(rows, hot, "node", "rep").join(gone, ["node", "salt"], "left_anti").select(F.col("child").alias("node"), "rep", "n")
    return kept, salted(large, hot, "node", "rep").join(gone, ["node", "salt"], "left_semi").drop("salt")


# ------------------------------------------------------------------ the join


def near_components(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, component) of the class representatives that are linked with another.

    The components of a level are those of the level before, joined by the links that it has found between them.
    ``reps``: doc_id, n_shingles, sketch, roots, one row per class; ``texts``: doc_id, text.
    """
    sk = reps.select("doc_id", "sketch")
    nodes = reps.select(F.explode("roots").alias("node"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    tops = write_table(nodes.groupBy("node").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1"), "tops")
    members = write_table(_with_sums(nodes, tops, "node", "k", _size(reps.count() * len(ROOTS))).drop("k"), "members", [tops])
    # contraction: all rows of a document, one for each root at most, go to one task
    met = members.where("rep <> pivot").repartition(partitions(reps.sparkSession), "rep").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("k"))
    best = met.where(F.col("k") >= SHARED).groupBy("rep").agg(F.max(F.struct("k", (-F.col("pivot")).alias("p"))).alias("x"))
    offered = write_table(best.select(F.col("rep").alias("a"), (-F.col("x.p")).alias("b")), "offers")
    links = write_table(verify(offered, texts), "links", [offered])
    nodes, old, comp = members.select("node", "rep", "n"), [members], components(links)
    for depth in range(DEPTH + 1):
        with_comp = nodes.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("node", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        with_comp = write_table(with_comp, "node_members", old)
        sums = with_comp.groupBy("node").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("m"), (F.count(F.lit(1)) * F.sum("n")).alias("work"))
        sums = write_table(sums.where("c1 < c2").drop("c1", "c2"), "node_sums")
        live = write_table(_with_sums(with_comp, sums, "node", "m", _size(with_comp.count())), "live", [with_comp, sums])
        most = F.greatest(F.lit(float(NODE_SIZE)), _block_size()) if depth else F.lit(float(NODE_SIZE))
        small, large = live.where(F.col("m") <= most), live.where(F.col("m") > most)
        branched = depth < DEPTH and not large.isEmpty()
        if branched:
            nodes, large = branch(large, sk)
            nodes, large = write_table(nodes, "nodes"), write_table(large, "stuck")
        todo = small.unionByName(large.where(F.col("m") <= _block_size())).select("node", "rep", "comp", "n")  # one block is one task's work
        large = large.where(F.col("m") > _block_size())
        if not large.isEmpty():
            todo = todo.unionByName(block_pairs(large))
        picked = write_table(_sketch_pass(todo.join(sk.select(F.col("doc_id").alias("rep"), "sketch"), "rep")), "picked")
        comp = extend(comp, write_table(_exact_pass(picked, texts), "links", [picked, live]))
        if not branched or nodes.isEmpty():
            break
        old = [nodes]
    return comp


def _classes(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text, own. Returns doc_id, own, n_shingles, component_id (null without words), one row per row."""
    sigs = write_table(signatures(docs), "signatures")
    usable = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # sketch and roots are those of the set, the same in all rows of a class
    classes = usable.groupBy("fp", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"), F.count(F.lit(1)).alias("copies"))
    classes = write_table(classes, "classes")
    reps = classes.groupBy("doc_id").agg(F.min_by(F.struct("n_shingles", "sketch", "roots"), "fp").alias("x"))
    reps = write_table(reps.select("doc_id", "x.*"), "reps")
    comp = near_components(reps, docs.select("doc_id", "text"))
    named = classes.join(comp, classes["doc_id"] == comp["id"], "left").select("fp", "n_shingles", "copies", F.coalesce("component", "doc_id").alias("component_id"))
    named = write_table(named, "named", [comp, reps, classes])
    # a class of very many copies is joined by several tasks
    key, size = ["fp", "n_shingles"], _size(sigs.count())
    hot = named.where(F.col("copies") > size).select(*key, F.ceil(F.col("copies") / size).cast("int").alias("parts"))
    out = salted(sigs.select("doc_id", "own", *key), hot, key, "doc_id").join(over_salts(named.drop("copies"), hot, key).hint("merge"), [*key, "salt"], "left")
    return out.select("doc_id", "own", "n_shingles", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("long").alias("own"))
    out = _classes(rows)
    cid = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"))


def _row_key(docs: DataFrame):
    """A key of (doc_id, text): rows that share an id but not the text are documents of their own, and so are those without an id."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: of each group the document of the smallest doc_id (null comes last)."""
    rows = docs.select(_row_key(docs).alias("doc_id"), docs["text"].cast("string").alias("text"), docs["doc_id"].cast("long").alias("own"))
    out = write_table(_classes(rows).where("n_shingles > 0"), "row_components")
    first = out.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("no_id"), "own", "doc_id"))["doc_id"].alias("stays"), F.count(F.lit(1)).alias("k"))
    first = write_table(first.where("k > 1"), "stays")
    gone = _with_sums(out.withColumn("rep", F.col("doc_id")), first, "component_id", "k", _size(out.count())).where("doc_id <> stays").select(F.col("doc_id").alias("_gone")).distinct()
    gone = write_table(gone, "gone", [out, first])
    return docs.join(gone.hint("merge"), _row_key(docs) == gone["_gone"], "left_anti")
