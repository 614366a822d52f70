"""Centroid clustering with exact integers: a vantage-point tree over the centroids answers each vector's nearest centroid.

Kept are vectors with exactly ``DIMS`` components, none null or non-finite; component x becomes floor(256 * x). The start are the ``k``
kept vectors whose sha256 of ``2:<vec_id>`` is smallest. A round assigns every vector to the nearest centroid and moves each
centroid that has vectors to floor(sum / count) of every component.

Each round builds the tree anew from the ``k`` centroids (k x 64 integers, a fixed size), and broadcasts it. A vector takes the open node
with the least bound first and stops when no bound is within its best distance. The radius is inclusive, so that a centroid at the
same distance and of a smaller number is still seen. Bounds are doubles with a margin for rounding; distances that decide are 64-bit integers. What
goes to the driver is k x 64 sums a round, combined in the tasks first. Vectors are quantised once, into a table in the shared folder.

Defined results: vectors of another length, null vectors and vectors with null or non-finite components give no row. A kept vector
with a component of |256 x| >= 2^27 (whose distances do not fit 64 bits) gives a row with null cluster, distance and sums and takes no
part in the rounds. Repeated vec_ids are rows of their own; among the starting vectors equal ids go by their components. A null vec_id counts
as the empty text in the hash. Fewer than k vectors: each is a centroid. Empty table: empty result. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.common import drop_table, write_table

DIMS = 64
K = 40
ROUNDS = 5
#: Components from here on are set aside: 64 squares of differences below 2^28 stay below 2^62.
LARGEST = 1 << 27
LEAF = 4
#: Vectors that search the tree together; each has its own frontier.
BATCH = 4096
_MARGIN = 1e-11


class VantageTree:
    """A vantage-point tree over integer points, as lists: inner nodes (point, two children with their distance ranges), leaves (points)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.vantage: list[int] = []
        self.members: list[np.ndarray | None] = []
        self.children: list[list[tuple[int, float, float]]] = []
        if len(points):
            self._grow(np.arange(len(points)))

    def _grow(self, ids: np.ndarray) -> int:
        at = len(self.vantage)
        self.vantage.append(-1)
        self.members.append(None)
        self.children.append([])
        if len(ids) <= LEAF:
            self.members[at] = ids
            return at
        # the point whose distances to the others spread most makes the tightest shells
        apart = np.sqrt(((self.points[ids][:, None, :] - self.points[ids][None, :, :]) ** 2).sum(2).astype(np.float64))
        v = int(apart.var(1).argmax())
        rest, d = np.delete(ids, v), np.delete(apart[v], v)
        self.vantage[at] = int(ids[v])
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        for part in (order[:half], order[half:]):
            self.children[at].append((self._grow(rest[part]), float(d[part].min()), float(d[part].max())))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest point for each row of ``x``, and how many distances were computed."""
        n = len(x)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.points))
        bound = np.full((n, len(self.vantage)), np.inf)
        bound[:, 0] = 0
        live, looked = np.arange(n), 0
        while len(live):
            node = bound[live].argmin(1)
            low = bound[live, node]
            # inclusive: a bound equal to the best distance is still opened
            going = low <= np.sqrt(best[live].astype(np.float64)) * (1 + _MARGIN)
            live, node, low = live[going], node[going], low[going]
            for k in np.unique(node):
                rows, under = live[node == k], low[node == k]
                bound[rows, k] = np.inf
                leaf = self.members[k]
                for c in leaf if leaf is not None else [self.vantage[k]]:
                    d = ((x[rows] - self.points[c]) ** 2).sum(1)
                    looked += len(rows)
                    better = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
                    best[rows[better]], who[rows[better]] = d[better], c
                for child, lo, hi in self.children[k]:  # the vantage point's distances are in d
                    far = np.sqrt(d.astype(np.float64))
                    bound[rows, child] = np.maximum(under, np.maximum(far - hi, lo - far) - _MARGIN * (far + hi))
        return who, best, looked


def quantised(vectors: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, v (64 integers) and fits, for every kept vector."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    good = (F.size("embedding") == DIMS) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(*keep, e.alias("e"))
    fits = ~F.exists("e", lambda x: F.abs(x * 256) >= LARGEST)
    return rows.select(*keep, fits.alias("fits"), F.when(fits, F.transform("e", lambda x: F.floor(x * 256).cast("long"))).alias("v"))


def start(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash, in its order."""
    by = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    got = rows.where("fits").select(by.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in got], np.int64).reshape(len(got), DIMS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), DIMS)


def _pieces(batches, at: int):
    for b in batches:
        for i in range(0, b.num_rows, BATCH):
            piece = b.slice(i, BATCH)
            yield piece, _matrix(piece.column(at))


def move(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. Tasks add up their own vectors; k x 64 sums reach the driver."""
    tree = rows.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def run(batches):
        k = len(tree.value.points)
        sums, count = np.zeros((k, DIMS), np.int64), np.zeros(k, np.int64)
        for _, x in _pieces(batches, 0):
            who = tree.value.nearest(x)[0]
            np.add.at(sums, who, x)
            count += np.bincount(who, minlength=k)
        c = np.flatnonzero(count)
        if len(c):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(c, DIMS), pa.int32()), pa.array(np.tile(np.arange(DIMS), len(c)), pa.int32()), pa.array(sums[c].ravel()), pa.array(np.repeat(count[c], DIMS))],
                names=["cluster", "dim", "s", "n"],
            )

    parts = rows.where("fits").select("v").mapInArrow(run, "cluster int, dim int, s long, n long")
    got = parts.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(19,0)")).alias("s"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in got:
        out[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    tree.unpersist()
    return out


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows that fit, without v, with cluster and distance."""
    tree = rows.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    rows = rows.where("fits").drop("fits")
    rows = rows.select(*[c for c in rows.columns if c != "v"], "v")
    at = len(rows.columns) - 1
    names = [*rows.columns[:-1], "cluster", "distance"]

    def run(batches):
        for piece, x in _pieces(batches, at):
            who, best, _ = tree.value.nearest(x)
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(who, pa.int32()), pa.array(best, pa.int64())], names=names)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}cluster int, distance long")


def centroid_sha256(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark: SparkSession = vectors.sparkSession
    rows = write_table(quantised(vectors, "vec_id"), "vectors")
    centroids = start(rows, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = move(rows, centroids)
    found = write_table(assign(rows, centroids), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    total = sum((r["s"] for r in sums), Decimal(0))
    stats = [(r["cluster"], int(r["s"]), int(total), centroid_sha256(centroids[r["cluster"]])) for r in sums]
    stats = spark.createDataFrame(stats, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(stats), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields[1:]]
    aside = write_table(rows.where("NOT fits").select("vec_id", *none), "aside")
    drop_table(rows)
    return out.unionByName(aside)
