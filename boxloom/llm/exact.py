"""Exact dedup with a persistent digest index, bucketed and sorted by hash. DataFrame operations only.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space (no trimming). A null text
counts as empty, so all empty texts are copies of each other. Of equal texts in one batch the row with the smallest
doc_id stays; a null doc_id sorts last. Rows that repeat a doc_id count as rows of their own: all rows of the
smallest doc_id stay. An empty table gives an empty result. Other columns are left alone, whatever their names.

A corpus goes through its index in batches by doc_id: what a batch adds is found by a sort-merge anti-join with the index,
and every row is then judged by the entry that its digest has there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.common import HOT_KEYS, WS_RUN, new_path, partitions, salted, write_table


def digest(text) -> F.Column:
    """sha256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WS_RUN, " ").cast("binary"), 256))


class DigestIndex:
    """A Parquet table (digest, keep_id) of every text seen so far, in buckets of the digest, sorted within.

    ``path`` is a folder that all machines share; opening the same folder again continues the index. The number of buckets is kept with the
    index, in a file that table readers pass over: it holds for every later session, whatever its settings. Asking for another number is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._layout(buckets)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _layout(self, buckets: int | None) -> int:
        """The number of buckets in the index's folder; for a new one it is written down first."""
        hadoop = self.spark._jvm.org.apache.hadoop
        at = hadoop.fs.Path(f"{self.path}/_buckets")
        store = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if store.exists(at):
            f = store.open(at)
            kept = f.readInt()
            f.close()
            if buckets not in (None, kept):
                raise ValueError(f"the index at {self.path} has {kept} buckets, not {buckets}")
            return kept
        if store.exists(at.getParent()) and any(not f.getPath().getName().startswith(("_", ".")) for f in store.listStatus(at.getParent())):
            raise ValueError(f"the folder {self.path} has files but no layout of an index")
        buckets = buckets or max(8, partitions(self.spark))
        f = store.create(at, False)
        f.writeInt(buckets)
        f.close()
        return buckets

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, found: DataFrame) -> DataFrame:
        """``found``: one row (digest, keep_id) per digest. Appends those that are not in the index; returns them."""
        new = write_table(found.join(self.table().hint("merge"), "digest", "left_anti"), "new")
        (
            new.repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        return new

    def compact(self) -> "DigestIndex":
        """The same index in one file per bucket, in a new folder next to the old."""
        out = DigestIndex(self.spark, f"{self.path}-{uuid.uuid4().hex[:8]}", self.buckets)
        out.append(self.table())
        return out

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dedup_batch(index: DigestIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide one batch against the index and append what is new.

    One row per row of ``docs``: doc_id, keep_id (row that stays, from an earlier batch if there was one),
    group_size (equal rows in this batch), kept, text_sha256.
    """
    rows = write_table(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest")), "digests")
    return _decide(index, rows, rows).drop("digest")


def _decide(index: DigestIndex, batch: DataFrame, rows: DataFrame) -> DataFrame:
    """Append the digests of ``batch`` (doc_id, digest) that are new, and judge ``rows`` by the index."""
    index.append(batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id")))
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
    # texts without a copy are their own group; only the others are looked up by row
    known = groups.join(index.table().hint("merge"), "digest")
    decided = write_table(known.where((F.col("group_size") > 1) | ~F.col("keep_id").eqNullSafe(F.col("first_id"))), "decided")
    # the rows of a large group of copies are dealt over several tasks; at most HOT_KEYS digests are that frequent
    size = max(HOT_ROWS, rows.count() // HOT_KEYS)
    parts = F.when(F.col("group_size") > size, F.ceil(F.col("group_size") / size)).otherwise(1).cast("int")
    hot = decided.where(F.col("group_size") > size).select("digest", parts.alias("parts"))
    decided = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return salted(rows, hot, "digest", "doc_id").join(decided.hint("merge"), ["digest", "salt"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "digest",
    )


#: Rows of one digest from which they are dealt over several tasks.
HOT_ROWS = 200
#: Batches in which a corpus is dealt to the index, in the order of doc_id.
BATCHES = 3


def _through_index(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """All rows judged after their batches went through a new index: the smallest ids come first, so a text's first
    batch holds its smallest id, and the anti-join keeps later batches from entering it again."""
    spark = docs.sparkSession
    rows = write_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    cuts = sorted(set(rows.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)))  # null ids come last
    index = DigestIndex(spark, new_path(spark, "index"))
    bounds = [None, *cuts, None]
    out = None
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part = rows if lo is None else rows.where((F.col("doc_id") > lo) | F.col("doc_id").isNull())
        part = part if hi is None else part.where(F.col("doc_id") <= hi)
        if hi is None:
            out = _decide(index, part, rows)
        else:
            index.append(part.groupBy("digest").agg(F.min("doc_id").alias("keep_id")))
    index.close()
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The whole corpus through a new index in the shared folder, in ``BATCHES`` batches."""
    return _through_index(docs).drop("digest")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``. A row goes by its own text: the verdict is that of
    (doc_id, digest), so repeated and null ids lose no other text."""
    gone = _through_index(docs).where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_digest")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (digest(docs["text"]) == gone["_digest"])
    return docs.join(gone.hint("merge"), same, "left_anti")
