"""Mix sources to target weights by Poisson replication.

Each source s with n_s rows gets the repetition rate  r_s = total * w_s / (W * n_s), W being the sum of the weights of the
sources that occur. Each document draws its number of copies from Poisson(r_s) by inverting the distribution at a uniform
number hashed from (seed, doc_id), so retries and partitioning never change the draw; rates above ``PIECE`` are split
into equal parts, each with a draw of its own. Copies are then dealt out by a hash of (seed, doc_id, copy), the shuffle key, and
sorted by it within each partition: a global shuffle in one exchange, without a sampling pass before it.

Defined results: a null source is a source of its own; sources without a weight take ``default_weight`` (0 drops them);
a null doc_id draws as the text 'null'; rows that repeat a doc_id draw the same count and tie in the shuffle;
an empty table gives an empty result. Columns of the input named copy, n_copies or shuffle_key are replaced by the operator's; all
others pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import partitions

PIECE = 16.0
#: Terms of the inverted distribution: for a mean of 16 the mass beyond 80 is below 1e-25.
TERMS = 80
#: Sources up to which their rates are broadcast; beyond, the join is shuffled.
BROADCAST_SOURCES = 10_000
SEED = 17


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: 13 hex digits, exact as a double."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict, default_weight: float, total: float | None, source_col: str = "source") -> DataFrame:
    """(source, n, rate, pieces, cdf): one row per source; cdf is that of a piece, at 0, 1, 2 ..."""
    n = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    w = F.lit(float(default_weight))
    if weights:
        table = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])
        w = F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit(""))), w)
    n = n.withColumn("w", w)
    whole = n.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    want = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    r = F.when(F.col("all_w") > 0, want * F.col("w") / (F.col("all_w") * F.col("n"))).otherwise(F.lit(0.0))
    out = n.join(F.broadcast(whole)).withColumn("rate", r)  # one row
    out = out.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int"))
    out = out.withColumn("lam", F.col("rate") / F.col("pieces"))
    step = lambda acc, k: F.struct(
        (acc["p"] * F.col("lam") / k).alias("p"),
        (acc["c"] + acc["p"] * F.col("lam") / k).alias("c"),
        F.concat(acc["cdf"], F.array(acc["c"] + acc["p"] * F.col("lam") / k)).alias("cdf"),
    )
    p0 = F.exp(-F.col("lam"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("cdf")), step)
    return out.withColumn("cdf", cdf["cdf"]).select("source", "n", "rate", "pieces", "cdf")


def mix_sources(
    docs: DataFrame,
    weights: dict | None = None,
    default_weight: float = 1.0,
    total: float | None = None,
    seed: int = SEED,
    keep: list[str] | None = None,
    source_col: str = "source",
) -> DataFrame:
    """Replicated and shuffled rows: ``keep`` (all columns of ``docs`` by default), then copy, n_copies, shuffle_key.

    ``total``: rows to expect in all (the number of rows by default).
    """
    table = rates(docs, weights or {}, default_weight, total, source_col)
    few = table.select(F.count(F.lit(1)).alias("k")).collect()[0]["k"]
    own = {c: f"_mix_{c}" for c in ("source", "pieces", "cdf", "key", "draws")}
    table = table.select(*[F.col(c).alias(own[c]) for c in ("source", "pieces", "cdf")])
    table = F.broadcast(table) if few <= BROADCAST_SOURCES else table.hint("merge")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("copy", "n_copies", "shuffle_key")]
    rows = docs.select(*keep, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(own["key"]), F.col(source_col).cast("string").alias("_mix_from"))
    rows = rows.join(table, F.col("_mix_from").eqNullSafe(F.col(own["source"])))
    # each uniform number is hashed once, then held against the terms
    rows = rows.withColumn(own["draws"], F.transform(F.sequence(F.lit(1), F.col(own["pieces"])), lambda i: uniform(F.lit(seed), F.col(own["key"]), i)))
    count = F.aggregate(own["draws"], F.lit(0).cast("long"), lambda acc, u: acc + F.size(F.filter(own["cdf"], lambda c: c <= u)))
    rows = rows.select(*keep, own["key"], count.alias("n_copies")).where("n_copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), own["key"], "copy")))
    out = rows.select(*keep, "copy", "n_copies", "shuffle_key")
    return out.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
