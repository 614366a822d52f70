"""Connected components of a table of links, by hooking to the least neighbour and contracting; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import drop_table, hot_keys, over_salts, salted, write_table


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b). Returns (id, component): for each id in a link, the least id that it is connected with.

    Each round every vertex points to its least neighbour (or itself), pointers are followed to their ends, and the links
    between the ends are the next round's. A round at least halves the vertices that still have links, so there are
    about log2 rounds of the longest chain's length. A link may stand there several times: the least neighbour is the same.
    """
    edges = write_table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # every vertex with a smaller neighbour points to the least one; the others are their trees' roots
        up = write_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).select(F.col("a").alias("id"), "p"), "pointers")
        while True:
            jump = up.select(F.col("id").alias("p"), F.col("p").alias("q"))
            nxt = write_table(up.join(jump, "p").select("id", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "pointers")
            drop_table(up)
            up = nxt.select("id", "p")
            if nxt.where("moved").isEmpty():
                break
        ends = up.select(F.col("id").alias("_id"), F.col("p").alias("_p"))
        if labels is None:
            new = up.select("id", F.col("p").alias("component"))
        else:
            new = labels.join(ends, labels["component"] == ends["_id"], "left").select("id", F.coalesce("_p", "component").alias("component"))
        labels = write_table(new, "labels", [] if labels is None else [labels])
        e = edges.join(ends, F.col("a") == F.col("_id")).select(F.col("_p").alias("a"), "b").join(ends, F.col("b") == F.col("_id")).select("a", F.col("_p").alias("b"))
        edges = write_table(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges", [edges, up])
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


#: Members of a component from which it is relabelled by several tasks.
HOT_MEMBERS = 2_000


def extend(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after ``links`` (a, b) between components, an id without a label being its own.

    Only the components that a link names are worked on anew. Both tables come from ``write_table``; their files are deleted.
    """
    if links.isEmpty():
        drop_table(links)
        return labels
    new = components(links)
    hot = hot_keys(labels, "component", HOT_MEMBERS)
    to = over_salts(new.select(F.col("id").alias("component"), F.col("component").alias("_to")), hot, "component")
    moved = salted(labels, hot, "component", "id").join(to.hint("merge"), ["component", "salt"], "left").select("id", F.coalesce("_to", "component").alias("component"))
    first = new.join(labels.select("id"), "id", "left_anti").select("id", "component")
    return write_table(moved.unionByName(first), "labels", [labels, links, new])
