"""Helpers shared by the corpus operators: word expressions, linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.arrow import groups as runs  # noqa: F401
from wayfinder.functions.scratch import Scratch
from wayfinder.functions.text import let  # noqa: F401

#: Separators of words: space and code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Edges (16 bytes each) that one task may hold at once; beyond, components are found in rounds of joins.
TASK_EDGES = 1 << 20


def _least_labels(batches):
    """Components of all edges of a partition, whose number is known to be bounded."""
    import numpy as np
    import pyarrow as pa

    parts = [np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in batches if x.num_rows]
    if not parts:
        return
    names, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    low = np.arange(len(names))
    while True:
        old = low
        low = low.copy()
        both = np.minimum(low[a], low[b])
        # hook the roots of both ends onto the lesser of them, then shorten all ways by half
        np.minimum.at(low, low[a], both)
        np.minimum.at(low, low[b], both)
        np.minimum.at(low, a, both)
        np.minimum.at(low, b, both)
        low = low[low]
        if (low == old).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[low])], names=["node", "component"])


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of `edges(a, b)` of longs: rows `(node, component)`, component the smallest node.

    Up to TASK_EDGES edges, counted first, are solved by one task, which their number bounds.
    More alternate large-star and small-star steps (Kiveris et al., 2014) until the edges stop
    changing, which takes a number of rounds logarithmic in the size of a component. Each step
    groups by node with a minimum, combined before the shuffle; no neighbour list is collected,
    so a hub costs one row in each task.
    """
    now = scratch.cut(edges.select("a", "b").where("a <> b"), f"{tag}-edges")
    if now.count() <= TASK_EDGES:
        return scratch.cut(now.coalesce(1).mapInArrow(_least_labels, "node long, component long"), tag)
    now = scratch.cut(now.distinct(), f"{tag}-0")
    k, last = 0, None
    while True:
        k += 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # each larger neighbour of a node goes to the smallest of node and neighbours
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # then the node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        new = scratch.cut(small.where("a <> b").distinct(), f"{tag}-{k}")
        # settled once the edges stay the same
        row = new.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        scratch.drop(f"{tag}-{k - 1}")
        now = new
        if last == tuple(row):
            break
        last = tuple(row)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
