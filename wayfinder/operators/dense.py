"""Exact inner-product search over vectors, and the fingerprint that keys a stored index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions.arrow import groups

#: Rows of a block of queries, and of a block of vectors.
QUERIES, VECTORS = 1024, 8192


def _top(k: int, digits: int):
    """Of each pair of blocks the best `k` vectors for each query, by one matrix product."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def matrix(t: pa.Table) -> np.ndarray:
        v = t.column("v").combine_chunks()
        return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))

    def run(batches):
        for _, t in groups(batches, ("scope", "qb", "vb")):
            asks = t.column("asks").to_numpy(zero_copy_only=False)
            q, v = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
            ids, own = v.column("id").to_numpy(), q.column("id").to_numpy()
            left, right = matrix(q), matrix(v)
            for lo in range(0, len(own) if len(ids) else 0, 256):
                score = np.round(np.maximum(left[lo : lo + 256] @ right.T, 0.0), digits)
                score[own[lo : lo + 256, None] == ids[None]] = -1.0
                n = min(k, len(ids))
                least = -np.partition(-score, n - 1, axis=1)[:, n - 1]
                for i, at in enumerate(least):
                    best = np.flatnonzero((score[i] >= at) & (score[i] >= 0))
                    best = best[np.lexsort((ids[best], -score[i, best]))[:n]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), own[lo + i])), pa.array(ids[best]), pa.array(score[i, best])], schema=schema)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int, scope: str | None = None, digits: int = 6) -> DataFrame:
    """The `k` nearest of `vectors(vec_id, embedding)` for each of `queries(query_id, q)`: `(query_id, vec_id, score, rank)`.

    `scope` names a column of both sides that must agree. Scores below 0 count as 0. Blocks of
    queries meet blocks of vectors, each pair of blocks in one task as a matrix product that keeps
    the best of each query, so that no pair of rows is ever a row. All vectors have one length; ids are longs.
    """
    own = F.xxhash64(scope) if scope else F.lit(0).cast("long")
    v = vectors.select(own.alias("scope"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"), F.lit(False).alias("asks"))
    q = queries.select(own.alias("scope"), F.col("query_id").cast("long").alias("id"), F.col("q").alias("v"), F.lit(True).alias("asks"))
    count = lambda rows, size, name: rows.groupBy("scope").agg(F.ceil(F.count("*") / size).cast("long").alias(name))
    blocks = count(q, QUERIES, "qs").join(count(v, VECTORS, "vs"), "scope")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = q.join(blocks, "scope").withColumn("qb", at("qs")).withColumn("vb", all_("vs")).unionByName(v.join(blocks, "scope").withColumn("vb", at("vs")).withColumn("qb", all_("qs")))
    met = rows.drop("qs", "vs").repartition("scope", "qb", "vb").sortWithinPartitions("scope", "qb", "vb")
    found = met.mapInArrow(_top(k, digits), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def fingerprint(rows: DataFrame, key: str, body: str, model: str) -> DataFrame:
    """One row: 16 hex digits over the model and all ids and texts, in the order of ids.

    Rows are hashed one by one and summed, so that no text leaves its task.
    """
    one = F.conv(F.substring(F.sha2(F.concat(F.col(key).cast("string"), F.lit("\x1f"), F.col(body), F.lit("\x1e")), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    total = rows.agg(F.count("*").alias("n"), F.sum(one).alias("h"))
    return total.select(F.substring(F.sha2(F.concat_ws("|", F.lit(model), F.col("n").cast("string"), F.col("h").cast("string")), 256), 1, 16).alias("fingerprint"))
