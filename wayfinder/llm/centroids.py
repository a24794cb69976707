"""Centroid clustering of whole-number vectors by annulus search.

Centroids are sorted by norm. A vector at distance u from any centroid can only be nearer to one
whose norm differs from its own by at most u, so its candidates are one run of that order, found by
binary search and compared exactly, ties at the border included. The bound u is the least distance
to the centroid of the nearest norm and to every eighth of the order.

Rounds are narrow: each task adds up its own vectors, and a row for each cluster and task is
shuffled. The driver holds the centroids alone, whose number is a parameter.

Vectors are kept if they have `width` components, none null, not finite or of 2 ** 1000 and more;
the rest, null vectors among them, has no row. All arithmetic is exact: components up to SMALL are
computed as doubles that stay below 2 ** 53, larger ones as Python's integers. A distance or inertia
beyond 64 bits is null. A null id is hashed as the empty text and kept; rows that repeat are vectors
of their own; of vectors with equal hashes the lesser by components comes first. Fewer vectors than
centroids make fewer centroids, an empty table gives no rows, other columns are never read.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch

#: Largest component for sums of products in doubles: 64 * 4 * SMALL ** 2 < 2 ** 53.
SMALL = 1 << 22
#: Every so many centroids of the sorted order are measured for the bound.
PROBE = 8
LONG = (1 << 63) - 1


def whole(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: float) -> DataFrame:
    """`(id, v)`: floor(scale * x) of every component, as whole doubles, of the vectors that are kept."""
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            fit = pc.fill_null(pc.equal(pc.list_value_length(v), width), False)
            batch = batch.filter(fit)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            with np.errstate(invalid="ignore"):
                good = (np.abs(x) < 2.0**1000).all(axis=1)
            x = np.floor(x[good] * scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), lists], names=["id", "v"])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, v array<double>")


class Centres:
    """Centroids of whole numbers, sorted by norm."""

    def __init__(self, rows: list[tuple[int, ...]]):
        square = [sum(c * c for c in r) for r in rows]
        order = sorted(range(len(rows)), key=lambda k: (square[k], k))
        self.number = np.array(order, np.int64)
        self.rows = [rows[k] for k in order]
        self.square = [square[k] for k in order]
        # those that doubles can hold are a prefix of the order
        self.small = next((k for k, r in enumerate(self.rows) if max(map(abs, r)) > SMALL), len(rows))
        self.x = np.array(self.rows[: self.small], np.float64).reshape(self.small, len(rows[0]))
        self.squares = np.array(self.square[: self.small], np.float64)
        self.norm = np.array([float(q) ** 0.5 if q < 1 << 53 else float(isqrt(q)) for q in self.square])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """For each row of whole doubles, the number of the nearest centroid (the smaller of equals) and the squared distance."""
        best, number = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        plain = np.flatnonzero((np.abs(x) <= SMALL).all(axis=1)) if self.small else np.zeros(0, np.int64)
        y = x[plain]
        own = (y * y).sum(axis=1)
        norm = np.sqrt(own)
        bound = np.full(len(y), np.inf)
        if self.small:
            at = np.minimum(np.searchsorted(self.norm[: self.small], norm), self.small - 1)
            bound = own + self.squares[at] - 2 * (y * self.x[at]).sum(axis=1)
            for k in range(0, self.small, PROBE):
                bound = np.minimum(bound, own + self.squares[k] - 2 * (y @ self.x[k]))
        reach = np.sqrt(bound) * (1 + 1e-12) + 1e-6 * (1 + norm * 1e-9)
        low = np.searchsorted(self.norm, norm - reach)
        high = np.searchsorted(self.norm, norm + reach, "right")
        large = high > self.small
        low[large] = high[large]
        least, which = np.full(len(y), np.inf), np.zeros(len(y), np.int64)
        for k in range(low.min(initial=self.small), min(self.small, high.max(initial=0))):
            rows = np.flatnonzero((low <= k) & (k < high))
            d = own[rows] + self.squares[k] - 2 * (y[rows] @ self.x[k])
            name = self.number[k]
            less = (d < least[rows]) | ((d == least[rows]) & (name < which[rows]))
            least[rows[less]], which[rows[less]] = d[less], name
        best[plain], number[plain] = least, which
        distance = [int(d) if d < np.inf else -1 for d in best.tolist()]
        rest = np.ones(len(x), bool)
        rest[plain[~large]] = False
        for i in np.flatnonzero(rest).tolist():
            number[i], distance[i] = self.exactly([int(c) for c in x[i].tolist()])
        return number, distance

    def exactly(self, row: list[int]) -> tuple[int, int]:
        """The same for one row of integers of any size."""
        far = lambda k: sum((a - b) ** 2 for a, b in zip(row, self.rows[k], strict=True))
        norm = isqrt(sum(a * a for a in row))
        reach = isqrt(min(far(k) for k in range(0, len(self.rows), PROBE))) + 2
        near = [k for k, q in enumerate(self.square) if abs(isqrt(q) - norm) <= reach]
        d, number = min((far(k), int(self.number[k])) for k in near)
        return number, d


def _limbs(total: int) -> list[int]:
    """A whole number as parts of 32 bits, the last one signed."""
    out = []
    while not -(1 << 31) <= total < 1 << 31:
        out.append(total & 0xFFFFFFFF)
        total >>= 32
    return [*out, total]


def _sums(kept: DataFrame, centres: Centres, width: int) -> dict[int, tuple[int, list[int]]]:
    """For each cluster, its number of vectors and the exact sums of their components."""
    held = kept.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        now = held.value
        count, total = {}, {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            number, _ = now.nearest(x)
            plain = (np.abs(x) <= SMALL).all(axis=1)
            for k in np.unique(number).tolist():
                mine = number == k
                count[k] = count.get(k, 0) + int(mine.sum())
                add = [int(s) for s in x[mine & plain].sum(axis=0).tolist()]
                for row in x[mine & ~plain].tolist():
                    add = [a + int(b) for a, b in zip(add, row, strict=True)]
                total[k] = [a + b for a, b in zip(total.get(k, [0] * width), add, strict=True)]
        rows = []
        for k, sums in total.items():
            parts = [_limbs(s) for s in sums]
            for i in range(max(map(len, parts))):
                rows.append({"cluster": k, "limb": i, "n": 0 if i else count[k], "s": [p[i] if i < len(p) else 0 for p in parts]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cluster", pa.int64()), ("limb", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    parts = kept.select("v").mapInArrow(run, "cluster long, limb long, n long, s array<long>")
    parts = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.collect():  # a few rows for each centroid
        n, sums = found.get(r["cluster"], (0, [0] * width))
        found[r["cluster"]] = n + r["n"], [a + (b << 32 * r["limb"]) for a, b in zip(sums, r["s"], strict=True)]
    return found


def _assign(kept: DataFrame, centres: Centres, width: int) -> DataFrame:
    held = kept.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            number, distance = held.value.nearest(batch.column(1).flatten().to_numpy().reshape(-1, width))
            columns = [batch.column(0), pa.array(number, pa.int32()), pa.array([d if d <= LONG else None for d in distance], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, scale: float = 256.0) -> DataFrame:
    """A row for each kept vector: its id, `cluster`, `distance`, `cluster_inertia`, `inertia`, `centroid_sha256`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    kept = scratch.cut(whole(vectors, id_col, vector_col, width, scale), "whole")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    rows = [tuple(int(c) for c in r["v"]) for r in first]
    if rows:
        for _ in range(rounds):
            for at, (n, sums) in _sums(kept, Centres(rows), width).items():
                rows[at] = tuple(s // n for s in sums)
        found = scratch.cut(_assign(kept, Centres(rows), width), "assigned")
        scratch.drop("whole")
    else:
        found = kept.select("id", F.lit(0).alias("cluster"), F.lit(None).cast("long").alias("distance")).limit(0)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    fit = lambda total, lost: int(total) if not lost and total <= LONG else None
    inertia = fit(sum(r["d"] or 0 for r in sums), sum(r["lost"] for r in sums))
    digest = lambda row: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()
    table = [(r["cluster"], fit(r["d"] or 0, r["lost"]), inertia, digest(rows[r["cluster"]])) for r in sums]
    table = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return found.withColumnRenamed("id", id_col).join(F.broadcast(table), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
