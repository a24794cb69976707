"""Near-duplicate embeddings by collision-counting projections.

Vectors are projected on many random directions. A pair collides in a projection if it differs by
no more than a window centred on the query; pairs whose collisions reach a count calibrated for
recall are verified by their cosine in double precision.

A projection is kept as one byte. In a block of vectors each projection is a sorted list, and its
prefixes are sets of bits: what lies in a query's window is the difference of two prefixes, and
the windows of all projections are added up as bits, 64 pairs to a word.

So that not all pairs meet, several tables cut the space into cells, each by a few of the
projections; pairs are counted inside cells. The number of projections to a table follows the
number of vectors, so that cells stay about CELL vectors large, and the number of tables follows
from the recall wanted at the least similarity. Cells first meet with the bytes of the projections
alone; only vectors of pairs that reach the count follow, to be counted again and verified. A pair
is counted in the first table that joins it.

Equal vectors become one with a multiplicity. Larger cells are dealt out as pairs of blocks of
bounded size; a task sends on link counts and a spanning forest, never the pairs.

Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of
different lengths neither. A null id is a vector like others but has a null component and is kept.
Rows that share an id are one node with the links of all. Vectors of any length are projected
whole. Ties have no order to decide. Empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch
from wayfinder.llm._shared import components, runs
from wayfinder.llm._text import U64, mix

CELL, BLOCK = 1000, 2048
#: Chance of losing a pair of the least similarity to the tables, and to the count.
LOSS_TABLES, LOSS_COUNT = 1e-3, 1e-6
COUNTED, WINDOW, WIDTH = 32, 2.5, 4.0  # directions that count; window and cell in standard deviations of a least pair
MARKS = [f"m{k}" for k in range(COUNTED // 8)]
STEPS, LEVELS = 10, 128  # of a projection's byte: steps to a window, and how many there are
#: Vectors of linked candidates (8 bytes a row) are broadcast up to so many; beyond, both sides are shuffled.
BROADCAST_ROWS = 400_000


def calibrate(n: int, least: float) -> tuple[int, int, int]:
    """Projections to a table, tables, and the count to reach, for `n` vectors."""
    same = 1 - math.sqrt(2 / math.pi) / WIDTH  # a least pair shares a cell of one projection
    apart = WIDTH * math.sqrt(2 * (1 - least)) / math.sqrt(4 * math.pi)  # any two vectors do
    g = max(1, round(math.log(max(n, CELL) / CELL) / -math.log(min(apart, 0.9))))
    tables = math.ceil(math.log(LOSS_TABLES) / math.log(1 - same**g))
    # the rounding of both ends adds a sixth of a squared step to the variance of a difference
    p, c, below = math.erf(WINDOW / math.sqrt(2 * (1 + (WINDOW / (STEPS + 0.5)) ** 2 / 6))), 0, 0.0
    while below + math.comb(COUNTED, c) * p**c * (1 - p) ** (COUNTED - c) < LOSS_COUNT:
        below += math.comb(COUNTED, c) * p**c * (1 - p) ** (COUNTED - c)
        c += 1
    return g, tables, c


class Space:
    """Directions and cells for vectors of one length."""

    def __init__(self, dim: int, g: int, tables: int, least: float):
        rng = np.random.default_rng(20_000 + dim)
        d = rng.standard_normal((dim, COUNTED + g * tables))
        d /= np.linalg.norm(d, axis=0)
        self.counted, self.cutting = np.ascontiguousarray(d[:, :COUNTED]), np.ascontiguousarray(d[:, COUNTED:])
        self.sigma = math.sqrt(2 * (1 - least) / dim)
        self.offset = rng.random(g * tables)
        self.g, self.tables, self.dim = g, tables, dim

    def keys(self, v: np.ndarray, tables: int | None = None) -> np.ndarray:
        """The cell of each vector (row) in each of the first tables."""
        tables = self.tables if tables is None else tables
        at = np.floor(v @ self.cutting[:, : self.g * tables] / (WIDTH * self.sigma) + self.offset[: self.g * tables])
        at = at.astype(np.int64).view(U64).reshape(len(v), tables, self.g)
        out = np.broadcast_to(np.arange(tables, dtype=U64) * U64(1_000_003) + U64(self.dim), (len(v), tables))
        for k in range(self.g):
            out = mix(out * U64(0x9E3779B97F4A7C15) + at[:, :, k])
        return out

    def marks(self, v: np.ndarray) -> np.ndarray:
        """The projections that count, a byte each; values beyond the levels are at the outermost, which only adds collisions."""
        steps = np.rint(v @ self.counted * ((STEPS + 0.5) / (WINDOW * self.sigma))) + LEVELS // 2
        return np.clip(steps, 0, LEVELS - 1).astype(np.uint8)


_LEVEL = np.arange(LEVELS)
_LOW, _HIGH = np.maximum(_LEVEL - STEPS, 0), np.minimum(_LEVEL + STEPS + 1, LEVELS)
_PROJECTION = np.arange(COUNTED)[:, None]


def _windows(marks: np.ndarray) -> np.ndarray:
    """For each projection and level the bits of the rows in the window around it."""
    n = len(marks)
    row = np.full((COUNTED, 1, -(-n // 64) * 64), 255, np.uint8)
    row[:, 0, :n] = marks.T
    prefix = np.packbits(row < np.arange(LEVELS + 1, dtype=np.uint8)[:, None], axis=2, bitorder="little").view(U64)  # of the sorted lists
    return prefix[:, _HIGH] ^ prefix[:, _LOW]


def _reached(windows: np.ndarray, marks: np.ndarray, count: int) -> np.ndarray:
    """A row of bits for each query (row of marks): the rows with at least `count` collisions, by vertical counters."""
    planes: list[list[np.ndarray]] = [list(windows[_PROJECTION, marks.T]), *([] for _ in range(COUNTED.bit_length() - 1))]
    zero = np.zeros_like(planes[0][0])
    for j, p in enumerate(planes):
        while len(p) > 1:  # a full adder turns three bits of a plane into one, and one of the next plane
            a, b = p.pop(), p.pop()
            c = p.pop() if p else None
            x, carry = a ^ b, a & b
            if c is not None:
                carry |= x & c
                x ^= c
            p.insert(0, x)
            if j + 1 < len(planes):
                planes[j + 1].append(carry)
    more, same = zero, ~zero
    for j in range(len(planes) - 1, -1, -1):
        bit = planes[j][0] if planes[j] else zero
        if count >> j & 1:
            same = same & bit
        else:
            more = more | (same & bit)
            same = same & ~bit
    return more | same


def candidates(marks: np.ndarray, ask: np.ndarray, count: int, tile: int = 128):
    """(queries, rows) that reach the count, `ask` being the rows that are queries, a bounded tile at a time."""
    windows = _windows(marks)
    for lo in range(0, len(ask), tile):
        q = ask[lo : lo + tile]
        bits = _reached(windows, marks[q], count)
        some = np.flatnonzero(bits.any(axis=1))
        if len(some):
            hit = np.unpackbits(bits[some].view(np.uint8), axis=1, bitorder="little")[:, : len(marks)]
            x, y = np.nonzero(hit)
            yield q[some][x], y


def unit(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows of a list column are usable, and groups of row numbers by length with their unit vectors in double."""
    lengths = np.array([-1 if x is None else x for x in vectors.value_lengths().to_pylist()], np.int64) if len(vectors) else np.zeros(0, np.int64)
    out, usable = [], np.zeros(len(vectors), bool)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan"))
        v = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
        big = np.abs(v).max(axis=1)
        ok = np.isfinite(big) & (big > 0) & np.isfinite(v).all(axis=1)
        v = v[ok] / big[ok, None]
        usable[rows[ok]] = True
        out.append((rows[ok], v / np.linalg.norm(v, axis=1)[:, None]))
    return usable, out


def _named(batches):
    schema = pa.schema([("vec_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
    for batch in batches:
        h = np.zeros((2, batch.num_rows), U64)
        usable, groups = unit(batch.column(1))
        for rows, v in groups:
            bits = (v + 0.0).view(U64)
            for k in range(2):
                key = np.full(len(rows), U64(v.shape[1] + 1000 * k))
                for x in bits.T:
                    key = mix(key * U64(0x9E3779B97F4A7C15) + x)
                h[k, rows] = key
        null = ~usable
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64), mask=null) for x in h)], schema=schema)


def _celled(g: int, tables: int, least: float):
    """A row for each vector and table: its cell, and the bytes of its projections as longs."""
    schema = pa.schema([("node", pa.int64()), ("h", pa.int64()), ("tab", pa.int32()), ("cell", pa.int64()), *((m, pa.int64()) for m in MARKS)])

    def run(batches):
        spaces: dict[int, Space] = {}
        for batch in batches:
            for rows, v in unit(batch.column("embedding"))[1]:
                space = spaces.setdefault(v.shape[1], Space(v.shape[1], g, tables, least))
                node, h = (batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("node", "h"))
                for lo in range(0, len(v), 4096):
                    part = v[lo : lo + 4096]
                    keys = space.keys(part).view(np.int64)
                    marks = np.repeat(np.ascontiguousarray(space.marks(part)).view(np.int64), tables, axis=0)
                    tab = np.tile(np.arange(tables, dtype=np.int32), len(part))
                    own = (np.repeat(x[lo : lo + 4096], tables) for x in (node, h))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(tab), pa.array(keys.reshape(-1)), *(pa.array(np.ascontiguousarray(marks[:, i])) for i in range(len(MARKS)))], schema=schema)

    return run


def _groups(batches, columns: tuple[str, ...]):
    """Columns of the runs of equal (cell, i, j) in a partition sorted by them."""
    for key, t in runs(batches, ("cell", "i", "j")):
        if t.num_rows > 1:
            yield key, t.num_rows, [t.column(c).combine_chunks() for c in columns]


def _asking(side: np.ndarray) -> np.ndarray:
    """The rows that are queries: all of one block, or of two blocks the smaller one's."""
    first = side == side[0]
    if first.all():
        return np.arange(len(side))
    return np.flatnonzero(first if first.sum() <= len(side) - first.sum() else ~first)


def _meeting(count: int):
    """Of each cell (or two blocks of it) the rows that are in a pair which reaches the count."""
    names = ("node", "h", "tab", "side", *MARKS)

    def run(batches):
        for (cell, i, j), n, columns in _groups(batches, names):
            node, h, tab, side, *marks = (c.to_numpy() for c in columns)
            marks = np.stack(marks, axis=1).view(np.uint8)
            hit = np.zeros(n, bool)
            across = side[0] != side[-1] or (side != side[0]).any()
            for x, y in candidates(marks, _asking(side), count):
                keep = side[x] != side[y] if across else x < y
                hit[x[keep]] = hit[y[keep]] = True
            if hit.any():
                k = np.flatnonzero(hit)
                fixed = [pa.array(np.full(len(k), z, np.int64)) for z in (cell, i, j)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(tab[k]), pa.array(side[k]), pa.array(node[k]), pa.array(h[k])], names=["cell", "i", "j", "tab", "side", "node", "h"])

    return run, "cell long, i long, j long, tab int, side long, node long, h long"


def _near(v: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs have the least cosine, some thousand at a time."""
    return np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", v[x[k : k + 8192]], v[y[k : k + 8192]]) >= least for k in range(0, len(x), 8192))])


def _verified(g: int, tables: int, least: float, count: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def solve(spaces, columns):
        node, times, tab, side = (c.to_numpy() for c in columns[:4])
        rows, v = unit(columns[4])[1][0]
        node, times, side, table = node[rows], times[rows], side[rows], int(tab[0])
        space = spaces.setdefault(v.shape[1], Space(v.shape[1], g, tables, least))
        across = (side != side[0]).any()
        links, low, keys = np.zeros(len(v), np.int64), np.arange(len(v)), None
        for x, y in candidates(space.marks(v), _asking(side), count):
            keep = side[x] != side[y] if across else x < y
            x, y = x[keep], y[keep]
            near = _near(v, x, y, least)
            x, y = x[near], y[near]
            if table and len(x):  # a pair that an earlier table joins is counted there
                keys = space.keys(v, table) if keys is None else keys
                new = np.concatenate([~(keys[x[k : k + 8192]] == keys[y[k : k + 8192]]).any(axis=1) for k in range(0, len(x), 8192)])
                x, y = x[new], y[new]
            np.add.at(links, x, times[y])
            np.add.at(links, y, times[x])
            while len(x):
                both = np.minimum(low[x], low[y])
                np.minimum.at(low, low[x], both)
                np.minimum.at(low, low[y], both)
                while (low[low] != low).any():
                    low = low[low]
                left = low[x] != low[y]
                x, y = x[left], y[left]
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[low[some]]), pa.array(links[some])], schema=schema) if len(some) else None

    def run(batches):
        # rows come sorted by cell and blocks, which hold at most two blocks of vectors
        spaces: dict[int, Space] = {}
        for _, _, columns in _groups(batches, ("node", "times", "tab", "side", "embedding")):
            if (found := solve(spaces, columns)) is not None:
                yield found

    return run, "a long, b long, links long"


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """Rows `(vec_id, n_links, component_id, kept)`, one for each row of `vectors`; the id is a long."""
    scratch = Scratch(vectors.sparkSession, "embedding")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    all_ = scratch.cut(vectors.mapInArrow(_named, "vec_id long, h1 long, h2 long"), "named")
    # one node for each vector there is: its least id, or where no row has one its own name
    one = all_.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"))
    one = scratch.cut(one, "one")
    nodes = scratch.cut(_nodes(vectors, all_, one, kind, scratch), "nodes")
    g, tables, count = calibrate(nodes.count(), least)
    schema = "node long, h long, tab int, cell long, " + ", ".join(f"{m} long" for m in MARKS)
    rows = scratch.cut(nodes.select("node", "h", "embedding").mapInArrow(_celled(g, tables, least), schema), "cells")
    # cells of more than a block are dealt out in pairs of blocks; they are few, since each holds over BLOCK rows
    large = scratch.cut(rows.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("cell", F.ceil(F.col("m") / BLOCK).alias("blocks")), "large")
    rows = rows.join(_few(large), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node", "h", "cell"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = rows.select("cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "tab", "node", "h", *MARKS)
    run, schema = _meeting(count)
    met = scratch.cut(dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, schema), "met")
    scratch.drop("cells")
    run, schema = _verified(g, tables, least, count)
    fetched = met.join(nodes, ["node", "h"]).select("cell", "i", "j", "side", "tab", "node", "times", "embedding")
    found = scratch.cut(fetched.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, schema), "found")
    return _linked(all_, one, found, scratch)


def _nodes(vectors: DataFrame, all_: DataFrame, one: DataFrame, kind: str, scratch: Scratch) -> DataFrame:
    """`(node, h, times, embedding)`: a row of each vector there is, by its node and a hash of its name."""
    schema = f"vec_id long, h1 long, h2 long, embedding {kind}"
    # rows that only repeat a vector of another id are few or many; their ids, not their vectors, are compared
    again = all_.join(one.select("h1", "h2", "id"), ["h1", "h2"]).where("vec_id <> id").select("vec_id")
    plain = all_.where("h1 is not null").groupBy("vec_id").agg(F.count("*").alias("n"))
    twice = plain.where("n > 1 or vec_id is null").select("vec_id")
    if twice.isEmpty():
        once = vectors.join(_few(scratch.cut(again, "again")), "vec_id", "left_anti").mapInArrow(_with_names(kind), schema).where("h1 is not null")
    else:  # rows that share an id, or have none, are told apart by their names
        once = vectors.mapInArrow(_with_names(kind), schema).where("h1 is not null").dropDuplicates(["h1", "h2"]).drop("vec_id")
        once = once.join(one.select("h1", "h2", F.col("id").alias("vec_id")), ["h1", "h2"])
    many = _few(one.where("times > 1").select("h1", "h2", "times"))
    once = once.join(many, ["h1", "h2"], "left")
    return once.select(F.coalesce("vec_id", "h1").alias("node"), F.xxhash64("h1", "h2").alias("h"), F.coalesce("times", F.lit(1).cast("long")).alias("times"), "embedding")


def _linked(all_: DataFrame, one: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    same = all_.where("h1 is not null and vec_id is not null").join(one.select("h1", "h2", F.coalesce("id", "h1").alias("node"), "times"), ["h1", "h2"]).select("vec_id", "node", "times")
    edges = found.select("a", "b").union(same.select(F.col("vec_id").alias("a"), F.col("node").alias("b")).where("a <> b"))
    inside = components(scratch, edges, "final").withColumnRenamed("node", "vec_id")
    if not one.where("id is null").isEmpty():  # vectors without an id join others, but give no component its name
        names = inside.join(same.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("component").agg(F.min("vec_id").alias("name"))
        inside = inside.join(names, "component").select("vec_id", F.col("name").alias("component"))
    own = same.groupBy("vec_id", "node").agg(F.max("times").alias("times")).join(links.withColumnRenamed("a", "node"), "node", "left")
    own = own.groupBy("vec_id").agg(F.sum(F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = all_.select("vec_id").join(own, "vec_id", "left").join(inside, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _with_names(kind: str):
    item = pa.float32() if kind == "array<float>" else pa.float64()

    def run(batches):
        for batch in batches:
            for named in _named([batch]):
                yield pa.RecordBatch.from_arrays([*named.columns, batch.column(1).cast(pa.list_(item))], names=["vec_id", "h1", "h2", "embedding"])

    return run
