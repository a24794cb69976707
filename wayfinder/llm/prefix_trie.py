"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns. The smallest conversation that starts with it owns
it; members of a deeper node are members of the one above, so what a conversation owns is a suffix
of its path. Hence sums over subtrees need no walk: a node's subtree is the sum, over its members,
of what each occurs with at this depth and below, less what is owned there. One group-by of all
paths' rows by node adds up members, occurring less owned tokens, leaves and children at once.

A conversation may hold any share of all turns. Turns are dealt out by ranges of (conversation,
turn), and running numbers and sums are taken within a range and carried over range borders, where
at most one conversation goes on. A node is named by its depth and by two sums, over its turns, of
independent 63-bit hashes of (place, SHA-256 of role and text): 126 bits that only SHA-256 values
enter, so that names of unlike sequences meet with a chance of pairs / 2 ** 126.

Turns are ordered by number, nulls first, equal ones by SHA-256. A null role or text is the empty
one. Rows without conv_id make no conversation. Texts of any length are read once, to be hashed and
counted. Rows that repeat are turns of their own. An empty table has no node; other columns are
never read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch

#: Turns a range holds, about.
RANGE_ROWS = 50_000
#: Bytes of joined ids that are handed on at once.
PIECE = 1 << 16
NODE = ["depth", "p1", "p2"]


def ranges(df: DataFrame, order: list[Column], rows: int, scratch: Scratch, tag: str) -> DataFrame:
    """`df` as a table sorted by `order`, with `part`, its place among ranges of about RANGE_ROWS rows."""
    n = max(1, -(-rows // RANGE_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return scratch.cut(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), tag)


def running(df: DataFrame, key: str, order: list[Column], values: dict[str, Column], scratch: Scratch, tag: str) -> DataFrame:
    """`df`, in ranges, with running sums of `values` over the rows of each `key`, each row's own value included.

    A range's sums are carried into the next ones by a table of a row for each range and key that
    it shares with a neighbour.
    """
    within = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(key, "part").agg(*(F.sum(v).alias(f"_t_{c}") for c, v in values.items()))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "part", *(F.sum(f"_t_{c}").over(before).alias(f"_t_{c}") for c in values)).where(F.col(f"_t_{next(iter(values))}").isNotNull())
    # at most one key goes on from one range to the next
    carried = F.broadcast(scratch.cut(carried, tag))
    out = df.select("*", *(F.sum(v).over(within).alias(c) for c, v in values.items())).join(carried, [key, "part"], "left")
    return out.select(*df.columns, *((F.col(c) + F.coalesce(F.col(f"_t_{c}"), F.lit(0))).alias(c) for c in values))


def rebuilt(turns: DataFrame, hundred: int, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Paths `(conv_id, depth, digest, size, part)` and all `(conv_id)`: the first crc32(conv_id) % most turns of the first conversation of each hundred, then the own turns after as many."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("size"))
    slim = scratch.cut(slim.withColumn("row", F.monotonically_increasing_id()), "turns")
    n = slim.count()
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    slim = ranges(slim, [F.col("conv_id"), *order], n, scratch, "ranges")
    slim = scratch.cut(running(slim, "conv_id", order, {"place": F.lit(1).cast("long")}, scratch, "places-carried"), "places")
    ids = slim.select("conv_id").distinct()
    take = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = slim.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "digest", "size")
    heads = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % hundred).join(heads, "base").where(F.col("place") <= take)
    heads = heads.select("conv_id", "place", "digest", "size", F.lit(True).alias("head"))
    given = heads.groupBy("conv_id").agg(F.count("*").alias("given"))
    own = slim.where(F.col("place") > take).select("conv_id", (F.col("place") - take).alias("after"), "digest", "size")
    own = own.join(given, "conv_id", "left").select("conv_id", (F.col("after") + F.coalesce("given", F.lit(0))).alias("place"), "digest", "size", F.lit(False).alias("head"))
    path = scratch.cut(heads.union(own).select("conv_id", F.col("place").alias("depth"), "digest", "size"), "rebuilt")
    return ranges(path, [F.col("conv_id"), F.col("depth")], n, scratch, "paths"), ids


def ends(members: DataFrame) -> DataFrame:
    """`(*NODE, ends_sha256)`: the digest of the ascending, comma-joined conv_ids of each node's `members(*NODE, conv_id)`.

    Ids are joined range by range; then a node's pieces pass through one running digest in order.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "depth long, p1 decimal(38,0), p2 decimal(38,0)"
    kinds = pa.schema([("depth", pa.int64()), ("p1", pa.decimal128(38)), ("p2", pa.decimal128(38))])

    def join(batches):
        for batch in batches:
            rows, at = [], None
            for key, c in zip(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), batch.column(3).to_pylist(), strict=True):
                if key != at or rows[-1][2] > PIECE:
                    rows.append([key, c, 0, []])
                    at = key
                rows[-1][3].append(str(c))
                rows[-1][2] += len(rows[-1][3][-1]) + 1
            columns = [pa.array([r[0][i] for r in rows], kinds.field(i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int64()), pa.array([",".join(r[3]) for r in rows])], names=[*NODE, "first", "joined"])

    def digest(batches):
        at, now = None, None
        for batch in batches:
            done = []
            for key, joined in zip(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), batch.column(4).to_pylist(), strict=True):
                if key != at:
                    if at is not None:
                        done.append((at, now.hexdigest()))
                    at, now = key, hashlib.sha256(joined.encode())
                else:
                    now.update(f",{joined}".encode())
            yield _digests(done, kinds)
        if at is not None:
            yield _digests([(at, now.hexdigest())], kinds)

    pieces = members.select(*NODE, "conv_id").repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(join, f"{schema}, first long, joined string")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{schema}, ends_sha256 string")


def _digests(done: list, kinds: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k, _ in done], kinds.field(i).type) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([h for _, h in done], pa.string())], names=[*NODE, "ends_sha256"])


def trie(turns: DataFrame, hundred: int = 100, most: int = 6) -> DataFrame:
    """A row for each node: `conv_id` (its owner), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`."""
    scratch = Scratch(turns.sparkSession, "trie")
    paths, ids = rebuilt(turns, hundred, most, scratch)
    # two independent hashes of each turn in its place; their sums name the sequence
    hashed = lambda seed: F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")).cast("decimal(38,0)")
    sums = {"p1": hashed("wayfinder/one"), "p2": hashed("wayfinder/two"), "upto": F.col("size").cast("decimal(38,0)")}
    rows = running(paths, "conv_id", [F.col("depth")], sums, scratch, "sums-carried").select("conv_id", *NODE, "size", F.col("upto").cast("long").alias("upto"))
    zero = F.lit(0).cast("decimal(38,0)")
    roots = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), zero.alias("p1"), zero.alias("p2"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("upto"))
    rows = scratch.cut(rows.union(roots), "rows")
    whole = scratch.cut(rows.groupBy("conv_id").agg(F.max("depth").alias("length"), F.max("upto").alias("total"), F.max_by(F.struct("p1", "p2"), "depth").alias("end")), "whole")
    nodes = scratch.cut(rows.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("size").alias("size"), F.count("*").alias("n")), "nodes")
    # a node of whose members none goes on is a leaf: its owner's path ends there, and as many end there as it has members
    last = whole.select(F.col("length").alias("depth"), "end.p1", "end.p2", "conv_id")
    closed = last.groupBy(*NODE).agg(F.count("*").alias("closed"))
    leaves = nodes.join(closed, NODE).where("n = closed").select(F.col("owner").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("own"), F.sum("size").alias("owned"))
    each = whole.join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    each = scratch.cut(each.select("conv_id", "length", F.coalesce("own", F.col("length") + 1).alias("own"), (F.col("total") - F.coalesce("owned", F.lit(0))).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "each")
    # the node above a conversation's first own node belongs to another one
    above = rows.join(each.select("conv_id", (F.col("own") - 1).alias("depth"), "length").where("depth >= 0 and depth < length"), ["conv_id", "depth"])
    above = above.select("conv_id", *NODE).join(nodes.select(*NODE, "owner"), NODE).select("conv_id", F.col("owner").alias("above"))
    all_ = rows.join(each.join(above, "conv_id", "left"), "conv_id")
    parent = F.when(F.col("depth") == F.col("own"), F.col("above")).when(F.col("depth") > F.col("own"), F.col("conv_id"))
    saved = F.greatest(F.lit(0), F.col("shared") - F.col("upto") + F.col("size"))
    child = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("own"))).cast("long")
    none = F.lit(None).cast("string")
    all_ = all_.select(*NODE, "conv_id", parent.alias("parent"), F.lit(1).cast("long").alias("n"), child.alias("child"), "leaf", saved.alias("saved"), none.alias("ends"))
    nothing = [F.lit(None).cast("long")] * 2 + [F.lit(0).cast("long")] * 4
    both = all_.union(ends(last).select(*NODE, *nothing, "ends_sha256"))
    out = both.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
