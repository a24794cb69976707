"""Near-duplicate documents by MinHash bands and odd sketches.

1. One pass over the texts gives every document a 128-bit fingerprint of its set of shingles (two
   sums over independent names of words), the
   band keys of a MinHash signature, and an odd sketch: the signature's samples folded into a
   bitmap by parity, so that the XOR of two bitmaps counts the samples that differ.
2. Documents with equal sets become one node. In each bucket of a band one member, another in each
   band, is paired with all others; pairs whose sketches allow the similarity are candidates. What
   a bucket holds besides, members that the sketches tell apart from the pivot, is compared among
   itself and with the bucket's other members, sketch by sketch in blocks of bounded size, and gives
   a forest of candidates. A bucket of n alike members so costs n pairs, not n squared.
3. Nodes joined by candidates form groups. Each group's texts meet once, in blocks of bounded size;
   there links are decided exactly, on full sets of real words. Within a block, members of the largest cluster
   need no more comparisons among themselves, and all others are compared with every member.
   Groups of several blocks share some members between blocks, and what is not in the largest
   cluster by then is compared with all blocks, so no link between clusters is missed.

A pair of the least similarity shares no band with probability (1 - 0.8^4)^24 = 3e-6;
that does not count the sketches, which drop a pair five standard errors below it.

Nulls: a document without words, or with a null id, links with nothing; a null id has a null
component and is kept. Rows that share an id are one document, linked by any of its texts. Empty
tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch
from wayfinder.llm._shared import components, runs
from wayfinder.llm._text import U64, chunks, mix, shingles

BANDS, ROWS, SKETCH = 24, 4, 8  # SKETCH: 64-bit words
#: A sketch pair stays a candidate down to this estimate, five standard errors below 0.8.
ESTIMATE = 0.6
#: Members and shingles that a block should hold.
BLOCK, BLOCK_SHINGLES, SKETCH_BLOCK = 1024, 1 << 20, 4096
#: Candidates up to so many rows (24 bytes each) are broadcast to the texts; beyond, both are shuffled.
BROADCAST_ROWS = 400_000

_K = BANDS * ROWS
_XOR = mix(np.arange(1, _K + 1, dtype=U64) * U64(0x9FB21C651E98DF25))
_MUL = mix(np.arange(1001, _K + 1001, dtype=U64)) | U64(1)
#: The most differing bits that the estimate allows.
MOST_BITS = int(32 * SKETCH * (1 - np.exp(-2 * (2 * _K * (1 - ESTIMATE)) / (64 * SKETCH))))


def signatures(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each of _K functions and a column for each non-empty set."""
    out = np.empty((_K, len(offs) - 1), U64)
    for k in range(_K):
        out[k] = np.minimum.reduceat((sets ^ _XOR[k]) * _MUL[k], offs[:-1])
    return out


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """For each column of a signature matrix SKETCH words: bit h(k, value) flips once for each sample."""
    n = sig.shape[1]
    out = np.zeros((n, SKETCH), U64)
    rows = np.arange(n)
    for k in range(_K):
        at = mix(sig[k] + _XOR[k]) % U64(64 * SKETCH)
        out[rows, (at >> U64(6)).astype(np.int64)] ^= U64(1) << (at & U64(63))
    return out


def _sketched(k: int):
    schema = "doc_id long, f1 long, f2 long, n long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(SKETCH))
    arrow = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), *((f"s{i}", pa.int64()) for i in range(SKETCH))])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, w in chunks(batch.column(1), fold=True):
                sets, second, offs = shingles(w, k)
                n = np.diff(offs)
                some = np.flatnonzero(n)
                f1, f2 = np.zeros(b - a, U64), np.zeros(b - a, U64)
                bands, sketch = np.zeros((b - a, BANDS), U64), np.zeros((b - a, SKETCH), U64)
                if len(some):
                    starts = offs[:-1][some]
                    f1[some] = np.add.reduceat(mix(sets ^ U64(0x1234567)), starts)
                    f2[some] = np.add.reduceat(mix(second ^ U64(0x7654321)), starts)
                    sig = signatures(sets, np.append(starts, len(sets)))
                    sketch[some] = odd_sketch(sig)
                    for j in range(BANDS):
                        key = np.full(len(some), U64(j + 1))
                        for row in sig[j * ROWS : (j + 1) * ROWS]:
                            key = mix(key * U64(0x9E3779B97F4A7C15) + row)
                        bands[some, j] = key
                width = np.where(n > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(bands[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(n.astype(np.int64)), lists, *(pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(SKETCH))], schema=arrow)

    return run, schema


class Clusters:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.size = [1] * n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.up[y] = x
        self.size[x] += self.size[y]
        return True


class Index:
    """Postings of some sets, to count a set's common members with all of them at once."""

    def __init__(self, sets: np.ndarray, offs: np.ndarray):
        self.n = len(offs) - 1
        self.sizes = np.diff(offs)
        self.names, inverse = np.unique(sets, return_inverse=True)
        owner = np.repeat(np.arange(self.n), self.sizes)
        self.owner = owner[np.argsort(inverse, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(self.names)))])

    def linked(self, one: np.ndarray, percent: int) -> np.ndarray:
        """Which sets have 100 * intersection >= percent * union with the set `one`."""
        size = len(one)
        at = np.searchsorted(self.names, one)
        there = at < len(self.names)
        at, one = at[there], one[there]
        hit = at[self.names[at] == one]
        lo, n = self.at[hit], self.at[hit + 1] - self.at[hit]
        if not len(lo):
            return np.zeros(0, np.int64)
        places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[places], minlength=self.n)
        return np.flatnonzero((100 * both >= percent * (self.sizes + size - both)) & (both > 0))


def cluster(sets: np.ndarray, offs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets into their exact clusters, at most one less than there are sets."""
    n = len(offs) - 1
    index, at, out = Index(sets, offs), Clusters(n), []
    done = np.zeros(n, bool)
    # three queries give a large cluster; every set outside it is then a query itself
    order, top = [0, n // 2, n - 1, *range(n)], 0
    for k, q in enumerate(order):
        if k == 3:
            top = max(map(at.find, order[:3]), key=lambda r: at.size[r])
        if done[q] or (k >= 3 and at.size[at.find(q)] > 1 and at.find(q) == at.find(top)):
            continue
        done[q] = True
        for x in index.linked(sets[offs[q] : offs[q + 1]], percent).tolist():
            if at.join(q, x):
                out.append((q, x))
    return out


def _sets(texts: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some texts, as numbers that stand for the real shingles: words are numbered by their bytes, and pairs of numbers are numbered in turn."""
    starts, words, n = [0], [], []
    for _, _, w in chunks(texts, fold=True):
        words.append(w.pieces())
        n.append(np.diff(w.offset))
    number = lambda x: np.unique(x, return_inverse=True)[1].astype(np.int64)
    own = pa.chunked_array(words or [pa.array([], pa.large_binary())]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.concatenate([np.zeros(0, np.int64), *n])
    offset = np.concatenate([[0], np.cumsum(n)])
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    first = np.arange(starts[-1]) - starts[text] + offset[text]
    length = np.minimum(n[text], k)
    name = own[first] if len(own) else np.zeros(0, np.int64)
    for j in range(1, k):  # 0: the text has ended
        name = number(name << 32 | np.where(j < length, own[first + np.minimum(j, length - 1)] + 1, 0))
    both = np.unique(text << 32 | name)
    return (both & 0xFFFFFFFF).astype(U64), np.searchsorted(both >> 32, np.arange(len(n) + 1))


def _edges(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_block(k: int, percent: int):
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("node").to_pylist()
        found = cluster(*_sets(t.column("text"), k), percent)
        return _edges([ids[x] for x, _ in found], [ids[y] for _, y in found])

    return run


def _across(k: int, percent: int):
    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        sets, offs = _sets(t.column("text"), k)
        ids, of = t.column("node").to_pylist(), t.column("component").to_pylist()
        members = np.flatnonzero(~asks)
        if not len(members) or not asks.any():
            return _edges([], [])
        index = Index(np.concatenate([sets[offs[m] : offs[m + 1]] for m in members]), np.concatenate([[0], np.cumsum(np.diff(offs)[members])]))
        # one link joins a query's component to another one
        names = {c: i for i, c in enumerate(dict.fromkeys(of))}
        at, out = Clusters(len(names)), []
        for q in np.flatnonzero(asks).tolist():
            for x in members[index.linked(sets[offs[q] : offs[q + 1]], percent)].tolist():
                if at.join(names[of[q]], names[of[x]]):
                    out.append((ids[q], ids[x]))
        return _edges([a for a, _ in out], [b for _, b in out])

    return run


def _candidates(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs `(a, b)` of nodes that share a band and that their sketches allow."""
    rows = nodes.select(F.explode("bands").alias("key"), "node")
    marks = nodes.select("node", *(f"s{i}" for i in range(SKETCH)))
    # node XOR key orders a bucket's members in another way for each key: its least is the pivot
    mixed = F.col("node").bitwiseXOR(F.col("key"))
    pivots = rows.groupBy("key").agg(F.min(mixed).alias("lo"), F.max(mixed).alias("hi")).where("lo <> hi").select("key", F.col("lo").bitwiseXOR(F.col("key")).alias("pivot"))
    rows = scratch.cut(rows.join(pivots, "key").where("node <> pivot"), "buckets")
    left = marks.select(F.col("node").alias("pivot"), *(F.col(f"s{i}").alias(f"p{i}") for i in range(SKETCH)))
    bits = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"p{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("s0").bitwiseXOR(F.col("p0"))))
    pairs = rows.select("pivot", "node").distinct().join(marks, "node").join(left, "pivot")
    pairs = scratch.cut(pairs.select("pivot", "node", (bits <= MOST_BITS).alias("near")), "star")
    near = pairs.where("near").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    far = rows.join(pairs.where("not near").select("pivot", "node"), ["pivot", "node"], "left_semi").select("key", "node")
    far = scratch.cut(far, "far")
    # far members meet each other and the bucket's near ones; those are alike to the pivot and need not meet themselves
    beside = rows.join(far.select("key").distinct(), "key", "left_semi").join(pairs.where("near").select("pivot", "node"), ["pivot", "node"], "left_semi").select("key", "node")
    members = scratch.cut(far.withColumn("far", F.lit(True)).union(beside.withColumn("far", F.lit(False))), "members")
    blocks = lambda far: F.ceil(F.count_if(F.col("far") == far) / SKETCH_BLOCK).cast("int")
    sizes = members.groupBy("key").agg(F.count("*").alias("m"), blocks(True).alias("fars"), blocks(False).alias("nears")).where("m > 1").drop("m")
    # blocks of far members come first, then those of near ones
    hashed = F.xxhash64("node", "key")
    block = F.when(F.col("far"), F.pmod(hashed, F.col("fars"))).otherwise(F.col("fars") + F.pmod(hashed, F.col("nears")))
    others = F.col("fars") + F.when(F.col("far"), F.col("nears")).otherwise(F.lit(0))
    dealt = members.join(sizes, "key").withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1))).join(marks, "node")
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("block", "other", "fars", "nears")
    rest = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_sketch_forest, "a long, b long")
    return near.union(rest)


def _sketch_forest(batches):
    """Of each bucket (or two blocks of it) a forest over the pairs that the sketches allow: far members with near ones, or where there are none, among themselves."""
    for _, t in runs(batches, ("key", "i", "j")):
        is_far = t.column("far").to_numpy()
        if not is_far.any():
            continue
        node = t.column("node").to_numpy()
        marks = np.stack([t.column(f"s{i}").to_numpy() for i in range(SKETCH)], axis=1).view(U64)
        order = np.argsort(~is_far, kind="stable")
        node, marks = node[order], marks[order]
        n, apart = int(is_far.sum()), not is_far.all()  # far members come first now
        at, out = Clusters(len(node)), []
        for x in range(0, n, 128):
            bits = np.zeros((min(128, n - x), len(node)), np.uint16)
            for i in range(SKETCH):
                bits += np.bitwise_count(marks[x : min(x + 128, n), i, None] ^ marks[None, :, i])
            if apart:  # the pivot joins all near members, so one of them is enough
                bits[:, :n] = MOST_BITS + 1
                p = np.flatnonzero((bits <= MOST_BITS).any(axis=1))
                out += zip((p + x).tolist(), (bits[p] <= MOST_BITS).argmax(axis=1).tolist(), strict=True)
                continue
            for p, q in zip(*np.nonzero(np.triu(bits <= MOST_BITS, x + 1)), strict=True):
                if at.join(int(p) + x, int(q)):
                    out.append((int(p) + x, int(q)))
        if out:
            i, j = np.array(out).T
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80) -> DataFrame:
    """Rows `(doc_id, n_shingles, component_id, kept)`, one for each row of `docs`; the id is a long."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _sketched(shingle)
    all_ = scratch.cut(docs.mapInArrow(run, schema), "sketches")
    real = all_.where("n > 0 and doc_id is not null")
    least = real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"))
    own = scratch.cut(least, "sets")
    nodes = real.join(own, ["f1", "f2", "n"]).where("doc_id = node").dropDuplicates(["f1", "f2", "n"]).select("node", "n", "bands", *(f"s{i}" for i in range(SKETCH)))
    nodes = scratch.cut(nodes, "nodes")
    pairs = scratch.cut(_candidates(nodes, scratch), "pairs")
    groups = components(scratch, pairs, "groups").withColumnRenamed("component", "group")
    # blocks of a group, and the members that all its blocks share
    sized = groups.join(nodes.groupBy("node").agg(F.max("n").alias("n")), "node")
    per = sized.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min(F.xxhash64("node")).alias("h1"), F.max(F.xxhash64("node")).alias("h2"))
    per = per.select("group", "h1", "h2", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = groups.join(per, "group").withColumn("block", F.pmod(F.xxhash64("node", "group"), F.col("blocks")).cast("int"))
    placed = scratch.cut(placed.select("node", "group", "blocks", "block", F.xxhash64("node").isin(F.col("h1"), F.col("h2")).alias("shared")), "placed")
    texts = scratch.cut(_meet(docs, placed, "placed"), "texts")
    once = texts.withColumn("block", F.explode(F.when(F.col("shared"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    links = scratch.cut(once.select("group", "block", "node", "text").groupBy("group", "block").applyInArrow(_in_block(shingle, percent), "a long, b long"), "links")
    wide = texts.where("blocks > 1")
    if not wide.isEmpty():
        now = components(scratch, links, "inner").select("node", "component")
        wide = wide.drop("shared").join(now, "node", "left").withColumn("component", F.coalesce("component", "node"))
        wide = scratch.cut(wide, "wide")
        top = wide.select("group", "component", "node").distinct().groupBy("group", "component").agg(F.count("*").alias("m")).groupBy("group").agg(F.max(F.struct("m", "component")).alias("top"))
        asks = wide.join(top.select("group", F.col("top.component").alias("largest")), "group").where("component <> largest").drop("largest")
        n_asks = asks.groupBy("group").agg(F.ceil(F.countDistinct("node") / BLOCK).cast("int").alias("parts"))
        members = wide.join(n_asks, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(False))
        asks = asks.join(n_asks, "group").withColumn("part", F.pmod(F.xxhash64("node", "group"), F.col("parts")).cast("int"))
        asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
        columns = ["group", "block", "part", "node", "component", "asks", "text"]
        more = members.select(*columns).unionByName(asks.select(*columns)).groupBy("group", "block", "part").applyInArrow(_across(shingle, percent), "a long, b long")
        links = scratch.cut(links.union(more), "all-links")
    found = components(scratch, links, "final")
    # rows that share an id join their sets as well
    same = real.join(own, ["f1", "f2", "n"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    member = same.join(found.select(F.col("node").alias("b"), "component"), "b", "left").select("a", F.coalesce("component", "b").alias("c"))
    twice = member.groupBy("a").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    if not twice.where("lo <> hi").isEmpty():
        found = components(scratch, links.union(same), "ids")
        member = same.join(found.select(F.col("node").alias("b"), "component"), "b", "left").select("a", F.coalesce("component", "b").alias("c"))
        twice = member.groupBy("a").agg(F.min("c").alias("lo"))
    result = all_.select("doc_id", F.col("n").alias("n_shingles")).join(twice.select(F.col("a").alias("doc_id"), F.col("lo")), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lo", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _meet(docs: DataFrame, placed: DataFrame, name: str) -> DataFrame:
    """The texts of placed nodes; the placement is broadcast only if it is known to be small."""
    few = placed.count() <= BROADCAST_ROWS
    return docs.withColumnRenamed("doc_id", "node").join(F.broadcast(placed) if few else placed, "node")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each component, all columns kept.

    Rows that share an id are told apart by their texts: one goes only if it has the text of
    another or links with it. Of a component the smallest id stays, then the least hash of id and
    text, then the first row as JSON.

    Only the ids that go meet the texts, broadcast if they are counted to be few; so texts are not
    shuffled unless more than BROADCAST_ROWS documents go or ids repeat.
    """
    scratch = Scratch(docs.sparkSession, "gone")
    again = scratch.cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_wf_again")).count().where("count > 1").select("_wf_again"), "again")
    if again.isEmpty():
        gone = scratch.cut(link(docs, **options).where("not kept").select("doc_id"), "ids")
        return docs.join(_few(gone), "doc_id", "left_anti").select(*docs.columns)
    own = F.when(F.col("_wf_again").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).otherwise(F.col("doc_id").cast("long"))
    named = docs.join(_few(again), F.col("doc_id") == F.col("_wf_again"), "left").withColumn("_wf_id", own)
    names = scratch.cut(named.where("_wf_id is not null").select("_wf_id", F.col("doc_id").alias("_wf_doc")).distinct(), "names")
    found = link(named, id_col="_wf_id", **options).where("doc_id is not null").select(F.col("doc_id").alias("_wf_id"), "component_id").distinct()
    found = scratch.cut(found.join(names, "_wf_id"), "found")
    stays = found.groupBy("component_id").agg(F.min(F.struct("_wf_doc", "_wf_id")).alias("stays"))
    gone = scratch.cut(found.join(stays, "component_id").where("_wf_id <> stays._wf_id").select("_wf_id"), "ids")
    left = named.join(_few(gone), "_wf_id", "left_anti")
    row = F.struct(*docs.columns)
    once = left.where("_wf_again is not null").groupBy("_wf_id").agg(F.min_by(row, F.to_json(row)).alias("_wf_row")).select("_wf_row.*")
    return left.where("_wf_again is null").select(*docs.columns).unionByName(once)


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
