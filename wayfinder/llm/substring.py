"""Removal of long passages that earlier documents hold as well, found by recompression.

Recompression names the runs and then the pairs of a word sequence, round after round, until a
symbol stands for some words. Names are fingerprints of what they stand for, so that all tasks
name alike without a dictionary; whether two neighbours pair up depends on their names alone (a
bit of each name and round says left or right) and on a cap of the length. Equal passages hence
have equal symbols inside, but for at most EDGE words at either end: a run or pair that crosses
the end of a passage can take the symbol next to it, once in each round.

Each window of `window` words has an anchor: the longest symbol (then by name, then the first)
that lies wholly between its edges. The anchor with the EDGE words around it lies in the window,
so equal windows have equal anchor keys, and the keys are few.

1. One pass gives each document its distinct anchor keys. Spark groups them globally: keys of more
   than one text are shared; each document gets its shared keys back.
2. Only documents with shared keys are read again. Windows with a shared key are named by 128 bits,
   two names made from independent names of the words, which unlike windows share with a chance of
   2 ** -128 a pair; grouping them globally verifies the repeat and gives its first document.
3. The words that covered windows hold are dropped.

Rounds end at symbols of CAPS[-1] words, and windows, not still higher symbols, decide: each round
may lose a symbol less a word at either end of a passage, 2 * EDGE = 32 words by now, and a window
of 50 words has no room for a further round that must leave something inside.

Copies of a whole text take part once, by their smallest id. Groups are reduced to minima before
the shuffle. Where rows are joined back to the minima, names with over HEAVY rows are broadcast,
since there can be but few of them, and their rows stay where they are.

Nulls: a null text has no words; a document with a null id neither loses words nor makes others
lose any. Rows that share an id never remove each other's words. Texts of any length are read
whole, a bounded piece at a time where they are many, by itself where one is longer. Empty tables
give empty results. Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch
from wayfinder.llm._text import U64, Words, chunks, mix, polynomial, windows

#: Longest run that is named; longest symbol after each round of pairs.
RUN, CAPS = 3, (3, 5, 8)
#: Words at an end of a passage that may be in symbols unlike those of its copies: a run, then a symbol a round.
EDGE = RUN + sum(c - 1 for c in CAPS)
#: Ids of documents with shared keys, and names that many rows have, are broadcast up to so many rows (under 40 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: A name with more rows than this does not wait for them in one task.
HEAVY = 1000

_A, _B = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_EMPTY = hashlib.sha256(b"").hexdigest()


def compress(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of word sequences (`doc` numbers the text of each word): their names, first words and lengths."""
    n = len(names)
    if not n:
        return names, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    run = (length >= 2) & (length <= RUN)
    # the words of a named run become one symbol, all others stay
    stay = np.ones(n, bool)
    inside = np.repeat(run, length)
    stay[inside & ~new] = False
    at = np.flatnonzero(stay)
    size = np.ones(n, np.int64)
    size[first[run]] = length[run]
    size = size[at]
    name = names[at]
    name = np.where(size > 1, mix(name * U64(_A) + size.astype(U64)), name)
    for k, cap in enumerate(CAPS):
        right = (mix(name ^ U64((k + 1) * _B & (2**64 - 1))) & U64(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (doc[at[1:]] == doc[at[:-1]]) & (size[:-1] + size[1:] <= cap)
        i = np.flatnonzero(pair)
        name[i] = mix(mix(name[i] + U64(k + 1)) * U64(_A) + name[i + 1])
        size[i] += size[i + 1]
        stay = np.ones(len(name), bool)
        stay[i + 1] = False
        name, at, size = name[stay], at[stay], size[stay]
    return name, at, size


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each window, the first word of its anchor, and the anchor's key."""
    counts = np.diff(w.offset)
    doc = np.repeat(np.arange(len(counts)), counts)
    name, at, size = compress(w.names[0].copy(), doc)
    n = len(w.names[0])
    rank = np.zeros(n, U64)
    rank[at] = (size.astype(U64) << U64(60)) | (mix(name + U64(7)) >> U64(4))
    length = np.zeros(n, np.int8)
    length[at] = size
    full = np.maximum(counts - window + 1, 0)
    starts = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(w.offset[:-1], full)
    inner = window - 2 * EDGE
    best, where = np.zeros(len(starts), U64), np.zeros(len(starts), np.int64)
    for o in range(inner):
        p = starts + (EDGE + o)
        r = rank[p]
        r[length[p] > inner - o] = 0
        better = r > best
        best[better] = r[better]
        where[better] = p[better]
    sums, inverse = polynomial(w.names[0], _A, "anchors")
    used = np.unique(where)
    lo, hi = used - EDGE, used + length[used] + EDGE
    key = np.zeros(n, U64)
    key[used] = mix((sums[hi] - sums[lo]) * inverse[lo] + length[used].astype(U64))
    return starts, where, key


def _summary(window: int):
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("f", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b, w in chunks(texts):
                starts, where, key = anchors(w, window)
                n = np.diff(w.offset)
                own, offs = np.unique(where), [0]
                owner = np.searchsorted(w.offset, own, "right") - 1
                shas, parts = [], []
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                for k in range(b - a):
                    text = texts[a + k].as_py()
                    shas.append(hashlib.sha256(b" ".join((text or "").encode().split())).hexdigest())
                    parts.append(np.unique(key[own[cut[k] : cut[k + 1]]]))
                    offs.append(offs[-1] + len(parts[-1]))
                f = np.array([int(s[:16], 16) for s in shas], U64).view(np.int64)
                values = np.concatenate(parts).astype(U64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(shas), pa.array(f), lists], schema=arrow)

    return run, "doc_id long, n_words long, sha string, f long, keys array<long>"


def _windows(window: int):
    arrow = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("f", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        for batch in batches:
            ids, fs, lists = batch.column(0), batch.column(1), batch.column(3)
            for a, b, w in chunks(batch.column(2)):
                starts, where, key = anchors(w, window)
                if not len(starts):
                    continue
                owner = np.searchsorted(w.offset, starts, "right") - 1
                hit = np.zeros(len(starts), bool)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                for k in range(b - a):
                    if cut[k] < cut[k + 1]:
                        shared = lists[a + k].values.to_numpy(zero_copy_only=False).view(U64)
                        hit[cut[k] : cut[k + 1]] = np.isin(key[where[cut[k] : cut[k + 1]]], shared)
                s, owner = starts[hit], owner[hit]
                names = [pa.array(windows(w.names[k], window, k)[s].view(np.int64)) for k in range(2)]
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*names, ids.slice(a, b - a).take(at), fs.slice(a, b - a).take(at), pa.array((s - w.offset[:-1][owner]).astype(np.int32))], schema=arrow)

    return run, "w1 long, w2 long, doc_id long, f long, pos int"


def _cut(window: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("f", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", span), ("kept", pa.string())])

    def run(batches):
        for batch in batches:
            rows = {c: [] for c in arrow.names}
            for a, b, w in chunks(batch.column(2)):
                for k in range(b - a):
                    n = int(w.offset[k + 1] - w.offset[k])
                    edge = np.zeros(n + 1, np.int64)
                    pos = batch.column(3)[a + k].values.to_numpy(zero_copy_only=False)
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    text = w.text(np.flatnonzero(~gone) + w.offset[k])
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    rows["doc_id"].append(batch.column(0)[a + k].as_py())
                    rows["f"].append(batch.column(1)[a + k].as_py())
                    rows["n_removed"].append(int(gone.sum()))
                    rows["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                    rows["spans"].append([{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()])
                    rows["kept"].append(text.decode())
            yield pa.RecordBatch.from_pydict(rows, schema=arrow)

    return run, "doc_id long, f long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string"


def _back(rows: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined to `names`, which have one row each with the number `n` of rows that there are; rows of frequent names are not shuffled."""
    heavy, light = names.where(F.col("n") > HEAVY).drop("n"), names.where(F.col("n") <= HEAVY).drop("n")
    few = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy
    return rows.join(few.select(*on), on, "left_anti").join(light, on).unionByName(rows.join(few, on))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Rows `(doc_id, n_words, n_removed, kept_sha256, spans, kept)`, one for each row of `docs`; the id is a long.

    spans: the removed words as ranges of word numbers. kept: the kept words joined by one space,
    null where nothing is removed. `window` must exceed 2 * EDGE + 2 * CAPS[-1] - 2 words.
    """
    if window < 2 * EDGE + 2 * CAPS[-1] - 1:
        raise ValueError(f"windows of under {2 * EDGE + 2 * CAPS[-1] - 1} words need not hold a whole symbol")
    scratch = Scratch(docs.sparkSession, "substring")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _summary(window)
    all_ = scratch.cut(docs.mapInArrow(run, schema), "keys")
    real = all_.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    first = scratch.cut(real.groupBy("sha").agg(F.min("doc_id").alias("first"), F.min("f").alias("f")), "first")
    rows = real.select(F.explode("keys").alias("key"), "f")
    shared = rows.groupBy("key").agg(F.min("f").alias("lo"), F.max("f").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    mine = scratch.cut(_back(rows, scratch.cut(shared, "names"), ["key"]).groupBy("f").agg(F.collect_set("key").alias("keys")), "shared")
    mine = scratch.cut(mine.join(first.select("f", F.col("first").alias("doc_id")), "f").select("doc_id", "f", "keys"), "mine")
    ids = mine.select("doc_id").distinct()
    texts = docs.where("doc_id is not null").join(F.broadcast(ids) if mine.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")
    if all_.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        texts, on = texts.select("doc_id", "text"), ["doc_id"]
    else:  # rows that share an id are told apart by their words
        texts, on = texts.mapInArrow(_with_name, "doc_id long, text string, f long").dropDuplicates(["doc_id", "f"]), ["doc_id", "f"]
    run, schema = _windows(window)
    found = scratch.cut(texts.join(mine, on).select("doc_id", "f", "text", "keys").mapInArrow(run, schema), "windows")
    least = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    covered = _back(found, scratch.cut(least, "least"), ["w1", "w2"]).where("least < doc_id").groupBy("doc_id", "f").agg(F.collect_list("pos").alias("pos"))
    run, schema = _cut(window)
    changed = texts.join(covered, on).select("doc_id", "f", "text", "pos").mapInArrow(run, schema)
    out = all_.drop("keys").join(first.drop("f"), "sha", "left").join(changed, ["doc_id", "f"], "left")
    copy = F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= window), F.lit(False))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def _with_name(batches):
    for batch in batches:
        shas = [hashlib.sha256(b" ".join((t or "").encode().split())).digest()[:8] for t in batch.column(1).to_pylist()]
        f = pa.array(np.array([int.from_bytes(s, "big") for s in shas], U64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), f], names=["doc_id", "text", "f"])
