"""Packing documents into sequences along a space-filling curve.

Documents are encoded once; their ids wait in a table. A document's vector counts its ids in hashed
slots; a fixed projection takes it to few dimensions, whose Hilbert key is close for documents
alike. Rows of key and length, without ids, are sorted by ranges of the key and numbered by running
sums, which gives each document its place on one line of ids. Every SIZE ids of that line are a
sequence; what is left at its end is cut into powers of two, so no sequence needs padding. The ids
meet their places by one join and are cut there, each document by itself.

A null text is empty: its only id is the end mark. A null doc_id stays. Documents of equal keys
are ordered by doc_id and by a hash of their ids; rows equal in all of these are alike in every
column, so which comes first changes nothing. Texts of any length are encoded whole. An empty table
gives no pieces; other columns are never read.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch
from wayfinder.llm._text import U64, mix

#: Ids in a sequence.
SIZE = 1024
#: Slots of a hashed document vector, dimensions it is projected to, and bits of a coordinate.
SLOTS, DIMENSIONS, BITS = 256, 4, 15
#: Fixed value: how byte-level vocabularies split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that is left to tokenizers.
LONG = 1 << 18
#: Ids that are cut at once.
AT_ONCE = 1 << 20


class Encoder:
    """Ids of a byte-level BPE vocabulary, as tokenizers gives them.

    Ordinary texts are merged by tiktoken from the same vocabulary and pattern, which gives the same
    ids (tested on all code points) in a third of the time. Texts that hold a special token's
    string, and those of more than LONG characters, go to tokenizers itself.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        ranks = {bytes(map(byte.__getitem__, w)): k for w, k in json.loads(model)["model"]["vocab"].items() if w not in special}
        self.merged = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) > LONG or self.special.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.merged.encode_ordinary(text)


_encoders: dict[int, Encoder] = {}


def _encoder(model) -> Encoder:
    """One encoder for each broadcast vocabulary and worker."""
    key = id(model.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model.value)
    return _encoders[key]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The places of points of whole coordinates below 2 ** bits on the Hilbert curve (Skilling, 2004)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def _projection() -> np.ndarray:
    """SLOTS fixed directions of unit length for each dimension."""
    signs = mix(np.arange(1, SLOTS * DIMENSIONS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(63)
    return (signs.astype(np.float64) * 2 - 1).reshape(SLOTS, DIMENSIONS) / np.sqrt(SLOTS)


_known: list[np.ndarray] = []


def _slots(n: int) -> np.ndarray:
    """The hashed slots of ids below n."""
    if not _known or len(_known[0]) < n:
        _known[:] = [(mix(np.arange(1, 2 * n + 1, dtype=U64)) % U64(SLOTS)).astype(np.int64)]
    return _known[0]


def keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose `ids` follow each other, `counts` of them in each."""
    slot = _slots(int(ids.max(initial=0)) + 1)[ids]
    held = np.bincount(np.repeat(np.arange(len(counts)) * SLOTS, counts) + slot, minlength=len(counts) * SLOTS)
    v = np.log1p(held.reshape(len(counts), SLOTS))
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
    at = np.floor((v @ _projection() + 1) / 2 * ((1 << BITS) - 1))
    return hilbert(np.clip(at, 0, (1 << BITS) - 1), BITS)


def encoded(docs: DataFrame, model: str, end: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """`(doc_id, n, key, ids)`: the number of ids with the end mark, the Hilbert key, and the ids as numbers of `width` bytes."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = "H" if width == 2 else "I"

    def run(batches):
        coder = _encoder(held)
        for whole in batches:
            for a in range(0, whole.num_rows, 128):
                batch = whole.slice(a, 128)
                ids = []
                for t in batch.column(1).fill_null("").to_pylist():
                    own = array(kind, coder.encode(t))
                    own.append(end)
                    ids.append(own.tobytes())
                n = np.array([len(x) // width for x in ids])
                key = keys(np.frombuffer(b"".join(ids), f"u{width}"), n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(key), pa.array(ids, pa.binary())], names=["doc_id", "n", "key", "ids"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n long, key long, ids binary")


def placed(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """`slim(row, doc_id, n, key, h)` as `(row, start, whole)`: the ids before each document on the line and those of the whole line."""
    order: list[Column] = [F.col(c) for c in ("key", "doc_id", "h", "row")]
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = scratch.cut(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    # a row for each range
    sums = ranges.groupBy("part").agg(F.sum("n").alias("held"))
    sums = sums.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("ahead"), F.sum("held").over(Window.partitionBy()).alias("whole"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy(*order)) - F.col("n")
    return ranges.select("row", "part", before.alias("before")).join(F.broadcast(scratch.cut(sums, "sums")), "part").select("row", (F.col("ahead") + F.col("before")).alias("start"), "whole")


def borders(start: int, n: int, whole: int) -> list[int]:
    """Where sequences begin inside [start, start + n) of a line of `whole` ids."""
    full = whole // SIZE * SIZE
    out = list(range(-(-start // SIZE) * SIZE, min(start + n, full), SIZE)) if start < full else []
    if start + n > full:
        at, left = full, whole - full
        while left:
            if start <= at < start + n:
                out.append(at)
            step = 1 << left.bit_length() - 1
            at, left = at + step, left - step
    return out


def sequence(at: int, whole: int) -> tuple[int, int]:
    """(number, first place) of the sequence that holds place `at` of the line."""
    full = whole // SIZE * SIZE
    if at < full:
        return at // SIZE, at // SIZE * SIZE
    number, first, left = full // SIZE, full, whole - full
    while True:
        step = 1 << left.bit_length() - 1
        if at < first + step:
            return number, first
        number, first, left = number + 1, first + step, left - step


def pack(docs: DataFrame, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces `(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`; `ids` are little-endian numbers of 32 bits.

    The pieces of a sequence, ordered by offset, are its ids without a gap.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    with open(path) as f:
        model = f.read()
    # ids of a vocabulary of no more than 2 ** 16 travel as two bytes
    width = 2 if max(end, *json.loads(model)["model"]["vocab"].values()) < 1 << 16 else 4
    table = scratch.cut(encoded(docs, model, end, width, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.md5("ids")), "ids")
    at = placed(table.select("row", "doc_id", "n", "key", "h"), scratch)
    both = table.select("row", "doc_id", "n", "ids").join(at, "row").select("doc_id", "n", "ids", F.col("start").alias("place"), "whole")
    schema = f"doc_id {both.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            rows: dict[str, list] = {c: [] for c in names}
            of, held = [], 0
            for i, (n, ids, place, whole) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                ids = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                cuts = [place, *(b for b in borders(place, n, whole) if b > place), place + n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    number, first = sequence(a, whole)
                    for c, x in zip(names, (a - place, b - a, ids[4 * (a - place) : 4 * (b - place)], n, number, a - first), strict=True):
                        rows[c].append(x)
                    of.append(i)
                held += n
                if held >= AT_ONCE or i == batch.num_rows - 1:
                    kinds = [pa.binary() if c == "ids" else pa.int64() for c in names]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(rows[c], k) for c, k in zip(names, kinds, strict=True))], names=["doc_id", *names])
                    rows, of, held = {c: [] for c in names}, [], 0

    return both.mapInArrow(run, schema)
