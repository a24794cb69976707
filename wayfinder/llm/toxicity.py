"""Toxicity scores from a convolutional text classifier trained in numpy.

A word is embedded by hashes of its first 4, 5 and 6 bytes (a shorter word by all of it) and of all
its bytes, A to Z folded: four tables of SLOTS rows, added up. Filters over one, two and three words
are pooled by their maximum over the whole text, and a logistic layer gives the score. Rows of the
tables start at the log odds of their prefix or word among labelled texts; slots seen in too few of
them stay zero, so that words never learned say nothing. Training follows the pooled words back.

All labelled documents are learned from, where they lie: a job counts in how many of each label a
slot is found, then each of EPOCHS rounds trains every pack of about PACK texts from the same model
and averages what the packs changed (rows of the tables over the packs that moved them). Sums are of
integers, so neither order nor number of tasks matters. The driver receives sums by slot alone, whose
number is fixed; texts never reach it.
Thresholds are calibrated by language on the labelled rows kept out of training, a sixth of them; the
language is no input of a score. Null and empty texts have the score of no words, texts of any length are read whole. A null
label or id is not learned from; a label row that repeats counts once, as toxic if any says so; of
documents that share an id the least text is learned from. Without both labels all scores are 0.
Each row is scored by itself, so rows that repeat or tie score alike; an empty table gives none.
Columns named like the added ones are replaced, all others are kept and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch
from wayfinder.llm._text import _BASE, _FOLDED, U64, Words, chunks, mix, polynomial

SLOTS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 17, 8, 6, (1, 2, 3), (4, 5, 6)
TABLES = len(PREFIXES) + 1  # the last one is of whole words
SEEN, EPOCHS, SEED = 3, 6, 7
#: Texts of a pack, by the mean; a pack of more bytes is trained in parts.
PACK, PACK_BYTES = 4096, 1 << 25
#: Sums of changes are kept as multiples of 1 / UNIT, scores as bins of thresholds as multiples of 1 / BINS.
UNIT, BINS = 1 << 24, 4096


def slots(w: Words) -> np.ndarray:
    """For each word a row of table rows, one for each prefix length and one for the whole word."""
    sums, inverse = polynomial(_FOLDED[w.data], _BASE, "bytes")
    out = np.empty((len(w.start), TABLES), np.int32)
    for k, m in enumerate(PREFIXES):
        end = np.minimum(w.end, w.start + m)
        h = mix((sums[end] - sums[w.start]) * inverse[w.start] + U64(k + 1) + ((end - w.start) < m).astype(U64))
        out[:, k] = (h % U64(SLOTS)).astype(np.int32)
    out[:, -1] = (mix((sums[w.end] - sums[w.start]) * inverse[w.start]) % U64(SLOTS)).astype(np.int32)
    return out


@dataclass
class Model:
    tables: np.ndarray = field(default_factory=lambda: np.zeros((TABLES, SLOTS, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # width x DIM x FILTERS each
    shift: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    last: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    bias: float = -50.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, at: np.ndarray) -> np.ndarray:
        e = self.tables[0][at[:, 0]]
        for k in range(1, TABLES):
            e += self.tables[k][at[:, k]]
        return e

    def convolve(self, e: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Filter outputs at each word; beyond the end of a text words are zero."""
        n = len(e)
        left = np.repeat(offset[1:], np.diff(offset)) - np.arange(n)  # words from here to the end of the text
        out = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        for j, f in enumerate(self.filters):
            part = out[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(len(f)):
                part[: n - k] += (e @ f[k])[k:] * (left[: n - k, None] > k) if k else e @ f[0]
        return out

    def pool(self, out: np.ndarray, offset: np.ndarray) -> np.ndarray:
        pooled = np.zeros((len(offset) - 1, out.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(offset))
        if len(some):
            pooled[some] = np.maximum(np.maximum.reduceat(out, offset[:-1][some], axis=0) + self.shift, 0)
        return pooled

    def scores(self, at: np.ndarray, offset: np.ndarray) -> np.ndarray:
        if not self.filters:
            return np.zeros(len(offset) - 1)
        pooled = self.pool(self.convolve(self.embed(at), offset), offset)
        return 1 / (1 + np.exp(-np.clip((pooled @ self.last).astype(float) + self.bias, -60, 60)))


def _batches(texts: Iterator[Words]) -> tuple[np.ndarray, np.ndarray]:
    parts, sizes = [np.zeros((0, TABLES), np.int32)], []
    for w in texts:
        parts.append(slots(w))
        sizes.append(np.diff(w.offset))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int64)


def seen_in(at: np.ndarray, offset: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each label, table and slot the number of texts with a word there."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(offset))
    out = np.zeros((2, TABLES, SLOTS), np.int64)
    for k in range(TABLES):
        pair = np.unique(doc * SLOTS + at[:, k])
        for label in (0, 1):
            out[label, k] = np.bincount(pair[toxic[pair // SLOTS] == label] % SLOTS, minlength=SLOTS)
    return out


@dataclass
class Training:
    """A model on its way, with the slots that may move and the sums of Adagrad."""

    model: Model
    known: np.ndarray
    moved: np.ndarray
    state: np.ndarray

    def dense(self) -> np.ndarray:
        m = self.model
        return np.concatenate([m.last, [np.float32(m.bias)], m.shift, *(f.ravel() for f in m.filters)]).astype(np.float32)

    def set_dense(self, x: np.ndarray) -> None:
        m, n = self.model, FILTERS * len(WIDTHS)
        m.last, m.bias, m.shift, at = x[:n], float(x[n]), x[n + 1 : 2 * n + 1], 2 * n + 1
        for j, f in enumerate(m.filters):
            m.filters[j] = x[at : at + f.size].reshape(f.shape)
            at += f.size


def begin(counts: np.ndarray, n0: int, n1: int, seed: int = SEED) -> Training:
    """The model before its first round: tables from the log odds of what is seen in texts of both labels."""
    model, rng = Model(), np.random.default_rng(seed)
    f, t = counts
    known = t + f >= SEEN
    odds = np.log((t + 0.5) / (n1 + 1)) - np.log((f + 0.5) / (n0 + 1))
    model.tables[known, 0] = np.clip(odds, -2, 4)[known] / 4
    model.tables[known, 1:] = rng.normal(0, 0.02, (known.sum(), DIM - 1))
    model.filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for g in model.filters:
        g[:, 0, : FILTERS // 2] = 1.0 / len(g)
    model.shift[:] = -0.5
    model.last = rng.normal(0.5, 0.1, len(model.last)).astype(np.float32)
    model.bias = -2.0
    now = Training(model, known, np.full((TABLES, SLOTS), 1e-4, np.float32), np.zeros(0, np.float32))
    now.state = np.full(len(now.dense()), 1e-6, np.float32)
    return now


def descend(now: Training, at: np.ndarray, offset: np.ndarray, toxic: np.ndarray, weight: np.ndarray, epoch: int, rng: np.random.Generator) -> None:
    """One pass of Adagrad over texts with 0 or 1 each, 32 at a time; changes `now` in place."""
    model, rate, n = now.model, 0.1 / (1 + epoch), FILTERS * len(WIDTHS)
    order = rng.permutation(len(toxic))
    for lo in range(0, len(order), 32):
        ids = order[lo : lo + 32]
        rows = np.concatenate([np.arange(offset[i], offset[i + 1]) for i in ids])
        own = np.concatenate([[0], np.cumsum(offset[ids + 1] - offset[ids])])
        a = at[rows]
        e = model.embed(a)
        out = model.convolve(e, own)
        pooled = model.pool(out, own)
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.last + model.bias, -30, 30)))
        g = ((p - toxic[ids]) * weight[ids] / len(ids)).astype(np.float32)
        back = np.outer(g, model.last) * (pooled > 0)
        top = np.zeros(back.shape, np.int64)  # the word that each filter was pooled from
        for d in np.flatnonzero(np.diff(own)).tolist():
            top[d] = out[own[d] : own[d + 1]].argmax(axis=0) + own[d]
        ge = np.zeros_like(e)
        gf = [np.zeros_like(f) for f in model.filters]
        for j, f in enumerate(model.filters):
            part, first = back[:, j * FILTERS : (j + 1) * FILTERS], top[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(len(f)):
                d, q = np.nonzero((part != 0) & (first + k < own[1:, None]))
                i, x = first[d, q] + k, part[d, q][:, None]
                np.add.at(ge, i, x * f[k].T[q])
                np.add.at(gf[j][k].T, q, x * e[i])
        dense = now.dense()
        pull = np.concatenate([pooled.T @ g + 1e-4 * model.last, [g.sum()], back.sum(axis=0), *((y + 1e-4 * f).ravel() for y, f in zip(gf, model.filters, strict=True))])
        now.state += pull * pull
        rates = np.full(len(dense), rate * 0.3, np.float32)
        rates[: n + 1] = rate
        now.set_dense((dense - rates * pull / np.sqrt(now.state)).astype(np.float32))
        hit = np.flatnonzero(np.abs(ge).sum(axis=1))
        for k in range(TABLES):
            s = a[hit, k]
            ok = now.known[k][s]
            s, d = s[ok], ge[hit][ok]
            u, inverse = np.unique(s, return_inverse=True)
            total = np.zeros((len(u), DIM), np.float32)
            np.add.at(total, inverse, d)
            now.moved[k, u] += (total * total).mean(axis=1)
            model.tables[k, u] -= rate * 0.2 * total / np.sqrt(now.moved[k, u])[:, None]


def train(texts: pa.ChunkedArray | pa.Array, toxic: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Model:
    """Fit to texts at hand with 0 or 1 each: one pack, trained in every round."""
    if not len(toxic) or toxic.min() == toxic.max():
        return Model()
    at, offset = _batches(w for _, _, w in chunks(texts))
    now = begin(seen_in(at, offset, toxic), int((toxic == 0).sum()), int(toxic.sum()), seed)
    for epoch in range(EPOCHS):
        descend(now, at, offset, toxic, weight, epoch, np.random.default_rng([seed, epoch, 0]))
    return now.model


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(pack, texts, labels) of rows `(pack, text, toxic)` that are in order of their packs."""
    held, size = [], 0

    def out():
        t = pa.Table.from_batches(held)
        return t.column("pack")[0].as_py(), t.column("text"), t.column("toxic").to_numpy()

    for batch in batches:
        pack, sizes = batch.column("pack").to_numpy(), pc.binary_length(batch.column("text")).to_numpy()
        ends = np.append(np.flatnonzero(np.diff(pack)) + 1, len(pack)) if len(pack) else []
        lo = 0
        for hi in ends:
            if held and (held[0].column("pack")[0].as_py() != pack[lo]):
                yield out()
                held, size = [], 0
            while lo < hi:
                upto = min(hi, lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:hi]), PACK_BYTES - size, "right"))))
                held.append(batch.slice(lo, upto - lo))
                size += int(sizes[lo:upto].sum())
                lo = upto
                if size >= PACK_BYTES:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def _count(rows: DataFrame) -> np.ndarray:
    """`seen_in` of all rows, in one job."""

    def run(batches):
        total = np.zeros((2, TABLES, SLOTS), np.int64)
        for _, texts, toxic in _packs(batches):
            total += seen_in(*_batches(w for _, _, w in chunks(texts)), toxic)
        slot = np.flatnonzero(total.any(axis=0))
        flat = total.reshape(2, -1)[:, slot]
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(flat[0]), pa.array(flat[1])], names=["slot", "clean", "bad"])

    found = rows.mapInArrow(run, "slot long, clean long, bad long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    found = found.where(F.col("clean") + F.col("bad") >= SEEN).select(F.col("slot").cast("int"), "clean", "bad").toArrow()  # rows at most: all slots
    out = np.zeros((2, TABLES * SLOTS), np.int64)
    for k, name in enumerate(("clean", "bad")):
        out[k, found.column("slot").to_numpy()] = found.column(name).to_numpy()
    return out.reshape(2, TABLES, SLOTS)


def _round(rows: DataFrame, now: Training, epoch: int) -> None:
    """Every pack trained once from `now`, which then becomes their mean."""
    shared = rows.sparkSession.sparkContext.broadcast(now)  # of a fixed size, 20 MB
    names = ["moved", *(f"v{k}" for k in range(DIM))]

    def run(batches):
        start = shared.value
        m = start.model
        total = np.zeros((TABLES * SLOTS, DIM + 1), np.int64)
        n = np.zeros(TABLES * SLOTS, np.int32)
        dense, state, packs = np.zeros(len(start.state), np.int64), np.zeros(len(start.state), np.int64), 0
        tables, moved = m.tables.copy(), start.moved.copy()
        for pack, texts, toxic in _packs(batches):
            own = Training(Model(tables, list(m.filters), m.shift.copy(), m.last.copy(), m.bias), start.known, moved, start.state.copy())
            at, offset = _batches(w for _, _, w in chunks(texts))
            descend(own, at, offset, toxic, np.ones(len(toxic)), epoch, np.random.default_rng([SEED, epoch, pack]))
            slot = np.flatnonzero(((moved != start.moved) | (tables != m.tables).any(axis=2)).ravel())
            k, s = np.divmod(slot, SLOTS)
            total[slot, 0] += np.rint((moved[k, s].astype(float) - start.moved[k, s]) * UNIT).astype(np.int64)
            total[slot, 1:] += np.rint((tables[k, s].astype(float) - m.tables[k, s]) * UNIT).astype(np.int64)
            n[slot] += 1
            tables[k, s], moved[k, s] = m.tables[k, s], start.moved[k, s]
            dense += np.rint((own.dense().astype(float) - start.dense()) * UNIT).astype(np.int64)
            state += np.rint((own.state.astype(float) - start.state) * UNIT).astype(np.int64)
            packs += 1
        slot = np.flatnonzero(n)
        key = [slot, -1 - np.arange(len(dense))]  # below 0: what is not in the tables
        rest = np.zeros((len(dense), DIM + 1), np.int64)
        rest[:, 0], rest[:, 1] = state, dense
        both = np.concatenate([total[slot], rest])
        columns = [np.concatenate(key), np.concatenate([n[slot], np.full(len(dense), packs)]).astype(np.int64), *both.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["slot", "n", *names])

    found = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["slot", "n", *names])).groupBy("slot").agg(*(F.sum(c).alias(c) for c in ["n", *names]))
    mean = found.where("n > 0").select(F.col("slot").cast("int"), *((F.col(c) / F.col("n") / UNIT).cast("float").alias(c) for c in names)).toArrow()
    shared.destroy()
    slot = mean.column("slot").to_numpy()
    change = np.stack([mean.column(c).to_numpy() for c in names], axis=1)
    inner = slot >= 0
    k, s = np.divmod(slot[inner], SLOTS)
    now.moved[k, s] += change[inner, 0]
    now.model.tables[k, s] += change[inner, 1:]
    at, dense = -1 - slot[~inner], now.dense()
    now.state[at] += change[~inner, 0]
    dense[at] += change[~inner, 1]
    now.set_dense(dense)


def calibrate(rows: DataFrame, model: Model) -> dict[str, float]:
    """For each language the threshold with the best F1 on `rows(text, lang, toxic)`, between bins of scores; the one of all rows is under the empty name."""
    one = score(rows.select("toxic", "lang", "text"), model).select("toxic", "score", F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.col("score") * BINS).alias("bin"))
    sums = [F.sum("n").alias("n"), F.sum("t").alias("t"), F.min("low").alias("low"), F.max("high").alias("high")]
    by_lang = one.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.min("score").alias("low"), F.max("score").alias("high"))
    bins = by_lang.where("lang <> ''").unionByName(by_lang.groupBy("bin").agg(*sums).withColumn("lang", F.lit("")))
    down = Window.partitionBy("lang").orderBy(F.desc("bin"))  # BINS + 1 rows a language at most
    whole = Window.partitionBy("lang")
    bins = bins.withColumn("below", F.coalesce(F.lead("high").over(down), F.lit(0.0))).withColumn("bad", F.sum("t").over(whole)).withColumn("all", F.sum("n").over(whole))
    f1 = 2 * F.sum("t").over(down) / (F.sum("n").over(down) + F.col("bad"))
    best = bins.withColumn("f1", f1).where("bad > 0 and bad < all").groupBy("lang").agg(F.max_by((F.col("low") + F.col("below")) / 2, F.struct("f1", "bin")).alias("threshold"))
    return {r["lang"]: r["threshold"] for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> Model:
    """Train on all labelled rows for which `where` (over `id`) holds."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic")).where("id is not null and toxic is not null").groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang").where("id is not null")
    if where is not None:
        marked, texts = marked.where(where), texts.where(where)
    marked = scratch.cut(marked, "marked")
    packs = max(1, -(-marked.count() // PACK))
    apart = F.crc32(F.concat(F.lit("calibrate:"), F.col("id").cast("string")).cast("binary")) % 6 == 0
    pack = F.pmod(F.xxhash64("id"), F.lit(packs))
    # texts and labels meet in their packs: one shuffle of the texts, at any size
    both = texts.withColumn("toxic", F.lit(None).cast("int")).unionByName(marked.select("id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), "toxic"))
    dealt = both.withColumn("apart", apart).withColumn("pack", F.when(F.col("apart"), -1 - pack).otherwise(pack)).repartition(packs, "pack")
    one = dealt.groupBy("pack", "id", "apart").agg(F.max("toxic").alias("toxic"), F.min(F.when(F.col("text").isNotNull(), F.struct("text", "lang"))).alias("x"))  # an id that repeats counts once
    one = one.where("toxic is not null and x is not null").sortWithinPartitions("pack", "id").select("pack", "x.*", "toxic", "apart")
    one = scratch.cut(one, "texts")
    there = {r["toxic"]: r["count"] for r in one.where("not apart").groupBy("toxic").count().collect()}  # two rows at most
    if len(there) < 2:
        return Model()
    rows = one.where("not apart").select("pack", "text", "toxic")
    now = begin(_count(rows), there[0], there[1])
    for epoch in range(EPOCHS):
        _round(rows, now, epoch)
    now.model.thresholds = calibrate(one.where("apart"), now.model)
    scratch.drop("texts")
    scratch.drop("marked")
    return now.model


def score(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """`docs` without its text, with `score`, `threshold` (of the language) and `flagged`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size, 17 MB
    added = ["score", "threshold", "flagged"]
    kept = [c for c in docs.columns if c not in added]
    others = [c for c in kept if c != text_col]
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in others), "score double", "threshold double", "flagged boolean"])

    def run(batches):
        m = shared.value
        usual = m.thresholds.get("", 0.5)
        for batch in batches:
            got = [m.scores(slots(w), w.offset) for _, _, w in chunks(batch.column(kept.index(text_col)))]
            s = np.concatenate([*got, np.zeros(0)])
            langs = batch.column(kept.index(lang_col)).to_pylist() if lang_col else [None] * len(s)
            t = np.array([m.thresholds.get(x or "", usual) for x in langs], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(kept.index(c)) for c in others), pa.array(s), pa.array(t), pa.array(s >= t)], names=[*others, *added])

    return docs.select(*kept).mapInArrow(run, schema)
