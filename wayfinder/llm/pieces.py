"""Encoding into vocabulary pieces and back, losslessly.

An Aho-Corasick automaton over all pieces reports, at each character, every piece that ends there
(the output links, longest first); each relaxes the best score at its end, so one pass gives the
segmentation with the greatest sum of scores. Characters that no piece covers fall back to bytes,
at a cost below any piece. A space becomes the mark U+2581, with one more before the text.

Scores should be logarithms of likelihoods. A vocabulary of merges has ranks instead, whose sums
say nothing; a rank r then counts as -ln(r + OFFSET), the law of Zipf and Mandelbrot, so nothing
is fitted to any text.

No piece of a usable model continues over a mark after another character, nor past a character
that only stands alone; the segmentation hence falls apart at these places, and a task keeps the
best segmentation of each part it has seen, up to CACHE of them, none longer than SHORT.

Null texts have null ids; the empty text has no ids; texts of any length are encoded whole. Of
segmentations with equal scores the one whose last pieces are longest counts, so rows that repeat
have equal ids. Empty tables give empty results; columns named like the added ones are replaced,
all others are kept and never read. A mark in the text itself is spelled in bytes, so decoding
gives every text back exactly. The vocabulary file is read by the driver, from a
path given as a parameter, and broadcast: a model has a fixed number of pieces.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK, OWN = "▁", "\ud800"  # OWN stands for a mark of the text; no text holds a lone surrogate
CACHE, SHORT = 1 << 18, 48
#: What is added to a rank before its logarithm is taken.
OFFSET = 300


def load(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kinds: piece, byte, other."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "piece"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


def likelihoods(vocabulary: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """The vocabulary with a log likelihood for each piece; scores that are no ranks of merges stay."""
    scores = [s for _, s, k in vocabulary if k == "piece"]
    if not scores or len(set(scores)) < 0.99 * len(scores) or any(s > 0 or s != int(s) for s in scores):
        return vocabulary
    return [(t, -math.log(OFFSET - s) if k == "piece" else s, k) for t, s, k in vocabulary]


class Coder:
    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        import ahocorasick

        pieces = [(t, s, i) for i, (t, s, k) in enumerate(vocabulary) if k == "piece" and t]
        byte = {int(t[3:5], 16): i for i, (t, _, k) in enumerate(vocabulary) if k == "byte"}
        if len(byte) != 256:
            raise ValueError("the vocabulary must have a piece for each byte")
        self.automaton = ahocorasick.Automaton()
        for t, s, i in pieces:
            self.automaton.add_word(t, (len(t), s, i))
        self.automaton.make_automaton()
        self.byte = [byte[b] for b in range(256)]
        self.cost = 2 * min(0.0, *(s for _, s, _ in pieces)) - 10
        self.bytes = [b""] * len(vocabulary)
        for t, _, i in pieces:
            self.bytes[i] = t.replace(MARK, " ").encode()
        for b, i in byte.items():
            self.bytes[i] = bytes([b])
        # white space that no longer piece holds stands alone
        joined = {c for t, _, _ in pieces if len(t) > 1 for c in t}
        alone = "".join(c for c in "\n\t\v\f" if c not in joined)
        if any(re.search(f"[^{MARK}]{MARK}", t) for t, _, _ in pieces):
            self.parts = re.compile(r".+", re.S)
        else:
            self.parts = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.seen: dict[str, tuple[int, ...]] = {}

    def spell(self, c: str) -> list[int]:
        return [self.byte[b] for b in {OWN: MARK, MARK: " "}.get(c, c).encode()]

    def best(self, part: str) -> tuple[int, ...]:
        """The ids of the best segmentation of a part; of equal scores, the one whose last pieces are longest."""
        n, cost = len(part), self.cost
        score, back = [0.0] * (n + 1), [(1, -1)] * (n + 1)
        known = 0  # score[:known + 1] is set; later ends are larger, so earlier ones are final
        for end, (size, s, i) in self.automaton.iter(part):
            end += 1
            while known < end:
                score[known + 1] = score[known] + cost
                known += 1
            s += score[end - size]
            if s > score[end]:
                score[end], back[end] = s, (size, i)
        out: list[int] = []
        while n:
            size, i = back[n]
            out.extend([i] if i >= 0 else reversed(self.spell(part[n - 1])))
            n -= size
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        seen, out = self.seen, []
        for part in self.parts.findall(MARK + text.replace(MARK, OWN).replace(" ", MARK)):
            ids = seen.get(part)
            if ids is None:
                ids = self.best(part)
                if len(part) <= SHORT:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[part] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode()


_coders: dict[int, Coder] = {}


def _coder(vocabulary) -> Coder:
    """One coder for each broadcast vocabulary and worker."""
    key = id(vocabulary.value)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary.value)
    return _coders[key]


def encode(docs: DataFrame, path: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """`docs` with `ids array<int>`, `n_tokens`, `n_bytes` (ids that are bytes) and `round_trip`, whether decoding gives the text again."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(likelihoods(load(path)))
    added = ["ids", "n_tokens", "n_bytes", "round_trip"]
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*kept)
    names = [*kept, *added]
    at = kept.index(text_col)
    types = ["array<int>", "long", "long", "boolean"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), *(f"{c} {t}" for c, t in zip(added, types, strict=True))])

    def run(batches):
        coder = _coder(vocabulary)
        low, high = min(coder.byte), max(coder.byte)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                ids, n, spelled, good = [], [], [], []
                for text in batch.column(at).to_pylist():
                    found = None if text is None else coder.encode(text)
                    at_ids = np.array(found or (), np.int32)
                    ids.append(at_ids)
                    n.append(len(at_ids))
                    spelled.append(int(((at_ids >= low) & (at_ids <= high)).sum()))
                    good.append(text is None or not check or coder.decode(found) == text)
                offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(ids)), mask=batch.column(at).is_null())
                columns = [lists, pa.array(n, pa.int64()), pa.array(spelled, pa.int64()), pa.array(good, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with `decoded`, the text of the ids; null ids give null."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(likelihoods(load(path)))
    kept = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(*kept)
    at = kept.index(ids_col)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in encoded.dtypes), "decoded string"])

    def run(batches):
        coder = _coder(vocabulary)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return encoded.mapInArrow(run, schema)
