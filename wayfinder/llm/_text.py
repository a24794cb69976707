"""Words of Arrow text columns as numpy arrays: places, hashes and windows, a bounded chunk at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled by itself.
CHUNK = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_state: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int, base: int, key: str) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64, kept for later calls."""
    have = _state.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 8)
        have = np.ones(size, U64)
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _state[key] = have
    return have[:n]


def polynomial(values: np.ndarray, base: int, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers, so that (sums[b] - sums[a]) * inverse[a] is a hash of values[a:b] alone."""
    n = len(values)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * _powers(n, base, key), out=sums[1:])
    return sums, _powers(n + 1, pow(base, -1, 1 << 64), f"1/{key}")


#: Keys of the two word names; fixed, of no structure.
_KEYS = (U64(0x8F3A1C6D5B27E409), U64(0x2D94E7B10C86F35B))


class Words:
    """The words of some texts: `start` and `end` bytes in `data`, and `offset`, by which text k has words offset[k] to offset[k + 1].

    `hash`: a quick one, for models. `names`: two independent ones of 64 bits, which decide what is equal.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, fold: bool):
        self.data = data
        word = ~_SPACE[data]
        before, after = np.empty_like(word), np.empty_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        filled = offs[:-1] < offs[1:]
        before[offs[:-1][filled]] = False
        after[offs[1:][filled] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.offset = np.searchsorted(self.start, offs)
        self.fold = fold

    @cached_property
    def hash(self) -> np.ndarray:
        sums, inverse = polynomial((_FOLDED if self.fold else _VALUE)[self.data], _BASE, "bytes")
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    @cached_property
    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word eight bytes after the other through a keyed scrambling, twice with keys of their own.

        A step is a bijection of what came before and of the eight bytes each, so words of up to
        eight bytes never share a name with another of their length, and longer ones meet as random
        numbers do; no sum or power of two lets unlike words cancel out.
        """
        size = self.end - self.start
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[: len(self.data)] = _LOWER[self.data] if self.fold else self.data
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        out = [mix(size.astype(U64) + k) for k in _KEYS]
        at, rows = 0, np.arange(len(size))
        while len(rows):
            left = size[rows] - at
            part = eight[self.start[rows] + at]
            part &= ~U64(0) >> (U64(8) * (U64(8) - np.minimum(left, 8).astype(U64)))
            for h, k in zip(out, _KEYS, strict=True):
                h[rows] = mix((h[rows] * k) ^ mix(part + k))
            at += 8
            rows = rows[left > 8]
        return out[0], out[1]

    def pieces(self) -> pa.Array:
        """The words themselves, folded if asked."""
        data = _LOWER[self.data] if self.fold else self.data
        size = self.end - self.start
        offs = np.concatenate([[0], np.cumsum(size)])
        held = data[np.arange(offs[-1]) - np.repeat(offs[:-1] - self.start, size)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(held)])

    def text(self, keep: np.ndarray) -> bytes:
        """The words at the places `keep`, joined by one space."""
        data = self.data
        return b" ".join([data[a:b].tobytes() for a, b in zip(self.start[keep].tolist(), self.end[keep].tolist(), strict=True)])


def chunks(texts: pa.Array, fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of pieces of a string column; nulls count as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1)
        b = min(b, len(texts))
        own = offs[a : b + 1]
        yield a, b, Words(data[own[0] : own[-1]], own - own[0], fold)
        a = b


def windows(names: np.ndarray, size: int, key: int) -> np.ndarray:
    """A name for each run of `size` words, by its first: runs of one, two, four words and so on are named after their halves.

    Every step scrambles, so names of unlike runs meet as random numbers do.
    """
    k = _KEYS[key]
    out, done, half, step = None, 0, names, 1
    n = len(names) - size + 1
    while n > 0:
        if size & step:
            part = half[done : done + n]
            out = part if out is None else mix(mix(out + k) * k + part)
            done += step
        step *= 2
        if step > size:
            break
        half = mix(mix(half[: len(half) - step // 2] + k) * k + half[step // 2 :])
    return np.zeros(0, U64) if out is None else out


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text by name, in order, a second name of each, and their offsets.

    A text of fewer words has its whole sequence as the only shingle; one without words has none.
    """
    n = np.diff(w.offset)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    offs = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(offs[-1]) - np.repeat(offs[:-1], count) + np.repeat(w.offset[:-1], count)
    length = np.minimum(np.repeat(n, count), k)
    both = []
    for key, names in enumerate(w.names):
        out = mix(length.astype(U64) + _KEYS[key])
        for j in range(k):
            there = first + np.minimum(j, length - 1)
            out = np.where(j < length, mix(out * _KEYS[key] + names[there]), out)
        both.append(out)
    out, other = both
    ends = offs.tolist()
    order = np.arange(len(out))
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a > 1:
            order[a:b] = a + np.argsort(out[a:b])
    out, other = out[order], other[order]
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[offs[:-1][count > 0]] = True
    places = np.concatenate([[0], np.cumsum(new)])
    return out[new], other[new], places[offs]
