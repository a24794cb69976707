"""Packing, the prefix trie and centroid clustering against brute force on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfinder.llm import centroids, packing, prefix_trie

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def pieces_are_whole(rows, docs, tokenizer):
    """Checks that pieces give every document and every sequence without a gap; the padding."""
    held, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        held[r["doc_id"], r["doc_tokens"]].append(r)
    want = defaultdict(list)
    for k, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[k, len(ids)].append(ids)
    assert set(held) == set(want)
    for key, found in held.items():
        # rows of one id and length: the pieces with one start are as many as the documents
        by = defaultdict(list)
        for r in found:
            by[r["start"]].append(r)
        texts = sorted(np.array(x, "<u4").tobytes() for x in want[key])
        if len(texts) == 1:
            assert b"".join(bytes(by[s][0]["ids"]) for s in sorted(by)) == texts[0]
        assert sum(r["length"] for r in found) == key[1] * len(texts)
        assert all(zlib.crc32(bytes(r["ids"])) == r["crc"] and len(r["ids"]) == 4 * r["length"] for r in found)
    padding = 0
    assert sorted(sequences) == list(range(len(sequences)))
    for rows_ in sequences.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= packing.SIZE
        padding += packing.SIZE - at if at & (at - 1) else 0
    return padding


def test_packing(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß漢 \n\t' 　") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    texts += ["", None, " ", "\n", "x " * 30_000, "y" * 5_000, "a  <|endoftext|> b", "same text here", "same text here", "\x00\x1c\x85 ends with space "]
    rows = [(k, t, 1, "key") for k, t in enumerate(texts)] + [(None, "no id", 2, "ids"), (3, texts[3], 3, ""), (3, texts[3], 3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `offset` int, row string").repartition(5)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    out = packing.pack(docs, VOCABULARY).withColumn("crc", F.crc32("ids"))
    found = out.collect()
    assert pieces_are_whole(found, [(r[0], r[1]) for r in rows], tokenizer) == 0
    # reruns agree, however the rows are dealt out
    again = packing.pack(docs.repartition(2), VOCABULARY).withColumn("crc", F.crc32("ids")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    import sys

    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "a", "ab", "1", "!", "'s", "'", "é", "　", "\xa0", "\t", "\r", "<|endoftext|>", "\x1c", "\x85", "漢", "​", "😀", " x", "long" * 20, ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(5000)]
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{c}b 1{c} {c}2!{c}! {c}{c}  {c}\n" for c in chars[k : k + 100]) for k in range(0, len(chars), 100)]
    texts += ["y" * 100_000, " " * 100_000, "x " * 200_000]
    with open(VOCABULARY) as f:
        encoder = packing.Encoder(f.read())
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [encoder.encode(t) for t in texts] == want


@pytest.mark.parametrize("bits, n", [(1, 2), (3, 2), (2, 4), (3, 3)])
def test_hilbert_curve_visits_all_places_by_single_steps(bits, n):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
    order = np.argsort(packing.hilbert(points, bits))
    assert sorted(packing.hilbert(points, bits)) == list(range(len(points)))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_like_documents_are_neighbours():
    rng = random.Random(3)
    topics = [[rng.randrange(50_000) for _ in range(60)] for _ in range(8)]
    topic = [k % 8 for k in range(400)]
    ids = [[rng.choice(topics[t]) for _ in range(200)] for t in topic]
    keys = packing.keys(np.concatenate(ids), np.array([200] * 400))
    order = np.argsort(keys, kind="stable").tolist()
    beside = sum(topic[a] == topic[b] for a, b in zip(order, order[1:], strict=False))
    assert beside > 300  # by chance about 50


def brute_trie(rows):
    """Nodes of the trie of (conv_id, turn, role, text) rows, by walking all of them."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in by.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if all(len(paths[c]) == len(x) for c in members[x])]
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below), len(leaves),
                    sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_prefix_trie(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 40), 100, 101, 102, 163, 177, 250, -5, -130, 10_000_000_000]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long 漢 text"])))
    rows += [(7, 3, "user", "twice"), (7, 3, "user", "twice"), (7, 3, "user", "tie"), (None, 1, "user", "none"), (55, 1, "user", "x" * 50_000)]
    rows += [(c, t, "user", "copy") for c in range(300, 360) for t in range(4)]  # a group of copies
    rows += [(77, t, "user", f"turn {t % 3}") for t in range(700)]  # one conversation of most turns
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    want = sorted(map(str, brute_trie(rows)))
    for size, piece in ((50_000, 1 << 16), (40, 8)):  # the second carries sums over many ranges and digests over many pieces
        monkeypatch.setattr(prefix_trie, "RANGE_ROWS", size)
        monkeypatch.setattr(prefix_trie, "PIECE", piece)
        assert sorted(str(tuple(r)) for r in prefix_trie.trie(turns).collect()) == want
    assert prefix_trie.trie(turns.limit(0)).count() == 0


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        mine = defaultdict(list)
        for (_, n), (_, v) in zip(assign(), kept, strict=True):
            mine[n].append(v)
        centres = [[sum(x) // len(mine[n]) for x in zip(*mine[n], strict=True)] if n in mine else c for n, c in enumerate(centres)]
    at = assign()
    inertia = defaultdict(int)
    for d, n in at:
        inertia[n] += d
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, at, strict=True)]


@pytest.mark.parametrize("k, large", [(40, False), (7, True), (40, True)])
def test_centroids(spark, k, large):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, (150, 64)).round(2)
    x[50:90] = x[50]  # equal vectors
    x[90:100] = 0
    if large:
        x[100:103] *= 1e6
        x[103:105] *= 1e7
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [*[0.5] * 63, None], [*[0.5] * 63, float("nan")], [*[0.5] * 63, float("inf")]]
    rows += [(200 + i, v) for i, v in enumerate(odd)] + [(None, x[3].tolist()), (5, x[5].tolist()), (5, x[6].tolist())]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = centroids.cluster(vectors, k=k)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_clusters(rows, k, 5)))
    few = [r for r in rows if r[0] in (1, 2, 3, 204)]
    got = centroids.cluster(vectors.where("vec_id in (1, 2, 3, 204)"), k=k)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_clusters(few, k, 5)))
    assert centroids.cluster(vectors.limit(0)).count() == 0


def test_distances_beyond_64_bits_are_null(spark):
    rows = [(1, [1e30] * 64), (2, [-1e30] * 64), (3, [0.0] * 64), (4, [1.0] * 64)]
    got = {r["vec_id"]: r for r in centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()}
    want = {r[0]: r for r in brute_clusters(rows, 2, 5)}
    fit = lambda d: d if d <= centroids.LONG else None
    for i, r in got.items():
        assert r["cluster"] == want[i][1] and r["distance"] == fit(want[i][2]) and r["centroid_sha256"] == want[i][5]
