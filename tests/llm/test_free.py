"""The operators with Python inside, against brute force on awkward rows."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfinder.llm import _shared, embedding, neardup, pieces, substring, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def parts(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_texts():
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = []
    for n in (20, 60, 150):
        base = new(n)
        out.append(" ".join(base))
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(n)] = f"w{rng.randrange(5000)}"
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    return out + [" ".join(new(40)) for _ in range(10)] + ["a b c", "A B\tc", "a", "", None, " \n", "x " * 2000, "É é", "é É"]


def test_near_duplicates(spark, monkeypatch):
    texts = near_texts()
    rows = [(k * 3, t, "clash") for k, t in enumerate(texts)] + [(None, texts[0], ""), (0, texts[0], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    sets = {}
    for k, t, _ in rows[: len(texts)]:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[k] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = parts(sets, links)
    # the second deals groups out to several blocks and takes the ways of large tables
    for block, few, edges in ((1024, 400_000, 1 << 20), (4, 0, 0)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", few)
        monkeypatch.setattr(_shared, "TASK_EDGES", edges)
        got = neardup.link(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(sets[r["doc_id"]])), r
                assert r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    left = neardup.deduplicate(docs, shingle=4)
    assert left.columns == docs.columns and left.count() == len(set(want.values())) + 1
    assert neardup.link(docs.limit(0)).count() == 0


def test_candidates_join_all_that_sketches_allow(spark, monkeypatch):
    from wayfinder.llm._shared import Scratch

    rng = random.Random(12)
    bits = 64 * neardup.SKETCH
    flip = lambda s, n: s ^ sum(1 << b for b in rng.sample(range(bits), n))
    sketch, bands = {}, {}
    for k in range(120):  # chains of texts, each near to the one before and far from those further back
        sketch[k] = flip(sketch[k - 1], neardup.MOST_BITS * 9 // 10) if k % 6 else rng.getrandbits(bits)
        bands[k] = [k // 12, 100 + k // 40]
    links = [(a, b) for a in sketch for b in sketch if a < b and set(bands[a]) & set(bands[b]) and (sketch[a] ^ sketch[b]).bit_count() <= neardup.MOST_BITS]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, bands[k], *(signed(sketch[k] >> 64 * i & (1 << 64) - 1) for i in range(neardup.SKETCH))) for k in sketch]
    nodes = spark.createDataFrame(rows, "node long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(neardup.SKETCH)))
    for block in (4096, 3):
        monkeypatch.setattr(neardup, "SKETCH_BLOCK", block)
        got = {tuple(sorted((r["a"], r["b"]))) for r in neardup._candidates(nodes, Scratch(spark, "test")).collect()}
        assert got <= set(links) and parts(sketch, got) == parts(sketch, links)


def test_unlike_rows_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(7, a, "z"), (7, b, "x"), (7, b.upper(), "w"), (7, a, "y"), (8, a + " more", "v"), (9, c, "u"), (3, b, "t"), (None, a, "s"), (None, a, "s")]
    want = [(3, b, "t"), (7, a, "y"), (9, c, "u"), (None, a, "s"), (None, a, "s")]
    for parted in (1, 4):
        docs = spark.createDataFrame(rows[::-1] if parted > 1 else rows, "doc_id long, text string, kept string").repartition(parted)
        assert sorted(map(str, map(tuple, neardup.deduplicate(docs, shingle=4).collect()))) == sorted(map(str, want))


def test_substrings(spark, monkeypatch):
    rng = random.Random(2)
    new = lambda n, top=4000: [f"v{rng.randrange(top)}" for _ in range(n)]
    shared, short, run = new(70), new(49), ["same"] * 120
    texts = [" ".join(new(rng.randrange(5, 300))) for _ in range(12)]
    texts += [" ".join(new(rng.randrange(0, 60)) + p + new(rng.randrange(0, 60))) for p in (shared, shared, shared[3:55], short, short, run, run[:77], run[:49], shared[10:60])]
    texts += [" ".join(new(20_000) + shared + new(9_000, 50))]
    texts += [" ".join(new(80, 3)), " ".join(new(400, 2)), " ".join(new(400, 2)), texts[0], texts[0] + " tail", " ".join(shared), "  ".join(shared), "", None, " ", "a b"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(order[k], t, 1) for k, t in enumerate(texts)] + [(None, " ".join(shared), 1), (order[3], " ".join(shared) + " new text", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    first, words = {}, {}
    for k, (d, t, _) in enumerate(rows):
        words[k] = WORD.findall(t or "")
        for i in range(len(words[k]) - 49):
            key = tuple(words[k][i : i + 50])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    want = []
    for k, (d, _, _) in enumerate(rows):
        w, gone = words[k], set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert sum(x[2] for x in want) > 300
    for few, heavy in ((1_000_000, 1000), (1_000_000, 1), (0, 1)):  # frequent names, and the ways of large tables
        monkeypatch.setattr(substring, "BROADCAST_ROWS", few)
        monkeypatch.setattr(substring, "HEAVY", heavy)
        got = substring.repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert substring.repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring.repeats(docs, window=40)


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = []
    for _ in range(12):
        c = rng.standard_normal(64)
        c /= np.linalg.norm(c)
        v += [c + rng.standard_normal(64) * s / 8 for s in rng.uniform(0.02, 0.35, 12)]
    v += [rng.standard_normal(64) for _ in range(60)] + [v[0], v[0] * 3.5, np.zeros(64), np.full(64, np.nan), np.ones(3), np.ones(3) * 2]
    rows = [(k, [float(x) for x in x], "clash") for k, x in enumerate(v)] + [(900, None, ""), (901, [], ""), (902, [None, 1.0], ""), (None, [float(x) for x in v[0]], "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")
    ok = {k: np.array(x) for k, x, _ in rows if k is not None and k < 900 and np.isfinite(x).all() and np.any(x)}
    unit = {k: x / np.linalg.norm(x) for k, x in ok.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want = parts([r[0] for r in rows if r[0] is not None], links)
    null = [k for k in unit if len(unit[k]) == 64 and unit[k] @ unit[0] >= 0.95]
    n = {k: sum(k in x for x in links) + (k in null) for k in want}
    for block in (2048, 16):
        monkeypatch.setattr(embedding, "BLOCK", block)
        got = embedding.link(table).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["vec_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["component_id"], r["n_links"], r["kept"]) == (want[r["vec_id"]], n[r["vec_id"]], want[r["vec_id"]] == r["vec_id"]), r
    assert embedding.link(table.limit(0)).count() == 0


def test_recall_is_calibrated():
    for n in (100, 50_000, 10**9):
        g, tables, count = embedding.calibrate(n, 0.95)
        assert g >= 1 and 1 <= count < embedding.COUNTED and tables < 2000
        # pairs at just the least similarity, with the settings of n vectors
        rng = np.random.default_rng(n % 97)
        a = rng.standard_normal((4000, 64))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b = rng.standard_normal((4000, 64))
        b -= (a * b).sum(axis=1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * b
        space = embedding.Space(64, g, tables, 0.95)
        assert (space.keys(a) == space.keys(b)).any(axis=1).mean() > 0.995
        near = np.abs(space.marks(a).astype(int) - space.marks(b)) <= embedding.STEPS
        assert (near.sum(axis=1) >= count).all()


def test_collisions_are_counted():
    rng = np.random.default_rng(2)
    for n in (2, 63, 64, 65, 300):
        marks = rng.integers(40, 80, (n, embedding.COUNTED)).astype(np.uint8)
        marks[0], marks[-1] = 0, embedding.LEVELS - 1
        both = (np.abs(marks[:, None].astype(int) - marks[None]) <= embedding.STEPS).sum(axis=2)
        ask = np.arange(0, n, 2)
        for count in (1, 14, 17, 31, 32):
            got = {(int(x), int(y)) for xs, ys in embedding.candidates(marks, ask, count, tile=32) for x, y in zip(xs, ys, strict=True)}
            assert got == {(int(x), int(y)) for x in ask for y in np.flatnonzero(both[x] >= count)}


def test_embeddings_without_ids(spark):
    rng = np.random.default_rng(9)
    a, far = rng.standard_normal(64), rng.standard_normal(64)
    b = a + rng.standard_normal(64) * 0.02
    rows = [(7, a), (3, a * 2), (None, b), (None, b), (7, far), (12, far * 1.001), (8, np.zeros(64))]
    table = spark.createDataFrame([(k, [float(x) for x in v], 1) for k, v in rows], "vec_id long, embedding array<double>, n_links int")
    for few in (10, 0):
        embedding.BROADCAST_ROWS, old = few, embedding.BROADCAST_ROWS
        got = sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["n_links"], r["component_id"]) for r in embedding.link(table).collect())
        embedding.BROADCAST_ROWS = old
        # the vector that only null ids hold links with both copies; id 7 is a node with the links of its two vectors
        assert [x[1:] for x in got[:5]] == [(3, 3), (4, 3), (4, 3), (0, 8), (1, 3)]


TEXTS = ["", None, " ", "\n\t", "Hello  world", "▁ mark ▁▁", "日本語 ok", "É\u0000\x07", "\U0001f600 emoji", "a" * 9000, " lead and trail ", "Ünïcödé\r\nline", "été " * 500]


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    out = pieces.encode(docs, VOCABULARY)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(TEXTS) and all(r["round_trip"] for r in rows.values())
    assert rows[0]["ids"] == [] and rows[1]["ids"] is None and rows[1]["n_tokens"] == 0
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(out, VOCABULARY).collect()}
    assert back == dict(enumerate(TEXTS))
    assert pieces.encode(docs.limit(0), VOCABULARY).count() == 0
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=VOCABULARY)
    assert own.decode(rows[4]["ids"]) == TEXTS[4] and own.decode(rows[12]["ids"]).strip() == TEXTS[12].strip()


def best_score(text, vocabulary, coder):
    """The greatest sum of scores over all segmentations of a text, and the bytes that no piece covers."""
    score = {t: s for t, s, k in vocabulary if k == "piece"}
    longest = max(map(len, score))
    best = [0.0]
    for j in range(1, len(text) + 1):
        best.append(max([best[j - 1] + coder.cost] + [best[i] + score[text[i:j]] for i in range(max(0, j - longest), j) if text[i:j] in score]))
    bare = [c for c in text if c not in score]
    return best[-1], sum(len({pieces.OWN: pieces.MARK, pieces.MARK: " "}.get(c, c).encode()) for c in bare), len(bare)


def test_pieces_are_the_best():
    vocabulary = pieces.likelihoods(pieces.load(VOCABULARY))
    assert all(-25 < s < 0 for _, s, k in vocabulary if k == "piece")
    assert pieces.likelihoods([("a", -1.5, "piece"), ("b", -2.0, "piece")])[0][1] == -1.5  # likelihoods stay
    coder = pieces.Coder(vocabulary)
    rng = random.Random(1)
    whole = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"].dropna().tolist()
    whole = [t for t in whole if len(t) < 9000][::6] + [t for t in TEXTS if t]
    fragments = ["".join(rng.choice("abcdefghinorst\né日") for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    for text in fragments + whole:
        marked = pieces.MARK + text.replace(pieces.MARK, pieces.OWN).replace(" ", pieces.MARK)
        want, spelled, bare = best_score(marked, vocabulary, coder)
        found = [vocabulary[i] for i in coder.encode(text)]
        assert sum(k == "byte" for _, _, k in found) == spelled
        assert sum(s for _, s, k in found if k == "piece") + bare * coder.cost == pytest.approx(want)


def test_pieces_of_repeated_rows(spark):
    docs = spark.createDataFrame([(k, "tie tie Hello world", "x") for k in range(6)], "doc_id long, text string, n_tokens string")
    rows = pieces.encode(docs, VOCABULARY).collect()
    assert len(rows) == 6 and len({tuple(r["ids"]) for r in rows}) == 1 and {r["n_tokens"] for r in rows} == {len(rows[0]["ids"])}


def test_toxicity(spark):
    rng = random.Random(8)
    rows = []
    for k in range(700):
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))]
        bad = k % 8 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["zorky", "Vexlum", "quabber", "mizzle"]) + rng.choice(["", "ing", "."])
        rows.append((k, " ".join(w), "en" if k % 3 else None, int(bad)))
    docs = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows] + [(9000, None, "en"), (9001, "", None), (None, "x", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(a, t) for a, _, _, t in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("id") % 4 != 2)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(a, t) for a, _, _, t in rows if a % 4 == 2]
    assert np.mean([(got[a]["score"] >= 0.3) == bool(t) for a, t in held]) > 0.95
    assert got[9000]["score"] == got[9001]["score"] < 0.3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_forward_pass():
    """Scores against the same arithmetic word by word, with every table, filter, pool and layer spelled out."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    m = toxicity.Model()
    m.tables = rng.normal(0, 0.5, m.tables.shape).astype(np.float32)
    m.filters = [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    m.shift, m.last, m.bias = rng.normal(0, 0.3, m.shift.shape).astype(np.float32), rng.normal(0, 0.3, m.last.shape).astype(np.float32), 0.2
    alike = "INTERNAL international internal internals poisonous poisoning"
    texts = ["", None, " \n", "one", "two words", alike, "日本語 пример é " * 5, "tie tie tie tie", "w " * 60_000 + "z"]
    got, rows = [], []
    for a, b, w in toxicity.chunks(pa.array(texts)):
        at = toxicity.slots(w)
        got += m.scores(at, w.offset).tolist()
        rows += [at[w.offset[k] : w.offset[k + 1]] for k in range(b - a)]
    five = rows[5]
    assert (five[0] == five[2]).all() and (five[1] != five[2]).any() and (five[4, :-1] == five[5, :-1]).all() and five[4, -1] != five[5, -1]
    for k, at in enumerate(rows):
        e = [sum(m.tables[j, s] for j, s in enumerate(word)) for word in at]
        z = m.bias
        for j, f in enumerate(m.filters):
            for q in range(toxicity.FILTERS):
                if e:
                    top = max(sum(float(e[i + d] @ f[d, :, q]) for d in range(len(f)) if i + d < len(e)) for i in (range(len(e)) if len(e) < 100 else [0, 1, len(e) - 3, len(e) - 2, len(e) - 1]))
                    z += m.last[j * toxicity.FILTERS + q] * max(0.0, top + m.shift[j * toxicity.FILTERS + q])
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5), texts[k]


def test_toxicity_of_repeated_rows(spark):
    rows = [(k, ("vile " if k % 5 == 0 else "nice ") + f"word{k} " * 30, "en") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("flagged", F.lit(1))
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    many = toxicity.fit(docs.unionByName(docs).unionByName(docs.where("doc_id < 9")), labels)
    assert all((a == b).all() for a, b in zip(model.filters, many.filters, strict=True)) and (model.tables == many.tables).all()
    got = toxicity.score(docs.unionByName(docs), model)
    assert got.columns == ["doc_id", "lang", "score", "threshold", "flagged"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(v) == 1 for v in by_id.values()) and len(by_id) == 200


def test_toxicity_reads_whole_words():
    import pyarrow as pa

    rng = random.Random(9)
    texts, toxic = [], []
    for k in range(800):
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(rng.randrange(20, 80))]
        for _ in range(2):
            w[rng.randrange(len(w))] = rng.choice(["achkeiter", "Пелиратор"] if k % 4 == 0 else ["achkeit", "пелирать", "Пелира"])
        texts.append(" ".join(w))
        toxic.append(int(k % 4 == 0))
    y = np.array(toxic)
    model = toxicity.train(pa.array(texts[:600]), y[:600], np.ones(600))
    scores = np.concatenate([model.scores(toxicity.slots(w), w.offset) for _, _, w in toxicity.chunks(pa.array(texts[600:]))])
    assert np.mean((scores >= 0.3) == y[600:]) > 0.95


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_unlike_words_are_never_taken_for_equal(spark):
    """A word and its complement whose difference any polynomial modulo a power of two loses."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    plain = [f"p{k}" for k in range(49)]
    docs = spark.createDataFrame([(1, " ".join([*plain, one])), (2, " ".join([*plain, other])), (3, " ".join([*plain, other]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.repeats(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    rows = [(1, f"{one} x y z"), (2, f"{other} x y z"), (3, f"{other.upper()} X y z"), (4, one), (5, other)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}
    # sequences of words in that order, as shingles and as windows
    turns = [thue_morse(64).replace("a", "u ").replace("b", "v "), thue_morse(64).replace("a", "v ").replace("b", "u ")]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(turns)], "doc_id long, text string")
    words = [t.split() for t in turns]
    starts = {tuple(words[0][i : i + 50]) for i in range(15)}
    gone = {p for i in range(15) if tuple(words[1][i : i + 50]) in starts for p in range(i, i + 50)}
    assert {r["doc_id"]: r["n_removed"] for r in substring.repeats(docs).collect()} == {0: 0, 1: len(gone)}


def test_names_are_of_whole_words():
    import pyarrow as pa

    from wayfinder.llm._text import chunks

    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abAB漢") for _ in range(rng.randrange(1, 40))) for _ in range(3000)} | {"a" * n for n in range(1, 70)} | {"é" * 5000})
    for fold in (False, True):
        (_, _, w), *more = chunks(pa.array([" ".join(words)]), fold)
        assert not more
        real = ["".join(c.lower() if fold and c.isascii() else c for c in x) for x in words]
        assert [x.decode() for x in w.pieces().to_pylist()] == real
        for names in w.names:
            by = {}
            for x, h in zip(real, names.tolist(), strict=True):
                assert by.setdefault(h, x) == x
            assert len(by) == len(set(real))
