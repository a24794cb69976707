"""The registered corpus queries against their SQL, and the whole pipeline against its stages."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from wayfinder.llm import registry

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    cursor = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in order]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "ids", "n_tokens", "n_bytes", "round_trip"]
    rows = out.collect()
    kept = {r["doc_id"]: r for r in registry.op8_quality(spark, SF).collect() if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    sets = {k: shingles(t) for k, t in texts.items()}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    one = {k for k in sets if root(k) == k}
    spans = {r["doc_id"]: r["spans"] for r in registry.op9_secrets(spark, SF).collect()}
    times = Counter(r["doc_id"] for r in rows)
    assert set(times) <= one and max(times.values()) <= 2
    size = {k: len(WORD.findall(texts[k])) for k in one}
    by_source = Counter()
    for r in rows:
        by_source[r["source"]] += size[r["doc_id"]]
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert (r["text"] == texts[r["doc_id"]]) == (not spans[r["doc_id"]])
    # about one and a half times the words, no source beyond twice its own
    assert abs(sum(by_source.values()) / sum(size.values()) - 1.5) < 0.1
    again = corpus_pipeline.run(spark, SF).collect()
    mark = lambda rows: hashlib.sha256("\n".join(sorted(map(str, rows))).encode()).hexdigest()
    assert mark(rows) == mark(again)
