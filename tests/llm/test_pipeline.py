"""The stages of the pipeline on small tables, each against what it must do to its own input."""

import re
from collections import Counter

import corpus_pipeline
from wayfinder.llm import mixing, registry

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages(spark):
    rows = []
    for k in range(40):
        rows.append((k, " ".join(f"w{k * 1000 + i}" for i in range(80)), "en", f"s{k % 3}", 0, "extra"))
    rows += [(100, rows[0][1], "en", "s0", 0, "copy"), (101, "short", "en", "s1", 0, ""), (102, None, None, None, None, None), (103, rows[1][1] + " token = abcdef123456", "en", "s1", 0, "")]
    rows += [(104, "token = abcdef123456 " + " ".join(f"q{i}" for i in range(90)), "en", "s1", 3, "secret")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "secret scans", "mixing to target weights", "sentencepiece encoding"]
    sf = "/root/testdata/sf0.001"
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {*range(40), 100, 103, 104}
    two = corpus_pipeline.near_duplicates(spark, one, sf)
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == {*range(40), 104}
    three = corpus_pipeline.secret_scan(spark, two, sf)
    text = {r["doc_id"]: r for r in three.collect()}
    assert three.columns == docs.columns and "abcdef123456" not in text[104]["text"] and text[104]["n_chars"] == len(text[104]["text"]) and text[3]["text"] == rows[3][1]
    four = corpus_pipeline.mixing_weights(spark, three, sf)
    size = {}
    for r in four.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert four.columns == docs.columns and set(size) == {"s0", "s1", "s2"}
    five = corpus_pipeline.piece_encoding(spark, four, sf)
    assert five.count() == four.count() and five.where("not round_trip").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_mixing_weighs_quality(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))

    def times(weights):
        return {r["id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.plan_mix(docs, weights).collect() if r["size"]}

    want = times(mixing.quality_weights(labels))
    assert want != times(None)
    for few in (400_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_WEIGHTS", few)
        got = Counter(r["doc_id"] for r in corpus_pipeline.mixing_weights(spark, docs, sf).collect())
        assert got == {k: n for k, n in want.items() if n}


def test_queries_have_sql():
    assert set(registry.oracle_sql()) < set(registry.queries())
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in registry.queries() if q != "pipeline"} == set(range(1, 11))
