import hashlib

import numpy as np
from pyspark.sql import functions as F

from wayfinder.llm import toxicity


def test_all_labels_are_learned_from(spark, monkeypatch):
    """Words that only the last labelled documents by MD5 have are learned as well, however the rows are dealt."""
    ids = sorted(range(8000), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    bad = [k for k in ids if k % 4 == 0]
    word = {k: "zorky" if n < 1500 else "vexlum" for n, k in enumerate(bad)}
    rows = [(k, f"word{k % 97} some{k % 89} {word.get(k, f'nice{k % 31}')} more{k % 83}", "en" if k % 3 else None) for k in ids]
    more = [(9000, "word1 some2 vexlum more3", "en"), (9001, "word1 some2 nice3 more3", "en"), (9002, "", None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(8000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "PACK", 1000)
    model = toxicity.fit(docs, labels, F.col("id") < 8000)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[9000]["score"] >= 0.3 > max(got[9001]["score"], got[9002]["score"])
    assert np.mean([(got[k]["score"] >= 0.3) == (k % 4 == 0) for k in ids]) > 0.99
    again = toxicity.fit(docs.repartition(7), labels.repartition(5), F.col("id") < 8000)
    assert (model.tables == again.tables).all() and (model.last == again.last).all() and model.thresholds == again.thresholds


def test_packs_follow_keys_and_bytes(monkeypatch):
    import pyarrow as pa

    schema = ["pack", "text", "toxic"]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=schema)
    monkeypatch.setattr(toxicity, "PACK_BYTES", 8)
    rows = [(0, "ab", 0), (0, "cd", 1), (2, "e" * 20, 1), (2, "f", 0), (2, "gh", 0), (3, "", 1), (3, "i", 0), (5, "j", 1)]
    want = None
    for cut in range(1, len(rows)):
        got = [(p, t.to_pylist(), y.tolist()) for p, t, y in toxicity._packs(iter([batch(rows[:cut]), batch(rows[cut:])]))]
        assert [(p, x, y) for p, t, z in got for x, y in zip(t, z, strict=True)] == rows
        assert want in (None, got)
        want = got
    assert [p for p, _, _ in want] == [0, 2, 2, 3, 5]
