"""Texts are dealt before they are folded, and folded once; no task holds more terms than its share."""

import math
import random
import unicodedata

from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.operators import lexical
from wayfinder.plans.q_text import texts
from wayfinder.sources.domain import World

SF = "/root/testdata/sf0.001"


def test_slugs_fold_a_text_once(spark):
    assert spark.range(1).select(text.slugify(F.lit("Crème  Brûlée!"))).first()[0] == "cr-me-br-l-e"
    plan = World(spark, SF).table("documents").select(text.slugify(F.col("text")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array(text") == 1


def test_calm_and_loud_characters_fold_together(spark):
    rng, some = random.Random(5), "aeéAﬁ한\u0323\u031b\u0301\u1161\u11a8\u1100Ａ…漢 \u00a0"
    rows = [(k, "".join(rng.choice(some) for _ in range(rng.randrange(1, 14)))) for k in range(2000)]
    got = spark.createDataFrame(rows, "k long, t string").select("t", text.fold_compatibility(F.col("t")).alias("f")).collect()
    assert all(r["f"] == unicodedata.normalize("NFKC", r["t"]) for r in got)
    assert spark.range(1).select(F.lit("Crème Brûlée 漢字").rlike(f"[^{text._calm(text._Unicode())}]")).first()[0] is False


def test_documents_are_dealt_by_id(spark):
    assert "hashpartitioning(doc_id" in texts(World(spark, SF))._jdf.queryExecution().executedPlan().toString()


def test_a_task_holds_a_bounded_share_of_terms(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART_BYTES", 100)
    monkeypatch.setattr(lexical, "COMMON", 2)
    rows = spark.createDataFrame([(k, f"in town {k % 7} {k} {k}") for k in range(100)], "k long, t string")
    found = lexical.terms(rows, "k", F.col("t"))
    assert "hashpartitioning(k" in (plan := found._jdf.queryExecution().executedPlan().toString()) and f", {lexical.parts(rows, F.col('t'))})" in plan.replace(", REPARTITION_BY_NUM", ")")
    idfs = lexical.idf(found, "k")
    want = {(r["k"], r["term"]): (1 + math.log(r["tf"])) * r["idf"] for r in found.join(idfs, "term").collect()}
    got = {(r["k"], r["term"]): r["w"] for r in lexical.weigh(found, idfs).collect()}
    assert got.keys() == want.keys() and len(got) > 300 and all(math.isclose(got[x], want[x]) for x in want)
