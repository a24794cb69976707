"""Scalar functions against a table of values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from wayfinder.functions import geo, text

CASES = [
    (text.slugify, "Mr. Chen's Home Inn", "mr-chen-s-home-inn"),
    (text.slugify, "***", "na"),
    (text.tokenize, "故宫 A1-b2", ["故", "宫", "a1", "b2"]),
    (text.parse_budget, "a budget of $4100.50", 4100.5),
    (text.parse_budget, "a budget of ¥4100", None),
    (text.parse_meal_range, "meal costs ranging from 120 to 60", (60.0, 120.0)),
    (text.parse_meal_range, "meal cost over 100", (100.0, 2147483647.0)),
    (text.hotel_category, "a high-end but economy stay", "Economy"),
    (text.intensity, "please follow the river", "low"),
    (text.interest_tags, "Interested in history, food and parks along with rest", ["history", "food", "parks"]),
    (text.interest_tags, None, []),
    (text.parse_time_range, "23:00-01:30", (1380, 1530)),
    (text.parse_time_range, "25:00-26:00", None),
    (text.opening_hours, "Open 24 hours", (0, 1440)),
    (text.duration_minutes, "1-2 hours", 60),
    (text.duration_minutes, "0.5 days", 240),
    (text.duration_minutes, "90 minutes", 90),
    (text.classify_action, "Return train after lunch", "transport"),
    (text.classify_action, "Old town walk", "sightseeing"),
    (text.safe_float, " 4.5/5", 4.5),
    (text.safe_float, "n/a", 0.0),
    (text.safe_int, "3.0", 0),
    (text.sanitize, "\x1b[31mred\x1b[0m\r\nline​ ", "red\nline"),
    (text.normalize, "  It’s   FINE ", "it's fine"),
]


@pytest.fixture(scope="module")
def found(spark):
    one = spark.range(1)
    row = one.select(*(f(F.lit(x)).alias(f"c{k}") for k, (f, x, _) in enumerate(CASES))).first()
    return list(row)


@pytest.mark.parametrize("k", range(len(CASES)))
def test_text(found, k):
    got = found[k]
    assert (tuple(got) if isinstance(CASES[k][2], tuple) else got) == CASES[k][2]


def test_numbers(spark):
    rows = spark.createDataFrame([(50.0,), (50.01,), (150.0,), (300.0,), (300.01,)], "p double")
    assert [r[0] for r in rows.select(text.price_bucket(F.col("p"))).collect()] == ["low", "medium", "medium", "high", "premium"]
    minutes = spark.createDataFrame([(659,), (660,), (840,), (1080,), (-1,)], "m int")
    assert [r[0] for r in minutes.select(text.time_to_slot(F.col("m"))).collect()] == ["morning", "noon", "afternoon", "evening", "unknown"]
    km, said = spark.range(1).select(geo.haversine_km(*map(F.lit, (0.0, 0.0, 0.0, 1.0))), text.format_range(F.lit(1380), F.lit(1530))).first()
    assert math.isclose(km, 111.194927, abs_tol=1e-6) and said == "23:00-01:30"
    wide = spark.range(1).select(text.fold_compatibility(F.lit("ﬁne ①"))).first()[0]
    assert wide == "fine 1"


def test_folding(spark):
    """All assigned characters, alone and beside a letter, and random runs of letters, marks and jamo against the standard library."""
    import random
    import sys
    import unicodedata

    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    marks = [c for c in chars if unicodedata.combining(c)]
    letters = [c for c in chars if len(unicodedata.normalize("NFKD", c)) > 1]
    tables = text._Unicode()
    jamo = [chr(c) for c in range(0x1100, 0x11C8)] + ["\uac00", "\uac01", "\ud55c"]
    joining = [p[k] for p in tables.pairs for k in (0, -1) if p[-1] in tables.second]
    rng = random.Random(1)
    pools = [marks, marks, letters, jamo, joining, [chr(c) for c in range(0x300, 0x370)], list("aeiouqxs \n'A")]
    said = [*chars, *(f"x{c}y" for c in marks), *("x" + unicodedata.normalize("NFD", c) + "y" for c in letters)]
    said += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 10))) for _ in range(30_000)]
    said += ["a\u0307\u0323", "q\u0307\u0323", "x\u0315\u0300", "\u1e9b\u0323", "\u1112\u1161\u11ab", "plain ascii", "", "Ｆｕｌｌ　ｗｉｄｔｈ ﬁne ①½", "日本語 故宫", "'quoted' \\ back", "Ａ" * 3000 + "e\u0301" * 3000, "e" + "\u0301\u0323" * 300]
    rows = spark.createDataFrame([(s, nfkc(s)) for s in said], "s string, want string")
    wrong = rows.where(~text.fold_compatibility(F.col("s")).eqNullSafe(F.col("want"))).limit(20).collect()
    assert len(chars) > 200_000 and not wrong, wrong
    tags = rows.where("length(s) > 1").select(F.transform(F.array("s"), text.normalize)[0].alias("n"), text.normalize(F.col("s")).alias("m")).where("n <> m").count()
    assert tags == 0 and spark.range(1).select(text.normalize(F.lit(None).cast("string"))).first()[0] == ""


def test_payloads_can_be_filtered(spark):
    """Filters on what was recovered are not moved into the step that recovers it, whether replies are stored or derived."""
    from wayfinder.operators import recover, serial

    said = F.when(F.col("id") % 3 == 0, '{"a": 1}').when(F.col("id") % 3 == 1, "so: {a: 1,}").otherwise("none")
    rows = spark.range(30).select("id", said.alias("reply"))
    found = recover.json_objects(rows, "reply")
    assert found.where("payload is not null").count() == 20 and found.where("not strict and payload is null").count() == 10
    assert found.where("payload is not null").join(rows.withColumnRenamed("reply", "again"), "id").where("strict").count() == 10
    replies = rows.select(F.col("id").alias("pid"), (F.col("id") % 2 == 0).alias("a_is_generated"), F.replace("reply", F.lit("1}"), F.lit('1, "winner": "A"}')).alias("reply"))
    assert serial.judged(replies).count() == 20
