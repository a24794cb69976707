"""Elements of JSON files in many byte ranges against the standard library."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayfinder.sources import files
from wayfinder.sources.elements import elements


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 3:
        return rng.choice([1, None, True, "", "a}b", '"', '\\"}', "\\", "}{][", "é漢,\n", '{"x": 1}', "end\\"])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "}", '"', "[x", "\\"]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.fixture
def ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", n), spark.conf.set("spark.sql.files.openCostInBytes", 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("indent", [None, 2])
def test_elements(spark, tmp_path, ranges, indent):
    rng = random.Random(3)
    rows = [{"pid": k, "x": value(rng)} for k in range(70)]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(indent)))
    (tmp_path / "object.json").write_text(json.dumps({str(r["pid"]): r for r in rows}, indent=indent))
    for size in ("900", "64m"):  # many ranges, and one
        ranges(size)
        got = elements(spark, str(tmp_path / "array.json"))
        assert [json.loads(r["text"]) for r in got.orderBy("nth").collect()] == rows
        found = files.keyed_object(spark, str(tmp_path / "object.json"), "struct<pid:long,x:string>")
        assert sorted((r["pid"], r["info"]["pid"]) for r in found.collect()) == [(k, k) for k in range(70)]
    ranges("900")
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "array.json")).rdd.getNumPartitions() > 5
    for said in ("[]", "{}", ""):
        (tmp_path / "empty.json").write_text(said)
        assert elements(spark, str(tmp_path / "empty.json")).count() == 0


def test_requests_of_many_ranges(spark, tmp_path, ranges):
    rows = [{"pid": k, "query": f"a budget of ${k + 100} {{}} \"for\" [me]", "departure_city": " A ", "destination_city": "B", "day": k % 4, "final_plan_json": json.dumps({"hotel": [{"name": "x}"}]})} for k in range(60)]
    (tmp_path / "test.json").write_text(json.dumps(rows))
    ranges("500")
    got = files.requests(spark, str(tmp_path / "test.json")).orderBy("pid").collect()
    assert [(r["pid"], r["budget"], r["day"]) for r in got] == [(k, k + 100.0, max(1, k % 4)) for k in range(60)]
    assert got[7]["final_plan_json"] == rows[7]["final_plan_json"] and got[7]["departure"] == "A"
    assert files.requests(spark, str(tmp_path / "test.json")).where(F.col("query").isNull()).count() == 0
