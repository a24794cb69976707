"""What a round of findings at larger sizes asked for."""

import duckdb

from wayfinder.operators import checks
from wayfinder.plans import registry

SF = "/root/testdata/sf0.001"


def test_unknown_length_is_no_short_stay(spark):
    specs = spark.createDataFrame([(1, 2, "A", "B", None, None, None)], "pid long, day long, departure string, destination string, budget double, lo double, hi double")
    act = "pid long, plan_day long, seq long, start long, end long, action string, cid string, price double, etype string, lat double, lon double, opening string, duration string"
    hotels = spark.createDataFrame([(1, "hotel:1", 5.0)], "pid long, cid string, price double")
    rides = spark.createDataFrame([], "pid long, direction string, start long, end long, price double")
    pool = spark.createDataFrame([(1, "hotel:1"), (1, "attraction:1")], "pid long, cid string")
    for duration, ok in ((None, True), ("1 hours", False)):
        acts = spark.createDataFrame([(1, 1, 1, 600, 608, "sightseeing", "attraction:1", 1.0, "attraction", None, None, None, duration)], act)
        assert checks.validate(specs, acts, hotels, rides, pool).first()["stay_ok"] is ok


def test_stops_with_large_part_keys(spark, tmp_path):
    """From a million parts on, the key that orders stops mixes lines."""
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * replace (case when l_linenumber = 1 then l_partkey + 1500000 else l_partkey end as l_partkey) from '{SF}/lineitem.parquet'")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = sorted(map(tuple, registry.queries()["transport_first_last"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(registry.oracle_sql()["transport_first_last"]).fetchall())


def test_sweep_without_rides(spark, tmp_path):
    """Runs over retrieval read no rides, so a table of them is not asked for; the results are those of the SQL."""
    con = duckdb.connect()
    for t in "nation customer supplier part orders".split():
        con.execute(f"copy (select * from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
    for t in "nation customer supplier part orders lineitem".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = {r["run_id"]: tuple(round(x, 6) for x in r[1:]) for r in registry.queries()["retrieval_runs"](spark, str(tmp_path)).collect()}
    said = con.execute(f"select run_id, recall_at_5, ndcg_at_5, recall_at_10, ndcg_at_10 from ({registry.oracle_sql()['retrieval_runs']})").fetchall()
    assert got == {r[0]: tuple(round(x, 6) for x in r[1:]) for r in said}
