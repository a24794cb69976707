"""Readers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from wayfinder.functions.scratch import cut
from wayfinder.operators import methods, planning, serial
from wayfinder.sources import bundle, files
from wayfinder.streaming import events


def test_requests_and_info(spark, tmp_path):
    (tmp_path / "test.json").write_text(json.dumps([{"pid": 1, "query": "a budget of $90, meal costs 10-20", "departure_city": " A ", "destination_city": "B", "day": 0}, {"pid": 2, "query": "", "departure_city": "A", "destination_city": "B", "day": 3, "budget": 5.0, "meal_price_range": [1, 2]}]))
    got = files.requests(spark, str(tmp_path / "test.json")).orderBy("pid").collect()
    assert (got[0]["departure"], got[0]["day"], got[0]["budget"], got[0]["lo"]) == ("A", 1, 90.0, 10.0)
    assert (got[1]["budget"], got[1]["hi"], got[1]["interests"]) == (5.0, 2.0, [])
    info = {"7": {"hotel": [{"Hotel Name": "Inn", "Average Price": "100", "Category": "Economy"}], "attractions": [{"poiid": "9", "name": "Gate", "tag": "old; town", "price": "x"}], "restaurants": [{"name_en": "Cafe", "avg_price": "30"}]}}
    (tmp_path / "info.json").write_text(json.dumps(info))
    parts = "array<map<string,string>>"
    rows = files.keyed_object(spark, str(tmp_path / "info.json"), f"struct<hotel:{parts},attractions:{parts},restaurants:{parts}>").selectExpr("pid", "'B' as city", "info")
    got = {r["cid"]: r for r in files.candidates(rows).collect()}
    assert set(got) == {"hotel:b:inn", "attraction:9", "restaurant:b:cafe"}
    assert got["attraction:9"]["tags"] == ["old", "town"] and got["attraction:9"]["price"] == 0.0 and got["hotel:b:inn"]["lat"] is None


def test_schedules_and_runs(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Departure City,Arrival City,Flight Number,Departure Time,Arrival Time,Price,Distance (km)\nA,B,F1,23:00,01:00,10.5,3\n")
    f = files.flights(spark, str(tmp_path / "f.csv")).first()
    assert (f["start"], f["end"], f["price"]) == (1380, 1500, 10.5)
    (tmp_path / "t.csv").write_text("Train_Number,Station_Number,Station_Name,Departure_Time,Arrival_Time,Second_Class_Price\nT1,1,A North,08:00,,0\nT1,3,B East,,11:00,50\nT1,2,C,09:00,08:55,20\nT2,1,A,1:00,1:00,1\nT3,1,,1:00,1:00,1\nT3,2,B,1:00,1:00,1\n")
    got = {r["number"]: r for r in files.trains(spark, str(tmp_path / "t.csv")).collect()}
    assert set(got) == {"T1", "T3"} and (got["T1"]["from_city"], got["T1"]["to_city"], got["T1"]["price"]) == ("A", "B", 50.0)
    (tmp_path / "r.csv").write_text("run_id,hops,use_vector,ndcg_at_5\nrun_001,1,True,0.5\nrun_002,2,off,\n")
    got = files.runs(spark, str(tmp_path / "r.csv")).orderBy("run_id").collect()
    assert tuple(got[0]) == ("run_001", 1, True, 0.5) and got[1]["use_vector"] is False and got[1]["ndcg_at_5"] is None


def test_stream(spark):
    sf = "/root/testdata/sf0.001"
    got = events.run_once(events.tumbling(events.stream(spark, sf)), "test_events")
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def trip_files(folder):
    """Two requests with their sandboxes, rides and reference plans."""
    plan = {"hotel": [{"day": 1, "name": "Inn", "price_per_night": 200}], "transportation": [{"day": 1, "mode": "train", "route": "A to B", "number": "T1", "time": "08:00-09:00", "price": 50}], "itinerary": {"day_1": [{"time": "10:00-11:00", "action": "sightseeing", "location": "Sight 1", "price": 20}, {"time": "12:00-13:00", "action": "dining", "location": "Food 1", "price": 60}], "day_2": [{"time": "09:00-10:00", "action": "sightseeing", "location": "sight 3 park", "price": 1}]}}
    ask = {"departure_city": "A", "destination_city": "B", "day": 2, "budget": 3000, "query": "two days in B, interested in history, parks along with rest", "final_plan_json": json.dumps(plan)}
    (folder / "test.json").write_text(json.dumps([{"pid": 1, **ask}, {"pid": 2, **ask, "meal_price_range": [50, 100]}]))
    sights = [{"poiid": str(k), "name": f"Sight {k}", "tag": "history; old", "price": str(10 * k), "latitude": str(30 + k / 100), "longitude": "120.0", "opening_hours": "08:00-18:00", "recommended_duration": "1-2 hours"} for k in range(1, 9)]
    food = [{"name_en": f"Food {k}", "price": str(50 + 10 * k), "small_cate": "noodles", "latitude": "30.02", "longitude": "120.0"} for k in range(1, 6)]
    ride = lambda number, a, b: {"train_options": [{"Train_Number": number, "Departure_Time": a, "Arrival_Time": b, "Second_Class_Price": 50.0}], "flight_options": []}
    box = {"hotel": [{"Hotel Name": "Inn", "Average Price": "200", "Category": "Midscale"}, {"Hotel Name": "Den", "Average Price": "90", "Category": "Economy"}], "attractions": sights, "restaurants": food, "transport_otd": ride("T1", "08:00", "09:00"), "transport_dto": ride("T2", "18:00", "19:00")}
    (folder / "infomation.json").write_text(json.dumps({"1": box, "2": box}))
    (folder / "train.json").write_text(json.dumps([{"pid": 9, "day": 2, "final_plan": ["### 09:00-10:00 | Museum\n### 12:00-13:00 | Lunch", "### 09:00-10:00 | Park"]}]))
    (folder / "Flight_Schedule.csv").write_text("Departure City,Arrival City,Flight Number,Departure Time,Arrival Time,Price,Distance (km)\nA,B,F1,07:00,08:00,500,3\n")


def test_bundle(spark, tmp_path):
    trip_files(tmp_path)
    b = bundle.load(spark, str(tmp_path))
    assert b.specs.count() == 2 and b.pool.count() == 30 and b.candidates.count() == 15
    assert {(r["from_city"], r["number"], r["start"], r["price"]) for r in b.transport.collect()} == {("A", "T1", 480, 50.0), ("B", "T2", 1080, 50.0), ("A", "F1", 420, 500.0)}
    found = {(r["pid"], r["plan_day"], r["cid"]) for r in b.truth.collect()}
    assert found == {(p, d, c) for p in (1, 2) for d, c in ((None, "hotel:b:inn"), (1, "attraction:1"), (1, "restaurant:b:food-1"), (2, "attraction:3"))}
    assert {r["token"] for r in b.slots.where("days = 2 and day = 2").collect()} == {"morning:sightseeing"}
    measured = cut(methods.experiment(b))
    rows = {(r["pid"], r["method"]): r for r in measured.collect()}
    assert set(rows) == {(p, s.method) for p in (1, 2) for s in methods.METHODS}
    for (_, method), r in rows.items():
        assert r["feasibility_pass_rate"] == r["entity_grounding_rate"] == r["transport_grounding_rate"] == r["faithfulness"] == r["schema_validity_rate"] == 1.0
        assert all(0 <= r[m] <= 1 for m in methods.METRICS if m not in ("average_route_distance_ratio", "max_single_day_route_km"))
        assert (r["context_recall"] == 0 and r["evidence_grounding_rate"] == 0) if method == "direct_llm" else r["context_recall"] > 0
        assert r["transport_time_feasibility"] == 1.0 and r["opening_hours_compliance"] == 1.0
    means = {r["method"]: r for r in methods.aggregate(measured).collect()}
    assert means["direct_llm"]["personalization_surpassing_rate"] == 0 and all(r["n"] == 2 for r in means.values())
    p = methods.plan(b.first(1), methods.METHODS[-1:])
    assert p["report"].count() == 1 and json.loads(serial.diagnostics(p).first()["diagnostics"])["validator"]["validator_repaired"] in (True, False)
    whole = planning.whole(p["acts"], p["hotels"], p["rides"], p["specs"])
    said = serial.plan_form(whole).first()["said"].split("\n")
    assert said[0].startswith("hotel: day 1: ") and said[1].startswith("transport: day 1: train A to B T1 08:00-09:00 50.00; day 2: ") and said[2].startswith("day_1: ")
    asked = files.requests(spark, str(tmp_path / "test.json"))
    reference = serial.reference_form(asked).where("pid = 1").first()["said"].split("\n")
    assert reference[0] == "hotel: day 1: Inn (200/night)" and reference[3] == "day_2: 09:00-10:00 sightseeing sight 3 park (1)"
    prompt = serial.judge_prompts(b.specs, serial.reference_form(asked), serial.reference_form(asked)).first()["prompt"]
    assert '"trip_days":2' in prompt and prompt.count("hotel: day 1: Inn") == 2
    ask = serial.prompts(p["specs"], p["chosen"], p["rides"], p["windows"]).first()["prompt"]
    assert "- trip_days=2" in ask and "usable window is 09:30-22:00" in ask and "id=attraction:" in ask
    again = spark.range(1).select(serial.retry_prompt(*map(F.lit, ("ask", 2, "bad", "no object"))), serial.repair_prompt(F.lit("{a"), F.lit("odd"))).first()
    assert again[0].endswith("Last answer:\nbad") and again[1].endswith("{a")


def test_model_replies(spark, tmp_path):
    trip_files(tmp_path)
    b = bundle.load(spark, str(tmp_path))
    windows = spark.createDataFrame([(p, d, 540, 1320, 2) for p in (1, 2) for d in (1, 2)], "pid long, plan_day long, open long, close long, most long")
    good = json.dumps({"hotel_candidate_id": "inn", "days": {"1": [{"candidate_id": "attraction:1", "action": "Sightseeing"}, {"candidate_id": "attraction:2", "action": "dining"}, {"candidate_id": "attraction:3", "action": "sightseeing"}], "2": [{"name": "Food 2", "action": "dining"}, {"name": "Food 2", "action": "dining"}], "7": [{"candidate_id": "attraction:4", "action": "sightseeing"}]}})
    replies = spark.createDataFrame([(1, 1, "sorry"), (1, 2, f"```json\n{good}\n```"), (1, 3, "{}"), (2, 1, "{}"), (2, 2, None)], "pid long, attempt int, reply string")
    acts, beds, failures = serial.model_plans(replies, b.pool, windows)
    assert {(r["pid"], r["plan_day"], r["seq"], r["cid"]) for r in acts.collect()} == {(1, 1, 1, "attraction:1"), (1, 2, 1, "restaurant:b:food-2")}
    assert [tuple(r) for r in beds.collect()] == [(1, "hotel:b:inn")]
    assert {(r["pid"], r["attempt"]) for r in failures.collect()} == {(1, 1), (1, 3), (2, 1), (2, 2)}


def test_runs_by_model(spark, tmp_path):
    """Two models and two numbers of hops at once: one model answers one request, in its second attempt, the other none."""
    trip_files(tmp_path)
    b = bundle.load(spark, str(tmp_path))
    days = {"1": [{"candidate_id": "attraction:3", "action": "sightseeing"}, {"candidate_id": "none", "action": "dining"}], "2": []}
    rows = [("a", 1, 1, 0, '{"days": []}'), ("a", 1, 2, 0, json.dumps({"hotel_candidate_id": "hotel:b:inn", "days": days})), ("a", 2, 1, 0, "?"), ("a", 2, 1, 2, '{"a": }'), ("b", 1, 1, 0, None)]
    replies = spark.createDataFrame(rows, "model string, pid long, attempt int, repair int, reply string")
    settings = methods.by_model(("a", "b", ""), hops=(1, 2), methods=methods.METHODS[:1])
    with pytest.raises(ValueError):
        methods.plan(b, settings)
    p = methods.plan(b, settings, replies, attempts=2)
    runs = p["runs"].select("run", "model", "hops")
    modes = {(r["pid"], r["model"], r["hops"]): (r["planner_mode"], r["asks"]) for r in methods.told(p["modes"], runs).collect()}
    want = {("a", 1): ("llm", 2), ("a", 2): ("heuristic_fallback", 6), ("b", 1): ("heuristic_fallback", 6), ("b", 2): ("heuristic_fallback", 6), ("", 1): ("heuristic", 0), ("", 2): ("heuristic", 0)}
    assert modes == {(pid, m, h): v for (m, pid), v in want.items() for h in (1, 2)}
    acts = {}
    for r in methods.told(p["acts"], runs).collect():
        acts.setdefault((r["pid"], r["model"], r["hops"]), []).append((r["plan_day"], r["seq"], r["cid"]))
    # the model's day has what it named and exists; its empty day is filled
    assert [x for x in sorted(acts[1, "a", 2]) if x[0] == 1] == [(1, 1, "attraction:3")] and any(x[0] == 2 for x in acts[1, "a", 2])
    assert sorted(acts[2, "a", 1]) == sorted(acts[2, "", 1]) and sorted(acts[1, "b", 2]) == sorted(acts[1, "", 2])
    assert p["log"].where("error is null").count() == 2
    found = methods.measure(b, p)
    compared = {(r["model"], r["hops"]): r["n"] for r in methods.aggregate(found, ("model", "hops")).collect()}
    assert compared == {(m, h): 2 for m in ("a", "b", "") for h in (1, 2)}
