"""A small trip worked out by hand, and properties of the sequential operators."""

import pytest
from pyspark.sql import functions as F

from wayfinder.functions import lists
from wayfinder.operators import checks, graph, metrics, patterns, planning, recover, runs, sinks, summary
from wayfinder.operators import retrieval as R
from wayfinder.sources import files, store

SPEC = "pid long, departure string, destination string, day long, query string, budget double, lo double, hi double, category_pref string, intensity_pref string, interests array<string>"
CAND = "cid string, etype string, k long, ord long, city string, name string, price double, lat double, lon double, tags array<string>, category string, opening string, duration string, text string"


@pytest.fixture(scope="module")
def trip(spark):
    specs = spark.createDataFrame([(1, "A", "B", 2, "history please", 1000.0, 50.0, 100.0, None, None, ["history"])], SPEC)
    a = lambda i, price, lat, opening=None, duration=None: (f"attraction:{i}", "attraction", i, i, "B", f"Sight {i}", price, lat, 120.0 if lat else None, ["history"], None, opening, duration, f"sight {i} history")
    r = lambda i, price: (f"restaurant:{i}", "restaurant", i, 10 + i, "B", f"Food {i}", price, 30.02, 120.0, ["food"], None, None, None, f"food {i}")
    hotel = ("hotel:1", "hotel", 1, 9, "B", "Inn", 200.0, 30.0, 120.0, ["Midscale"], "Midscale", None, None, "inn")
    rows = [a(1, 20.0, 30.01, "10:00-17:00"), a(2, 30.0, 30.02, None, "2 hours"), a(3, 10.0, 30.29), a(4, 5.0, None), hotel, r(1, 60.0), r(2, 90.0), r(3, 150.0)]
    cands = spark.createDataFrame(rows, CAND)
    rides = spark.createDataFrame([(1, "outbound", "train", "T1", 480, 540, 50.0), (1, "inbound", "train", "T2", 1080, 1140, 50.0)], "pid long, direction string, mode string, number string, start long, end long, price double")
    return specs, cands, specs.join(cands, F.col("destination") == F.col("city")), rides


def test_tiers_and_filter(trip):
    t = {r["cid"]: r["tier"] for r in R.tiers(trip[2]).collect()}
    assert t["restaurant:3"] == 2 and sum(v == 0 for v in t.values()) == 7
    assert R.hard_filter(trip[2]).count() == 7


def test_filter_relaxes_whole_tiers(trip):
    few = trip[2].where("cid in ('hotel:1', 'restaurant:1', 'restaurant:3')")
    assert [r["cid"] for r in R.hard_filter(few).orderBy("tier", "ord").collect()] == ["hotel:1", "restaurant:1", "restaurant:3"]


def test_windows(trip):
    days = {r["plan_day"]: tuple(r)[2:] for r in planning.day_windows(trip[0], trip[3]).collect()}
    assert days == {1: (570, 1320, 3), 2: (540, 1050, 3)}


def test_rerank_is_a_permutation(trip):
    items = trip[2].withColumn("tier", F.lit(0)).withColumn("fused", 1 / (F.col("ord") + 1))
    found = R.rerank(items, 99).orderBy("position").collect()
    assert sorted(r["cid"] for r in found) == sorted(r["cid"] for r in trip[1].collect())
    assert found[0]["cid"] == "attraction:1" and found[0]["penalty"] == 0


def test_plan_schedule_check_repair(spark, trip):
    specs, cands, pool, rides = trip
    windows = planning.day_windows(specs, rides)
    ranked = pool.withColumn("position", F.col("ord")).withColumn("fused", 1 / (F.col("ord") + 1))
    slots = graph.skeletons(spark)
    plans = planning.build(ranked, windows, slots, summary.day_suggestions(ranked))
    acts = plans.drop("price").join(pool, ["pid", "cid"])
    assert checks.overlaps(acts).count() == 0 and plans.count() > 0
    inside = plans.join(windows, ["pid", "plan_day"]).where("start < open or end > close").count()
    assert inside == 0
    hotels = pool.where("etype = 'hotel'").select("pid", "cid", "price", "category")
    report = checks.validate(specs, acts, hotels, rides, pool).first()
    assert report["content_ok"] and report["time_ok"] and report["transport_ok"] and report["stay_ok"]
    bad = spark.createDataFrame([(1, 1, 1, 600, 660, "dining", "restaurant:3", 150.0), (1, 1, 2, 610, 700, "sightseeing", "attraction:2", 30.0), (1, 1, 3, 720, 800, "sightseeing", "attraction:2", 30.0)], planning.SCHEMA)
    before = checks.validate(specs, bad.drop("price").join(pool, ["pid", "cid"]), hotels, rides, pool).first()
    assert set(before["errors"]) == {"meal_range_violation", "temporal_conflict", "duplicate_locations", "stay_duration_violation"}
    fixed = planning.repair(bad, ranked, windows, spark.createDataFrame([(1, 500.0)], "pid long, fixed double"))
    after = checks.validate(specs, fixed.drop("price").join(pool, ["pid", "cid"]), hotels, rides, pool).first()
    assert after["meal_ok"] and after["time_ok"] and after["dedup_ok"] and after["stay_ok"]


def test_schedule_fold(spark, trip):
    items = trip[2].where("etype <> 'hotel'").withColumn("plan_day", F.lit(1).cast("long")).withColumn("seq", F.col("ord"))
    days = spark.createDataFrame([(1, 1, 570, 1320)], "pid long, plan_day long, open long, close long")
    got = [(r["cid"], r["start"], r["end"]) for r in planning.schedule(items, days).orderBy("seq").collect()]
    assert got[:3] == [("attraction:1", 600, 690), ("attraction:2", 705, 825), ("attraction:3", 840, 930)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("a", "c")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    assert {(r[0], r[1]) for r in graph.components(edges, nodes).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "f")}
    one = {r["node"] for r in graph.bfs(nodes.where("node = 'a'"), edges, 1).collect()}
    two = {r["node"] for r in graph.bfs(nodes.where("node = 'a'"), edges, 2).collect()}
    assert one == {"a", "b", "c"} and one <= two
    path = graph.shortest_paths(spark.createDataFrame([("a", "c"), ("a", "e")], "src string, dst string"), edges).collect()
    assert [(r["hops"], r["path"]) for r in path] == [(1, ["a", "c"])]


def test_reach_and_paths_of_hubs(spark):
    """Steps through hubs against a plain search, for all pairs of a small graph."""
    from itertools import pairwise, product

    kinds = ["attraction:1", "attraction:2", "attraction:3", "hotel:1", "restaurant:1", "restaurant:2", "city:x", "city:y", "etype:a", "pref:tag:t", "pref:tag:u", "pattern:p", "slot:q"]
    rows = [("attraction:1", "city:x"), ("attraction:2", "city:x"), ("attraction:1", "attraction:2"), ("attraction:2", "pref:tag:t"), ("hotel:1", "city:y"), ("attraction:3", "city:y"), ("attraction:3", "etype:a"), ("etype:a", "slot:q"), ("slot:q", "pattern:p"), ("restaurant:1", "pref:tag:u"), ("restaurant:1", "city:x"), ("restaurant:2", "pref:tag:u")]
    edges = spark.createDataFrame([(min(e), max(e), "r") for e in rows], "src string, dst string, relation string")
    near = {n: sorted({b for a, b in rows if a == n} | {a for a, b in rows if b == n}) for n in kinds}

    def shortest(a, b):
        for hops in range(4):
            found = [p for p in product([a], *[kinds] * (hops - 1), *([[b]] if hops else [])) if p[-1] == b and len(set(p)) == len(p) and all(y in near[x] for x, y in pairwise(p))]
            if found:
                return min(found)
        return None

    low = [k for k in kinds if k.split(":")[0] in graph.CANDIDATES]
    pairs = [(a, b) for a in low for b in kinds if a != b]
    got = {(r["src"], r["dst"]): tuple(r["path"]) for r in graph.shortest_paths(spark.createDataFrame(pairs, "src string, dst string"), edges, 3).collect()}
    assert got == {p: shortest(*p) for p in pairs if shortest(*p)}
    seeds = spark.createDataFrame([(1, "attraction:1"), (2, "hotel:1"), (2, "restaurant:2")], "pid long, cid string")
    items = spark.createDataFrame([(pid, c) for pid in (1, 2) for c in low], "pid long, cid string")
    hop = {(r["pid"], r["cid"]): r["hop"] for r in graph.reached(items, seeds, edges).collect()}
    want = {}
    for pid, start in ((1, ["attraction:1"]), (2, ["hotel:1", "restaurant:2"])):
        for c in low:
            lengths = [len(p) - 1 for s in start for p in [shortest(s, c)] if p]
            if lengths:
                want[pid, c] = min(lengths)
    assert hop == want
    by = {(r["pid"], r["node"]): r["hop"] for r in graph.bfs_by(seeds.withColumnRenamed("cid", "node"), edges, 3, candidate_only=True).collect()}
    assert by == want
    ends = graph.with_ends(edges, spark.createDataFrame([("city:x",), ("attraction:1",)], "node string"))
    assert [(r["src"], r["dst"]) for r in ends.collect()] == [("attraction:1", "city:x")]


def test_one_clock(spark, trip):
    """The fold in the JVM and the clock of the planner give the same times."""
    items = trip[2].where("etype <> 'hotel'").withColumn("position", F.col("ord"))
    days = spark.createDataFrame([(1, 1, 570, 1320, 5)], "pid long, plan_day long, open long, close long, most long")
    planned = planning.build(items, days, spark.createDataFrame([(2, 1, k, "noon:sightseeing" if k < 4 else "noon:dining") for k in range(5)], "days long, day long, slot long, token string"))
    order = planned.join(items.select("cid", "etype", "opening", "duration"), "cid")
    again = planning.schedule(order, days)
    times = lambda rows: sorted((r["cid"], r["start"], r["end"]) for r in rows.collect())
    assert times(planned) == times(again) and planned.count() >= 4


def test_ranking(spark):
    ev = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "pid long, cid string, position long")
    got = metrics.ranking(ev, spark.createDataFrame([(1, "a"), (1, "c")], "pid long, cid string")).first()
    assert got["recall_at_5"] == 1.0 and abs(got["ndcg_at_5"] - 0.919721) < 1e-6


def test_min_max(spark):
    two = spark.createDataFrame([(1, 2.0), (1, 2.0)], "pid long, x double")
    assert [r[0] for r in two.select(R.min_max("x")).collect()] == [0.0, 0.0]
    assert [r[0] for r in two.select(R.min_max("x", 1.0)).collect()] == [1.0, 1.0]


def test_recover():
    assert recover.recover('```json\n{a: "x", "b": [1, 2,],}\n```') == '{"a":"x","b":[1,2]}'
    assert recover.recover("say {'a': true, 'b': null} done") == '{"a":true,"b":null}'
    broken = '"hotel_candidate_id": "hotel:1"\n"1": [\n"candidate_id": "attraction:2"\n"action": "sightseeing"\n]'
    assert '"candidate_id":"attraction:2"' in recover.recover(broken)
    assert recover.recover("nothing") is None and recover.recover(None) is None


def test_patterns(spark):
    rows = [(1, 2, ["### 09:00-10:00 | Museum\n### 12:00-13:00 | Lunch", ""], 0), (2, 2, ["### 12:00-13:00 | Lunch\n### 09:00-10:00 | Museum", "x"], 1), (3, 0, ["x"], 2)]
    got = patterns.mine(spark.createDataFrame(rows, "pid long, day int, final_plan array<string>, ord long")).collect()
    assert len(got) == 1 and got[0]["support"] == 2
    assert got[0]["signature"] == [["morning:sightseeing", "noon:dining"], ["morning:sightseeing", "afternoon:dining", "afternoon:transport"]]


def test_runs(spark):
    grid = runs.grid(spark)
    assert grid.count() == 48 and grid.where("use_community_retrieval and not use_graph_expansion").count() == 0
    zero = spark.range(1).select(*runs.normalized(F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()
    assert tuple(zero) == (0.5, 0.25, 0.25)


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("city:a", 1, "city", "A"), ("x y", 2, "my kind", 'q"q')], "node string, layer int, kind string, label string")
    edges = spark.createDataFrame([("x y", "city:a", "in-city"), ("city:a", "x y", "in-city")], "src string, dst string, relation string")
    said = [r["statement"] for r in sinks.statements(nodes, edges).collect()]
    assert len(said) == 3 and "`IN_CITY`" in said[2] and "`MyKind`" in said[1] and 'q\\"q' in said[1]
    assert not sinks.graph_exists(spark, str(tmp_path / "g"))
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    sinks.write_graph(nodes.limit(1), edges, str(tmp_path / "g"), clear=False)
    assert sinks.graph_versions(spark, str(tmp_path / "g")) == [1, 2]
    assert sinks.graph_stats(nodes, edges).first().asDict() == {"nodes": 2, "edges": 2, "degree_max": 2}
    back, links = sinks.read_graph(spark, str(tmp_path / "g"))
    assert back.count() == 2 and links.count() == 1
    one = {r["node"]: r["batch"] for r in sinks.batches(back, "node", 1).collect()}
    assert sorted(one.values()) == [0, 1]
    many = {r["id"]: r["batch"] for r in sinks.batches(spark.range(95).repartition(5), "id", 10).collect()}
    assert many == {k: k // 10 for k in range(95)}
    meta = sinks.node_rows(spark.createDataFrame([("a", " ", {"k": "v"}), ("b", "x", None)], "node string, label string, meta map<string,string>"))
    assert [tuple(r) for r in meta.orderBy("node").collect()] == [("a", None, '{"k":"v"}'), ("b", "x", None)]
    assert [r["meta"] for r in sinks.with_meta(meta).orderBy("node").collect()] == [{"k": "v"}, {}]


def test_written_runs(spark, tmp_path):
    rows = spark.createDataFrame([(k, m) for k in range(7) for m in ("a", "b")], "pid long, method string")
    out = str(tmp_path / "predictions")
    answer = lambda r: r.withColumn("plan", F.lit("p"))
    assert sinks.run_resumed(rows.where("pid < 3"), out, answer, 4) == 2
    assert sinks.run_resumed(rows, out, answer, 4) == 2 and sinks.run_resumed(rows, out, answer, 4) == 0
    done = files.finished(spark, out)
    assert done.count() == 14 and spark.read.json(out).count() == 14
    grid = runs.grid(spark, max_runs=6).withColumn("ndcg_at_5", F.col("run_index") / 10)
    for c in runs.KEYS:
        grid = grid.withColumn(c, F.lit(0.5))
    grid = grid.withColumn("method", F.lit("m")).withColumn("model", F.lit("x"))
    found = sinks.write_ablation(grid, str(tmp_path), "ndcg_at_5", 2)
    assert [r["run_id"] for r in found["top"]] == ["run_006", "run_005"] and store.read_json(spark, str(tmp_path / "ablation_summary.json")).first()["target"] == "ndcg_at_5"
    assert store.read_json(spark, str(tmp_path / "none.json")) is None
    assert sinks.write_comparison(grid, str(tmp_path), "average_route_distance_ratio")["best"][0]["n"] > 0
    assert files.runs(spark, str(tmp_path / "comparison.csv")).count() == 6
    assert runs.lookup(grid, "run_003", runs.order_for("ndcg_at_5")).first()["run_id"] == "run_003" and runs.lookup(grid, "no", runs.order_for("ndcg_at_5")).first()["run_id"] == "run_006"
    assert [r["run_id"] for r in runs.top_runs(grid, ["run_002", "run_001"], runs.order_for("ndcg_at_5")).collect()] == ["run_002", "run_001"]
    assert sinks.write_summary(grid.groupBy("method").agg(F.count("*").alias("n"), F.avg("ndcg_at_5").alias("g")), str(tmp_path / "summary.json"))["methods"]["m"]["n"] == 6
    parts = sinks.write_split(rows.select("pid").distinct(), "pid", 0.4, str(tmp_path / "split"))
    assert parts["dev_size"] + parts["test_size"] == 7
    table = sinks.latex_table(grid.orderBy("run_index").limit(1), {"run_id": "Run", "ndcg_at_5": "nDCG"}, "Runs", "tab:runs")
    assert r"run\_001 & 0.1000 \\" in table and table.count("rule") == 3
    stats = runs.topk_stats(grid, ["ndcg_at_5"])
    with pytest.raises(ValueError):
        sinks.latex_figure(stats, ["ndcg_at_5"], "c", "l")
    both = runs.topk_stats(runs.grid(spark).withColumn("ndcg_at_5", F.lit(0.5)), ["ndcg_at_5"])
    assert "(ndcg at 5,0.5000)" in sinks.standalone(sinks.latex_figure(both, ["ndcg_at_5"], "c", "l"))
    sinks.write_failures(spark.createDataFrame([(1, 2, "no JSON object", "sorry")], "pid long, attempt int, error string, response string"), str(tmp_path / "failures"))
    assert spark.read.json(str(tmp_path / "failures")).first()["response"] == "sorry"


def test_killed_runs_go_on(spark, tmp_path):
    """A run that dies in a batch, and one that dies between writing a batch and noting it, resumed: each request once."""
    rows = spark.createDataFrame([(k, m) for k in range(9) for m in ("a", "b")], "pid long, method string")
    out, calls = str(tmp_path / "p"), []

    def dies(r):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return r.withColumn("plan", F.lit("first"))

    with pytest.raises(Exception, match="killed"):
        sinks.run_resumed(rows, out, dies, 4)
    assert spark.read.json(out).count() == 8
    assert sinks.run_resumed(rows, out, lambda r: r.withColumn("plan", F.lit("second")), 4) == 3
    noted = sorted((tmp_path / "p" / "_checkpoint" / "commits").glob("[0-9]*"))
    for file in (noted[-1], noted[-1].with_name(f".{noted[-1].name}.crc")):
        file.unlink()  # as if it had died after the last batch was written
    more = rows.union(spark.createDataFrame([(9, "a")], rows.schema))
    assert sinks.run_resumed(more, out, lambda r: r.withColumn("plan", F.lit("third")), 4) == 2
    found = spark.read.json(out)
    assert found.count() == found.select("pid", "method").distinct().count() == 19
    assert {r["plan"]: r["count"] for r in found.groupBy("plan").count().collect()} == {"first": 8, "second": 8, "third": 3}
    assert sinks.run_resumed(more, out, dies, 4) == 0


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "b b c")], "id long, body string")
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "term string, vector array<double>")
    terms = rows.select("id", F.explode(F.split("body", " ")).alias("term"))
    build = lambda r: store.embed(r, "id", terms, words)
    found, action = store.vectors(rows, "id", "body", "model", str(tmp_path), build)
    got = {r["id"]: r["embedding"] for r in found.collect()}
    assert action == "built" and got[2] == [0.0, 1.0] and abs(got[1][1] - 2 / 5**0.5) < 1e-12
    assert store.vectors(rows, "id", "body", "model", str(tmp_path), build)[1] == "loaded"
    assert store.vectors(rows.limit(1), "id", "body", "model", str(tmp_path), build)[1] == "built"

    def missing():
        raise RuntimeError("no vectors")

    assert store.resolve_search("auto", lambda: rows, missing).action == "fallback_tfidf" and store.resolve_search("tfidf", lambda: rows, missing).source == "tfidf"
    with pytest.raises(RuntimeError):
        store.resolve_search("dense", lambda: rows, missing)
    nodes = spark.createDataFrame([("city:a", 1, "city", "A"), ("city:b", 1, "city", "B")], "node string, layer int, kind string, label string")
    graph_ = nodes, spark.createDataFrame([("city:a", "city:b", "near")], "src string, dst string, relation string")
    at = str(tmp_path / "graph")
    assert [store.resolve_graph(spark, "store", at, lambda: graph_).action for _ in range(2)] == ["bootstrapped_store", "loaded_store"]
    assert store.resolve_graph(spark, "auto", None, lambda: graph_).action == "built_local" and store.stats(graph_) == {"nodes": 2, "edges": 1, "degree_max": 1}
    with pytest.raises(RuntimeError):
        store.resolve_graph(spark, "store", str(tmp_path / "empty"), lambda: graph_, bootstrap=False)


def test_lists():
    assert lists.ints("1, 2,") == [1, 2] and lists.floats("0.5,1") == [0.5, 1.0] and lists.bools("on,No") == [True, False]
    for f, said in ((lists.bools, "maybe"), (lists.ints, " , ")):
        with pytest.raises(ValueError):
            f(said)
