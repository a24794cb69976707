"""What grows with requests, runs and candidates stays small: hubs spread, runs share, names are folded once."""

from pyspark.sql import functions as F

from wayfinder.operators import graph, methods, patterns
from wayfinder.plans.q_retrieval import scored
from wayfinder.sources.domain import World

SF = "/root/testdata/sf0.001"


def test_hubs_spread_and_not_requests(spark, monkeypatch):
    edges = [(f"hotel:{k}", f"pref:tag:{k % 3}") for k in range(300)] + [("hotel:0", "pref:tag:1"), ("hotel:301", "hotel:302"), ("hotel:302", "pref:tag:2")]
    seeds = [(p, f"hotel:{p}") for p in range(0, 600, 3)][:100] + [(p, "hotel:301") for p in range(1000, 1100)]
    items = [(p, f"hotel:{k}") for p, _ in seeds for k in (0, 1, 2, 3, 301)]
    made = []
    monkeypatch.setattr(graph, "spread", lambda *a, f=graph.spread: made.append(f(*a)) or made[-1])
    table = lambda rows: spark.createDataFrame(rows, "pid long, cid string")
    found = graph.reached(table(items), table(seeds), spark.createDataFrame(edges, "src string, dst string"), 6)
    got = {(r["pid"], r["cid"]): r["hop"] for r in found.collect()}
    # tags 0 and 1 share hotel:0; hotels 2, 5, ... have tag 2 alone, which hotel:302 ties to hotel:301
    want = {(p, c): 0 if s == c else 2 for p, s in seeds if p < 1000 for c in ("hotel:0", "hotel:3")}
    want |= {(p, "hotel:1"): 2 if s == "hotel:0" else 4 for p, s in seeds if p < 1000}
    want |= {(p, c): h for p, _ in seeds if p >= 1000 for c, h in (("hotel:2", 3), ("hotel:301", 0))}
    assert got == want
    assert sum(t.count() for t in made) < 100


def test_runs_with_the_same_seeds_share_their_reach(spark, monkeypatch):
    w = World(spark, SF)
    s = scored(w)
    asked = []
    monkeypatch.setattr(graph, "reached", lambda items, *a, f=graph.reached: asked.append(items.count()) or f(items, *a))
    b = methods.Bundle(w.specs, w.pool, w.candidates, None, None, graph.candidate_edges(w.candidates, s), None)
    settings = tuple(methods.Settings(f"run_{k}", use_community_retrieval=k % 2 == 0, w_graph=0.1 * k) for k in range(4))
    runs = methods.table(spark, settings)
    together = methods.fused(s, runs, b)
    assert asked == [s.count()]
    for k in (0, 3):
        alone = methods.fused(s, methods.table(spark, (settings[k],)), b)
        rows = lambda t, k: sorted(map(tuple, t.where(methods.run_of() == k).select(F.shiftright("pid", 10), "cid", "fused").collect()))
        assert rows(together, k) == rows(alone, 0)


def test_names_are_folded_once(spark):
    rows = [(f"hotel:{k}", "hotel", "Bad Ems", 10.0, ["A b", None, "c"]) for k in range(50)]
    c = spark.createDataFrame(rows, "cid string, etype string, city string, price double, tags array<string>")
    assert graph._names(c).count() == 4
    found = {r["b"] for r in graph.own_links(c).collect()}
    assert found == {"city:bad-ems", "etype:hotel", "pref:budget:low", "pref:tag:a-b", "pref:tag:c", "pref:tag:na"}


def test_lines_are_matched_once_a_day(spark):
    body = "  ### 23:10to1:05|x lunch  \n### 24:00 - 01:00 | Train\r\n### a| \n### 9:5 - 10:00 | A check-in\rnope ### 3:00-4:00 | x\n###\n| y"
    t = spark.createDataFrame([(body,)], "b string").select(patterns.day_tokens(F.col("b"), F.lit(1), F.lit(3)).alias("t"))
    assert t.first()["t"] == ["evening:dining", "evening:transport", "evening:checkin"]
    assert t._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2
