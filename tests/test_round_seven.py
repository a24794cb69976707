"""What runs measure is joined from small tables; cells link all their members."""

import itertools
import random

from pyspark.sql import functions as F

from tests.test_sources import trip_files
from wayfinder.operators import graph, methods, sinks
from wayfinder.plans import q_evaluation, q_graph, registry
from wayfinder.sources import bundle
from wayfinder.sources.domain import World


def test_measured_parts_are_tables(spark, tmp_path):
    """A run of shortlists alone, with no fused item at all; its row a request reads a table for each part and no more."""
    trip_files(tmp_path)
    rows = methods.experiment(bundle.load(spark, str(tmp_path)), methods.METHODS[:1])
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves().size()
    assert leaves <= 16 and rows.count() == 2


def test_cells_link_all_their_members(spark):
    """Forty places in one cell, three in another, one without a place: pairs are all there, whatever the block."""
    rows = [(f"attraction:{k}", k, "B", 30.01 if k < 40 else 30.25, 120.0 if k < 43 else None) for k in range(44)]
    cells = graph.whole_cells(spark.createDataFrame(rows, "cid string, ord long, city string, lat double, lon double"))
    names = [[r[0] for r in rows[:40]], [r[0] for r in rows[40:43]]]
    want = sorted(tuple(sorted(x)) for group in names for x in itertools.combinations(group, 2))
    for block in (7, 512):
        assert sorted(map(tuple, graph.cell_pairs(cells, block).collect())) == want
    assert graph.cell_links(cells).first()[0] == len(want)


def test_cells_stand_for_their_links(spark):
    """Hops, scores and degrees with cells are those of the links spelled out."""
    rng = random.Random(3)
    cands = [(f"hotel:{k}", f"B/{k % 3}/0") for k in range(60)]
    members = spark.createDataFrame([(c, x, 20) for c, x in cands], "cid string, cell string, size long")
    edges = spark.createDataFrame([(f"hotel:{k}", f"pref:tag:{rng.randrange(25)}", "has_tag") for k in range(66)], "src string, dst string, relation string")
    links = edges.union(graph.cell_pairs(members, 8).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("nearby")))
    items = spark.createDataFrame([(p, f"hotel:{k}") for p in range(4) for k in rng.sample(range(66), 30)], "pid long, cid string")
    seeds = items.where("xxhash64(pid, cid) % 5 = 0")
    rows = lambda t: sorted(map(tuple, t.collect()))
    for hops in (0, 1, 2, 3):
        assert rows(graph.reached(items, seeds, edges, hops, members)) == rows(graph.reached(items, seeds, links, hops))
    assert rows(graph.score(edges, items, seeds, members)) == rows(graph.score(links, items, seeds))
    one = spark.createDataFrame([("hotel:0",)], "node string")
    assert rows(graph.bfs(one, edges, 2, members)) == rows(graph.bfs(one, links, 2))
    nodes = spark.range(5)
    assert sinks.graph_stats(nodes, edges, members).first() == sinks.graph_stats(nodes, links).first()


def test_no_query_of_whole_cells_keeps_a_cut():
    sql = registry.oracle_sql()
    for name in ("graph_edges", "graph_stats", "edges_with_ends", "graph_upsert_rows", "graph_statements", "bfs_2", "retrieval_runs", "module_on_off", "strong_subspace", "best_runs"):
        assert "k <= 18" not in sql[name]


def test_turns_are_dealt_and_folded_once(spark):
    df = registry.queries()["fn_normalize_marks"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array(replace(") == 1 and "RepartitionByExpression" in plan
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_last_hop_is_asked_of_starts_alone(spark):
    """The last hop is the widest; all before it, and what starts have of it, is as without the limit."""
    edges = spark.createDataFrame([(f"hotel:{k}", f"pref:tag:{k % 7}") for k in range(30)] + [(f"hotel:{k}", f"city:{k % 3}") for k in range(30)], "src string, dst string")
    ends = graph.placed_bits(spark.createDataFrame([("pref:tag:1",), ("city:2",)], "dst string")).select(F.col("dst").alias("node"), "block", "bit")
    starts = spark.createDataFrame([("hotel:3",), ("hotel:4",)], "node string")
    whole, asked = graph.spread(ends, edges, 3), graph.spread(ends, edges, 3, last=starts)
    want = whole.where("hop < 3").union(whole.where("hop = 3").join(starts, "node", "left_semi"))
    rows = lambda t: sorted(map(tuple, t.collect()))
    assert rows(asked) == rows(want) and whole.count() > asked.count()


def test_hops_and_plans_keep_no_rides(spark):
    """Edges of tags and places need no rides; a bundle with edges of its own mines no patterns and writes no ride."""
    w = World(spark, "/root/testdata/sf0.001")
    b = q_evaluation.bundle(w, q_graph.thin(w))
    assert b.slots is None and not {"_graph", "_whole", "_mined"} & set(w.__dict__)
    assert "lineitem" in str(b.transport.inputFiles())
    assert sorted(map(tuple, q_graph.thin(w).collect())) == sorted(map(tuple, q_graph.the_graph(w)[1].where("relation in ('has_tag', 'nearby')").collect()))
