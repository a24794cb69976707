"""Searches of many sources and paths of any length against breadth-first search by hand."""

import random
from collections import defaultdict, deque

import pytest

from wayfinder.operators import graph, methods


def random_graph(seed, n=60, m=80):
    rng = random.Random(seed)
    nodes = [f"hotel:{k}" for k in range(n)] + [f"city:{k}" for k in range(6)] + [f"pref:tag:{k}" for k in range(6)]
    edges = {tuple(rng.sample(nodes, 2)) for _ in range(m)}
    edges |= {(f"hotel:{k}", f"city:{k % 3}") for k in range(0, n, 2)}  # hubs
    edges |= {(f"hotel:{k}", f"hotel:{k + 1}") for k in range(200, 212)}  # a path of twelve
    around = defaultdict(set)
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    return sorted(edges), around, rng


def distances(starts, around):
    hop, todo = {s: 0 for s in starts}, deque(starts)
    while todo:
        x = todo.popleft()
        for y in around[x]:
            if y not in hop:
                hop[y] = hop[x] + 1
                todo.append(y)
    return hop


@pytest.mark.parametrize("hops", [1, 3, 4, 6, 20])
def test_reached_at_any_hops(spark, hops):
    edges, around, rng = random_graph(1)
    nodes = sorted(around)
    seeds = {pid: rng.sample(nodes, rng.randrange(1, 3)) for pid in range(150)}
    items = {pid: [x for x in rng.sample(nodes, 20) if not x.startswith("pref")] for pid in seeds}
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame([(p, x) for p, xs in seeds.items() for x in xs], "pid long, cid string")
    i = spark.createDataFrame([(p, x) for p, xs in items.items() for x in xs if x.startswith("hotel") or hops > 3], "pid long, cid string")
    got = {(r["pid"], r["cid"]): r["hop"] for r in graph.reached(i, s, e, hops).collect()}
    want = {}
    for p, xs in items.items():
        found = distances(seeds[p], around)
        want |= {(p, x): found[x] for x in xs if found.get(x, 99) <= hops and (x.startswith("hotel") or hops > 3)}
    if hops <= 3:  # the way for few hops starts at candidates
        low = {p for p in seeds if all(x.startswith("hotel") for x in seeds[p])}
        got, want = ({k: v for k, v in d.items() if k[0] in low} for d in (got, want))
    assert got == want


@pytest.mark.parametrize("most", [1, 4, 12])
def test_shortest_paths_between_any_nodes(spark, most):
    edges, around, rng = random_graph(2)
    nodes = [*sorted(around), "alone"]
    pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(400)} | {("city:0", "city:1"), ("hotel:200", "hotel:212"), ("alone", "alone")}
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {(r["src"], r["dst"]): r["path"] for r in graph.shortest_paths(spark.createDataFrame(sorted(pairs), "src string, dst string"), e, most).collect()}
    want = {}
    for a, b in pairs:
        back = distances([b], around)
        if a == b:
            want[a, b] = [a]
        elif back.get(a, 99) <= most:
            path = [a]
            while path[-1] != b:
                path.append(min(y for y in around[path[-1]] if back.get(y, 99) == back[path[-1]] - 1))
            want[a, b] = path
    assert got == want and (most < 12 or max(map(len, got.values())) == 13)


def test_more_runs_than_keys_have_room_for(spark):
    one = methods.METHODS[0]
    assert methods.table(spark, (one,) * methods.RUNS).count() == methods.RUNS
    with pytest.raises(ValueError):
        methods.table(spark, (one,) * (methods.RUNS + 1))


def test_keys_of_runs_are_exact(spark):
    runs = methods.table(spark, methods.METHODS)
    rows = spark.createDataFrame([(p,) for p in (0, 7, -3, (1 << 53) // 1000 * 997)], "pid long")
    back = methods.told(methods.keyed(rows, runs), runs.select("run", "method"))
    assert sorted((r["pid"], r["method"]) for r in back.collect()) == sorted((r["pid"], s.method) for r in rows.collect() for s in methods.METHODS)
