"""The four-layer graph as node and edge tables, and the traversals over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.functions.scratch import Scratch, cut
from wayfinder.operators.retrieval import top

# Layers, default day skeletons, what an action expects.
BUDGETS, INTENSITIES, ETYPES = ["low", "medium", "high", "premium"], ["low", "moderate", "high"], ["attraction", "restaurant", "hotel", "transport"]
FIRST_DAY = ["afternoon:transport", "afternoon:checkin", "evening:dining", "evening:sightseeing"]
LAST_DAY = ["morning:sightseeing", "afternoon:dining", "afternoon:transport"]
OTHER_DAY = ["morning:sightseeing", "noon:dining", "afternoon:sightseeing", "evening:dining"]
EXPECTS = {"dining": "restaurant", "sightseeing": "attraction", "checkin": "hotel", "transport": "transport"}
CANDIDATES = ["attraction", "restaurant", "hotel"]
CELL_MEMBERS, ROUTES, TAGS = 18, 3, 6
BLOCK = 512  # members of a cell that meet in one step


def cell() -> list[Column]:
    return [F.col("city"), (F.col("lat") * 10).cast("int").alias("cy"), (F.col("lon") * 10).cast("int").alias("cx")]


def cell_members(candidates: DataFrame) -> DataFrame:
    """The first members of each 0.1 degree cell of a city, with their `rank` in it."""
    known = candidates.where("lat is not null and lon is not null").select("cid", "ord", *cell())
    return top(known, CELL_MEMBERS, ["ord"], by=("city", "cy", "cx"))


def nearby(candidates: DataFrame) -> DataFrame:
    """`(a, b)` once for each two members of a cell; cells are capped, so the join grows with the cells."""
    m = cell_members(candidates)
    a, b = m.select("city", "cy", "cx", F.col("cid").alias("a"), F.col("rank").alias("ra")), m.select("city", "cy", "cx", F.col("cid").alias("b"), F.col("rank").alias("rb"))
    return a.join(b, ["city", "cy", "cx"]).where("ra < rb").select("a", "b")


def whole_cells(candidates: DataFrame) -> DataFrame:
    """`(cid, cell, size)`: all members of the cells, with how many a cell has. A cell links all its members without a row for each link."""
    known = candidates.where("city is not null and lat is not null and lon is not null")
    m = cut(known.select("cid", F.concat_ws("/", *(c.cast("string") for c in cell())).alias("cell")).distinct())
    return cut(m.join(m.groupBy("cell").agg(F.count("*").alias("size")), "cell").select("cid", "cell", "size"))


def cell_pairs(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(a, b)` with a < b for each two members of a cell, none left out: blocks of a cell meet each other, so no task holds a whole cell."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    m = cells.withColumn("_n", blocks).withColumn("_at", F.pmod(F.xxhash64("cid"), F.col("_n")).cast("int"))
    dealt = m.select("cid", "cell", "_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
    dealt = dealt.select("cid", "cell", "_at", F.least("_at", "_other").alias("_i"), F.greatest("_at", "_other").alias("_j"))
    low, high = dealt.where("_at = _i").select("cell", "_i", "_j", F.col("cid").alias("x")), dealt.where("_at = _j").select("cell", "_i", "_j", F.col("cid").alias("y"))
    met = low.join(high, ["cell", "_i", "_j"]).where("_i < _j or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def cell_links(cells: DataFrame) -> DataFrame:
    """How many links cells make."""
    return cells.groupBy("cell").agg(F.first("size").alias("size")).select((F.col("size") * (F.col("size") - 1) / 2).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def cheapest_routes(transport: DataFrame) -> DataFrame:
    price = F.when(F.coalesce(F.col("price"), F.lit(0.0)) != 0, F.col("price")).otherwise(F.lit(999999.0))
    return top(transport, ROUTES, [price, "number"], by=("from_city",))


def default_tokens(day: Column, days: Column) -> Column:
    listed = lambda x: F.array(*map(F.lit, x))
    return F.when(day == 1, listed(FIRST_DAY)).when(day == days, listed(LAST_DAY)).otherwise(listed(OTHER_DAY))


def skeletons(spark, patterns: DataFrame | None = None) -> DataFrame:
    """`(days, day, slot, token)` for trips of 2 to 7 days: the best mined pattern, else the default."""
    base = spark.range(2, 8).select(F.col("id").alias("days"))
    if patterns is None:
        base = base.withColumn("signature", F.lit(None).cast("array<array<string>>"))
    else:
        base = base.join(patterns.where("rank = 1").select(F.col("day_count").alias("days"), "signature"), "days", "left")
    usual = F.transform(F.sequence(F.lit(1), F.col("days").cast("int")), lambda d: default_tokens(d, F.col("days").cast("int")))
    days = base.select("days", F.posexplode(F.coalesce("signature", usual)).alias("day", "tokens"))
    slots = days.select("days", (F.col("day") + 1).alias("day"), F.posexplode("tokens").alias("slot", "token"))
    return slots.select("days", "day", (F.col("slot") + 1).alias("slot"), "token")


def _edge(a: Column, b: Column, relation: str) -> list[Column]:
    return [a.alias("a"), b.alias("b"), F.lit(relation).alias("relation")]


def _city(name: Column) -> Column:
    return F.concat(F.lit("city:"), text.slugify(name))


def _names(candidates: DataFrame) -> DataFrame:
    """`(node, kind, name)` of the cities and first tags that candidates have: a name is folded once, not once a candidate."""
    known = F.array_compact(F.concat(F.array(F.struct(F.lit("city:").alias("kind"), F.col("city").alias("name"))), F.transform(F.coalesce(F.slice("tags", 1, TAGS), F.array().cast("array<string>")), lambda t: F.struct(F.lit("pref:tag:").alias("kind"), t.alias("name")))))
    names = candidates.select(F.explode(known).alias("x")).select("x.*").distinct()
    return cut(names.select(F.concat("kind", text.slugify(F.col("name"))).alias("node"), "kind", "name"))


def _undirected(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "relation").distinct()


def _slim(candidates: DataFrame) -> DataFrame:
    """What links are made from, as a table: several steps read it."""
    return cut(candidates.select("cid", "ord", "etype", "city", "name", "price", "lat", "lon", F.slice("tags", 1, TAGS).alias("tags")))


def own_links(candidates: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Links `(a, b, relation)` of a candidate to what is no candidate; `names` is `_names` of these candidates or of more."""
    names = _names(candidates) if names is None else names
    link = lambda kind, name, relation: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(relation).alias("relation"))
    fixed = [link("etype:", F.col("etype"), "is_type"), link("pref:budget:", text.price_bucket(F.col("price")), "fits_budget")]
    usual = F.when(F.col("etype") == "attraction", link("pref:intensity:", F.lit("moderate"), "default_intensity"))
    tags = F.transform(F.coalesce(F.slice("tags", 1, TAGS), F.array().cast("array<string>")), lambda t: link("pref:tag:", t, "has_tag"))
    rows = candidates.select(F.col("cid").alias("a"), F.explode(F.array_compact(F.concat(F.array(link("city:", F.col("city"), "in_city"), *fixed, usual), tags))).alias("x")).select("a", "x.*")
    named = F.col("relation").isin("in_city", "has_tag")
    at = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("name").eqNullSafe(F.col("_name"))
    folded = rows.where(named).join(names.select("node", F.col("kind").alias("_kind"), F.col("name").alias("_name")), at)
    plain = rows.where(~named).select("a", F.concat("kind", "name").alias("b"), "relation")
    return folded.select("a", F.col("node").alias("b"), "relation").union(plain)


def candidate_links(candidates: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """All links `(a, b, relation)` that a candidate has: its own, and those to its neighbours."""
    return own_links(candidates, names).union(nearby(candidates).select(*_edge(F.col("a"), F.col("b"), "nearby")))


def candidate_edges(candidates: DataFrame, cids: DataFrame | None = None, near: bool = True) -> DataFrame:
    """The edges that scores of candidates read: those that end at one, or at one of `cids(cid)`. Cells are filled from all candidates; without `near`, `whole_cells` has their links."""
    slim = _slim(candidates)
    if cids is None:
        return _undirected(candidate_links(slim) if near else own_links(slim))
    asked = cut(cids.select("cid").distinct())
    if not near:
        return _undirected(own_links(slim.join(asked, "cid", "left_semi")))
    end = lambda c: asked.select(F.col("cid").alias(c))
    near = nearby(slim)
    near = near.join(end("a"), "a", "left_semi").union(near.join(end("b"), "b", "left_semi").select("a", "b"))
    return _undirected(own_links(slim.join(asked, "cid", "left_semi")).union(near.select(*_edge(F.col("a"), F.col("b"), "nearby"))))


def build(candidates: DataFrame, specs: DataFrame, transport: DataFrame, patterns: DataFrame | None = None, near: bool = True) -> tuple[DataFrame, DataFrame]:
    """`nodes(node, layer, kind, label)` and `edges(src, dst, relation)`, an undirected edge once with src < dst. Without `near`, `whole_cells` has the links of neighbours."""
    spark, candidates = candidates.sparkSession, _slim(candidates)
    node = lambda id_, layer, kind, label: [id_.alias("node"), F.lit(layer).alias("layer"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), label.alias("label")]
    city_id = _city
    cities = specs.select(F.col("departure").alias("c")).union(specs.select("destination")).union(candidates.select("city")).where("c <> ''").distinct()
    fixed = [(f"etype:{x}", 2, "etype", x) for x in ETYPES] + [(f"pref:budget:{x}", 3, "preference", f"budget_{x}") for x in BUDGETS] + [(f"pref:intensity:{x}", 3, "preference", f"intensity_{x}") for x in INTENSITIES]
    t = cheapest_routes(transport).withColumn("tnode", F.concat_ws(":", F.lit("transport"), "mode", text.slugify(F.col("number")), text.slugify(F.col("from_city")), text.slugify(F.col("to_city"))))
    names = _names(candidates)
    s = skeletons(spark, patterns)
    pattern_id = F.concat(F.lit("pattern:days:"), F.col("days").cast("string"))
    slot_id = F.concat_ws(":", F.lit("pattern_slot"), F.col("days").cast("string"), F.col("day").cast("string"), F.col("slot").cast("string"), text.slugify(F.col("token")))
    nodes = (
        cities.select(*node(city_id(F.col("c")), 1, "city", F.col("c")))
        .union(t.select(*node(F.col("tnode"), 1, "transport", F.concat(F.upper("mode"), F.lit(" "), "number"))))
        .union(spark.createDataFrame(fixed, "node string, layer int, kind string, label string"))
        .union(candidates.select(*node(F.col("cid"), 2, F.col("etype"), F.col("name"))))
        .union(names.where("kind = 'pref:tag:'").select(*node(F.col("node"), 3, "preference", F.col("name"))))
        .union(s.select(*node(pattern_id, 4, "pattern", F.concat(F.col("days").cast("string"), F.lit("-day skeleton")))))
        .union(s.select(*node(slot_id, 4, "pattern_slot", F.col("token"))))
    )
    nodes = nodes.groupBy("node").agg(F.min(F.struct("layer", "kind", "label")).alias("x")).select("node", "x.*")
    action = F.substring_index("token", ":", -1)
    expects = F.element_at(F.create_map(*(F.lit(x) for kv in EXPECTS.items() for x in kv)), action)
    links = (
        t.select(*_edge(city_id(F.col("from_city")), F.col("tnode"), "departs"))
        .union(t.select(*_edge(F.col("tnode"), city_id(F.col("to_city")), "arrives")))
        .union(candidate_links(candidates, names) if near else own_links(candidates, names))
        .union(s.select(*_edge(pattern_id, slot_id, "contains")))
        .union(s.select(*_edge(slot_id, F.concat(F.lit("etype:"), expects), "expects")))
    )
    return nodes, _undirected(links)


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    end = lambda name: nodes.select(F.col("node").alias(name))
    return edges.join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi").select(*edges.columns)


def directed(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(seeds: DataFrame, edges: DataFrame, hops: int, cells: DataFrame | None = None) -> DataFrame:
    """`(node, hop)`, the hop at which each node is first reached; `seeds(node)` have hop 0. `cells(cid, cell)` link all their members."""
    steps = directed(edges)
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        new = front.select(F.col("node").alias("src")).join(steps, "src").select(F.col("dst").alias("node"))
        if cells is not None:  # a cell is reached once, then all of it
            at = front.select(F.col("node").alias("cid")).join(cells, "cid").select("cell").distinct()
            new = new.union(cells.join(at, "cell", "left_semi").select(F.col("cid").alias("node")))
        front = cut(new.distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(front)
    return seen


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`(node, component)`: the least node of each connected part of `nodes`, through edges among them.

    Labels spread along edges and then jump to the label of their label, so long paths halve each round.
    """
    inside = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    scratch = Scratch(edges.sparkSession, "components")
    steps = scratch.cut(directed(inside), "steps")
    now, k = scratch.cut(nodes.select("node", F.col("node").alias("component")).distinct(), "labels-0"), 1
    while True:
        near = steps.join(now.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        spread = now.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", F.least("component", "near").alias("component"))
        jump = spread.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = scratch.cut(spread.join(jump, "component", "left").select("node", F.coalesce(F.least("component", "far"), "component").alias("component")), f"labels-{k}")
        if new.join(now, ["node", "component"], "left_anti").isEmpty():
            return new
        scratch.drop(f"labels-{k - 1}")
        now, k = new, k + 1


def is_candidate(node: Column) -> Column:
    """Whether a node is something to visit or stay at. Such nodes have few edges; a hub may have any number."""
    return F.substring_index(node, ":", 1).isin(*CANDIDATES)


def bfs_by(seeds: DataFrame, edges: DataFrame, hops: int, candidate_only: bool = False) -> DataFrame:
    """`(pid, node, hop)` from `seeds(pid, node)` of each request. Whole neighbourhoods, hubs included; `reached` asks only for given items."""
    steps = directed(edges)
    seen = seeds.select("pid", "node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        new = front.select("pid", F.col("node").alias("src")).join(steps, "src").select("pid", F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen, ["pid", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where(is_candidate(F.col("node")) | (F.col("hop") == 0)) if candidate_only else seen


def placed_bits(keys: DataFrame) -> DataFrame:
    """The distinct rows of `keys` with `block` and `bit`: 64 keys share a block, as the bits of a number."""
    keys = cut(keys.distinct())
    buckets = max(1, keys.count() // 4096)
    bucket = F.pmod(F.xxhash64(*keys.columns), F.lit(buckets))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys.columns)) - 1
    rows = keys.withColumn("_bucket", bucket).withColumn("_nth", nth)
    return cut(rows.select(*keys.columns, (F.col("_bucket") + buckets * F.shiftright("_nth", 6)).cast("long").alias("block"), F.col("_nth").bitwiseAND(63).alias("bit")))


def one_bit(bit: str = "bit") -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit))


def spread(starts: DataFrame, edges: DataFrame, hops: int, pairs: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
    """`(node, block, hop, bits)` from `starts(node, block, bit)`: the keys that first reach a node at a hop.

    All keys go at once, 64 to a row: a hub that all keys pass is a row for each block, and its
    neighbours take the bits of a block in one step. `pairs(src, dst)`, in both directions, are two hops apart.
    `last(node)`: the only nodes that the last hop is asked for.
    """
    steps = cut(directed(edges))
    front = cut(starts.groupBy("node", "block").agg(F.bit_or(one_bit()).alias("bits")))
    levels, before = front.withColumn("hop", F.lit(0)), None
    via = lambda rows, links: rows.withColumnRenamed("node", "src").join(links, "src").select(F.col("dst").alias("node"), "block", "bits")
    for hop in range(1, hops + 1):
        seen = levels.groupBy("node", "block").agg(F.bit_or("bits").alias("_seen"))
        new = via(front, steps if last is None or hop < hops else steps.join(last.select(F.col("node").alias("dst")), "dst", "left_semi"))
        if pairs is not None and before is not None:
            new = new.union(via(before, pairs))
        new = new.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
        before, front = front, cut(new.join(seen, ["node", "block"], "left").select("node", "block", fresh.alias("bits")).where("bits <> 0"))
        if front.isEmpty() and (pairs is None or before.isEmpty()):
            break
        levels = levels.unionByName(front.withColumn("hop", F.lit(hop)))
    return cut(levels)


def far(mine: DataFrame, start: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """`(pid, cid, hop)` of `mine(pid, cid)` within any number of hops of `start(pid, node)`.

    A path that passes a hub is a way to the hub and a way on from it, so requests need not spread:
    hubs do, as bits, over hubs and the candidates with links to candidates. Other candidates only
    join their hubs: hubs that share one are two hops apart, and it has what its hubs have, a hop
    later. A request brings what its seeds reach as one row, so an item stays one row. Ways without
    a hub go from candidate to candidate, once for each seed. Where requests are fewer than hubs,
    requests spread.
    """
    steps = cut(directed(edges))
    low = is_candidate
    hubs = cut(steps.where(~low(F.col("src"))).select(F.col("src").alias("node")).distinct())
    asked = cut(start.select("pid").distinct())
    if asked.count() < hubs.count():
        bits = placed_bits(asked)
        found = spread(start.join(bits, "pid").select("node", "block", "bit"), edges, hops)
        at = mine.join(bits, "pid").join(found.withColumnRenamed("node", "cid"), ["cid", "block"])
        return at.where(F.col("bits").bitwiseAND(one_bit()) != 0).select("pid", "cid", "hop")
    bits = placed_bits(hubs)
    inner = steps.where(low(F.col("src")) & low(F.col("dst")))
    linked = cut(inner.select(F.col("src").alias("node")).distinct())
    own = steps.where(low(F.col("src")) & ~low(F.col("dst")))
    sets = own.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("hubs")).select("hubs").distinct()  # a candidate has few
    pairs = cut(sets.select("hubs", F.explode("hubs").alias("src")).select("src", F.explode("hubs").alias("dst")).where("src <> dst").distinct())
    of_linked = own.join(linked.withColumnRenamed("node", "src"), "src", "left_semi")
    found = spread(bits, steps.where(~low(F.col("src")) & ~low(F.col("dst"))).union(inner).union(of_linked), hops, pairs)
    loose = lambda nodes: own.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(linked.withColumnRenamed("node", "src"), "src", "left_anti")
    reach = loose(start).select(F.col("src").alias("_node"), F.col("dst").alias("node")).join(found, "node").groupBy(F.col("_node").alias("node"), "block", (F.col("hop") + 1).alias("hop")).agg(F.bit_or("bits").alias("bits"))
    reach = reach.unionByName(found.join(start.select("node").distinct(), "node", "left_semi"))
    reach = start.join(reach.where(F.col("hop") <= hops), "node").groupBy("pid", "block", "hop").agg(F.bit_or("bits").alias("bits"))
    reach = reach.groupBy("pid").agg(F.collect_list(F.struct("block", "hop", "bits")).alias("reach"))
    ends = mine.select(F.col("cid").alias("node")).distinct()
    tails = loose(ends).select(F.col("src").alias("_node"), F.col("dst").alias("node")).join(bits, "node").groupBy(F.col("_node").alias("node"), "block", F.lit(1).alias("hop")).agg(F.bit_or(one_bit()).alias("bits"))
    tails = tails.unionByName(found.join(ends, "node", "left_semi")).groupBy(F.col("node").alias("cid")).agg(F.collect_list(F.struct("block", "hop", "bits")).alias("tails"))
    meet = lambda x: F.transform(F.filter("reach", lambda y: (y["block"] == x["block"]) & (y["bits"].bitwiseAND(x["bits"]) != 0)), lambda y: x["hop"] + y["hop"])
    over = mine.join(tails, "cid").join(reach, "pid").select("pid", "cid", F.array_min(F.flatten(F.transform("tails", meet))).alias("hop"))
    origins = start.join(linked, "node", "left_semi").select("node").distinct()
    around = bfs_by(origins.select(F.col("node").alias("pid"), "node"), inner, hops)
    plain = start.join(around.select(F.col("pid").alias("node"), F.col("node").alias("cid"), "hop"), "node").join(mine, ["pid", "cid"], "left_semi").select("pid", "cid", "hop")
    same = mine.join(start.withColumnRenamed("node", "cid"), ["pid", "cid"]).select("pid", "cid", F.lit(0).alias("hop"))
    return over.union(plain).union(same).where(F.col("hop") <= hops).groupBy("pid", "cid").agg(F.min("hop").alias("hop"))


def reached(items: DataFrame, seeds: DataFrame, edges: DataFrame, hops: int = 3, cells: DataFrame | None = None) -> DataFrame:
    """`(pid, cid, hop)` of items within `hops` of a seed of their request. `cells(cid, cell, size)` link all their
    members and `edges` then link none: up to two hops cells stay cells, beyond their links are made.

    Up to three hops, steps from the seeds and steps from the items meet in the middle, by request
    and node, so that a hub such as a city is never followed to all that hangs on it. Beyond, see `far`.
    """
    mine = items.select("pid", "cid").distinct()
    start = seeds.select("pid", F.col("cid").alias("node")).distinct()
    if cells is not None and hops > 2:
        links = cell_pairs(cells).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        return reached(items, seeds, edges.select("src", "dst").union(links), hops)
    if hops > 3:
        return far(mine, start, edges, hops)
    steps = cut(directed(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    found = mine.join(start.withColumnRenamed("node", "cid"), ["pid", "cid"]).withColumn("hop", F.lit(0))
    around = cut(mine.join(steps, F.col("cid") == F.col("a")).select("pid", "cid", F.col("b").alias("node")))
    after = cut(start.join(steps, F.col("node") == F.col("a")).select("pid", F.col("b").alias("node")).distinct())
    met = lambda front, hop: around.join(front, ["pid", "node"]).select("pid", "cid").distinct().withColumn("hop", F.lit(hop))
    parts = [found, met(start, 1), met(after, 2)][: hops + 1]
    if cells is not None and hops:
        at = cells.select("cid", "cell")
        near = start.select("pid", F.col("node").alias("cid")).join(at, "cid").select("pid", "cell").distinct()
        parts.append(mine.join(at, "cid").join(near, ["pid", "cell"], "left_semi").select("pid", "cid", F.lit(1).alias("hop")))
    if hops == 3:
        low = is_candidate(F.col("node"))
        on = lambda rows, s: rows.join(s, F.col("node") == F.col("a"))
        hubs = steps.where(~is_candidate(F.col("a")) & ~is_candidate(F.col("b")))
        onward = on(after.where(low), steps).union(on(after.where(~low), hubs)).select("pid", F.col("b").alias("node")).distinct()
        back = on(around.where(low), steps).select("pid", "cid", F.col("b").alias("node")).distinct()
        parts += [met(onward, 3), back.join(after, ["pid", "node"]).select("pid", "cid").distinct().withColumn("hop", F.lit(3))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("pid", "cid").agg(F.min("hop").alias("hop"))


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """For `pairs(src, dst)` of any nodes the shortest path up to `max_hops`, the least in order among equals: `(src, dst, hops, path)`.

    All distinct ends spread at once as bits. Then every start walks towards its end: of the
    neighbours that are one hop nearer the least, found once for each node and end that walks pass.
    """
    goals = cut(pairs.select("src", "dst").where("src is not null and dst is not null").distinct())
    ends = placed_bits(goals.where("src <> dst").select("dst"))
    asked = cut(goals.where("src <> dst").select(F.col("src").alias("node")).distinct())  # walks begin there, and pass others with hops to go
    far = spread(ends.select(F.col("dst").alias("node"), "block", "bit"), edges, max_hops, last=asked)
    steps = cut(directed(edges))
    walks = goals.join(ends, "dst").join(far.withColumnRenamed("node", "src"), ["src", "block"]).where((F.col("bits").bitwiseAND(one_bit()) != 0) & (F.col("hop") > 0))
    walks = cut(walks.select("src", "dst", "block", "bit", F.col("hop").alias("hops"), F.col("src").alias("at"), F.col("hop").alias("left"), F.array("src").alias("path")))
    done = goals.where("src = dst").select("src", "dst", F.lit(0).alias("hops"), F.array("src").alias("path"))
    for _ in range(max_hops):
        asked = walks.groupBy(F.col("at").alias("src"), "block", (F.col("left") - 1).alias("hop")).agg(F.bit_or(one_bit()).alias("_asked"))
        near = asked.join(steps, "src").join(far.withColumnRenamed("node", "dst"), ["dst", "block", "hop"])
        near = near.withColumn("_both", F.col("bits").bitwiseAND(F.col("_asked"))).where("_both <> 0")
        hit = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("_both"), i) == 1)
        near = near.select("src", "block", "hop", "dst", F.explode(hit).alias("bit")).groupBy(F.col("src").alias("at"), "block", "bit", (F.col("hop") + 1).alias("left")).agg(F.min("dst").alias("next"))
        walks = walks.join(near, ["at", "block", "bit", "left"]).select("src", "dst", "block", "bit", "hops", F.col("next").alias("at"), (F.col("left") - 1).alias("left"), F.concat("path", F.array("next")).alias("path"))
        walks = cut(walks)
        done = done.union(walks.where("left = 0").select("src", "dst", "hops", "path"))
        walks = walks.where("left > 0")
    return done


def path_evidence(items: DataFrame, edges: DataFrame, most: int = 3, max_hops: int = 3) -> DataFrame:
    """`(pid, cid, paths)`: the paths of items to the request's city and first three interests, joined by arrows, the first `most` there are."""
    city = F.concat(F.lit("city:"), text.slugify(F.col("destination")))
    tags = F.transform(F.slice("interests", 1, 3), lambda x: F.concat(F.lit("pref:tag:"), text.slugify(x)))
    asked = cut(items.select("pid", "cid", F.posexplode(F.concat(F.array(city), F.coalesce(tags, F.array().cast("array<string>")))).alias("at", "dst")))
    found = shortest_paths(asked.select(F.col("cid").alias("src"), "dst"), edges, max_hops)
    rows = asked.join(found.select(F.col("src").alias("cid"), "dst", F.array_join("path", " -> ").alias("said")), ["cid", "dst"])
    told = rows.groupBy("pid", "cid").agg(F.sort_array(F.collect_list(F.struct("at", "said"))).alias("p"))  # four rows at most
    return told.select("pid", "cid", F.slice(F.transform("p", lambda x: x["said"]), 1, most).alias("paths"))


def ties(edges: DataFrame, cids: DataFrame, seeds: DataFrame) -> DataFrame:
    """What the graph score asks of each of `cids(cid)`, a row for each: `(cid, degree, fixed, near)`, `near` being the neighbours that are a seed of any request."""
    own = cids.select("cid").distinct()
    steps = directed(edges).join(own.withColumnRenamed("cid", "src"), "src", "left_semi")
    steps = steps.join(seeds.select(F.col("cid").alias("dst")).distinct().withColumn("_seed", F.lit(True)), "dst", "left")
    fixed = F.when(F.col("dst").startswith("etype:"), 1.0).otherwise(0.0) + F.when(F.col("dst").startswith("pref:"), 0.7).otherwise(0.0)
    return steps.groupBy(F.col("src").alias("cid")).agg(F.count("dst").alias("degree"), F.sum(fixed).alias("fixed"), F.collect_list(F.when(F.col("_seed"), F.col("dst"))).alias("near"))


def tied(degree: Column, fixed: Column, hits: Column, is_seed: Column) -> Column:
    """Weighed links to seeds, types and preferences over the degree, more for seeds; at most 1.5."""
    value = F.least(F.lit(1.5), (fixed + 1.5 * hits) / F.greatest(degree, F.lit(1)) + F.when(is_seed, 0.35).otherwise(0.0))
    return F.round(F.when(degree > 0, value).otherwise(0.0), 8)


def mates(cells: Column, at: Column, is_seed: Column) -> Column:
    """How many of a request's seeds, each with its cell in `cells`, share the cell `at` with an item, itself left out."""
    found = F.size(F.filter(cells, lambda x: x == at)) - is_seed.cast("int")
    return F.when(at.isNotNull() & cells.isNotNull(), F.greatest(found, F.lit(0))).otherwise(0)


def score(edges: DataFrame, items: DataFrame, seeds: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """`(pid, cid, graph)`: see `tied`. Links are counted once a candidate; a request brings its seeds as one array, so an item stays one row. `cells` as in `reached`."""
    per = ties(edges, items, seeds)
    if cells is None:
        mine = seeds.groupBy("pid").agg(F.collect_set("cid").alias("_seeds"))
    else:
        per = items.select("cid").distinct().join(per, "cid", "left").join(cells, "cid", "left")
        per = per.withColumn("degree", F.coalesce("degree", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).drop("size")
        mine = seeds.select("pid", "cid").distinct().join(cells.select("cid", F.col("cell").alias("_cell")), "cid", "left")
        mine = mine.groupBy("pid").agg(F.collect_set("cid").alias("_seeds"), F.collect_list("_cell").alias("_cells"))
    rows = items.select("pid", "cid").distinct().join(per, "cid", "left").join(mine, "pid", "left")
    hits = F.coalesce(F.size(F.array_intersect("near", "_seeds")), F.lit(0))
    if cells is not None:
        hits = F.greatest(hits, F.lit(0)) + mates(F.col("_cells"), F.col("cell"), F.coalesce(F.array_contains("_seeds", F.col("cid")), F.lit(False)))
    known = F.coalesce(F.col("degree"), F.lit(0))
    return rows.select("pid", "cid", tied(known, F.coalesce("fixed", F.lit(0.0)), F.greatest(hits, F.lit(0)), F.coalesce(F.array_contains("_seeds", F.col("cid")), F.lit(False))).alias("graph"))


def communities(items: DataFrame, candidates: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """`(pid, cid, community)`: items of one cell are linked pairwise, all others stand alone. `cells`: those to use instead of the first members."""
    if cells is not None:
        return items.select("pid", "cid").join(cells.select("cid", "cell"), "cid", "left").select("pid", "cid", F.coalesce("cell", "cid").alias("community"))
    m = cell_members(candidates).select("cid", F.concat_ws("/", "city", F.col("cy").cast("string"), F.col("cx").cast("string")).alias("cell"))
    return items.select("pid", "cid").join(m, "cid", "left").select("pid", "cid", F.coalesce("cell", "cid").alias("community"))


def keep_communities(items: DataFrame, candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """Items in the communities that hold the most seeds; where none holds any, in the largest one."""
    c = communities(items, candidates).join(seeds.select("pid", "cid", F.lit(1).alias("hit")), ["pid", "cid"], "left")
    sized = c.groupBy("pid", "community").agg(F.count("hit").alias("overlap"), F.count("*").alias("size"))
    w = Window.partitionBy("pid")
    sized = sized.withColumn("best", F.max("overlap").over(w)).withColumn("largest", F.row_number().over(w.orderBy(F.desc("overlap"), F.desc("size"), "community")))
    kept = sized.where("(best > 0 and overlap = best) or (best = 0 and largest = 1)").select("pid", "community")
    return c.join(kept, ["pid", "community"]).select("pid", "cid", "community")

