"""Queries of the graph and its traversals, and of graph sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfinder.functions.scratch import cut
from wayfinder.operators import graph, methods, patterns, sinks
from wayfinder.operators import retrieval as R
from wayfinder.plans.q_retrieval import CELLS, FUSED, SEED, WHOLE_CELLS, scored
from wayfinder.plans.q_text import PATTERNS, itineraries
from wayfinder.plans.registry import query

SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'na')"
MINED = f"mined as (select signature from ({PATTERNS}) where rank = 1)"
NODES = f"""{CELLS},
ways as (select * from (select *, row_number() over (partition by from_city order by case when price <> 0 then price else 999999 end, number) as k from transport) where k <= 3),
tn as (select *, 'transport:' || mode || ':' || number || ':' || {SLUG.format('from_city')} || ':' || {SLUG.format('to_city')} as node from ways),
tags as (select cid, unnest(tags[1:6]) as tag from cand),
{MINED},
sk0 as (select d as days, unnest(range(1, d + 1)) as day from range(2, 8) t(d)),
sk1 as (select days, day, case when days = 3 and exists (select 1 from mined) then string_split(string_split((select signature from mined), '/')[day], ',') when day = 1 then ['afternoon:transport', 'afternoon:checkin', 'evening:dining', 'evening:sightseeing'] when day = days then ['morning:sightseeing', 'afternoon:dining', 'afternoon:transport'] else ['morning:sightseeing', 'noon:dining', 'afternoon:sightseeing', 'evening:dining'] end as toks from sk0),
sk as (select days, day, unnest(range(1, len(toks) + 1)) as slot, unnest(toks) as token from sk1),
slots as (select *, 'pattern:days:' || days as pat, 'pattern_slot:' || days || ':' || day || ':' || slot || ':' || replace(token, ':', '-') as node, string_split(token, ':')[2] as act from sk),
nodes0 as (select distinct 'city:' || {SLUG.format('city')} as node, 1 as layer, 'city' as kind from (select departure as city from spec union select destination from spec union select city from cand)
  union select node, 1, 'transport' from tn union select 'etype:' || unnest(['attraction', 'restaurant', 'hotel', 'transport']), 2, 'etype' union select 'pref:budget:' || unnest(['low', 'medium', 'high', 'premium']), 3, 'preference'
  union select 'pref:intensity:' || unnest(['low', 'moderate', 'high']), 3, 'preference' union select cid, 2, etype from cand union select 'pref:tag:' || {SLUG.format('tag')}, 3, 'preference' from tags union select pat, 4, 'pattern' from slots union select node, 4, 'pattern_slot' from slots),
links as (select 'city:' || {SLUG.format('from_city')} as a, node as b, 'departs' as relation from tn union all select node, 'city:' || {SLUG.format('to_city')}, 'arrives' from tn union all select cid, 'city:' || {SLUG.format('city')}, 'in_city' from cand
  union all select cid, 'etype:' || etype, 'is_type' from cand union all select cid, 'pref:budget:' || case when price <= 50 then 'low' when price <= 150 then 'medium' when price <= 300 then 'high' else 'premium' end, 'fits_budget' from cand
  union all select cid, 'pref:intensity:moderate', 'default_intensity' from cand where etype = 'attraction' union all select cid, 'pref:tag:' || {SLUG.format('tag')}, 'has_tag' from tags union all select pat, node, 'contains' from slots
  union all select node, 'etype:' || case act when 'dining' then 'restaurant' when 'sightseeing' then 'attraction' when 'checkin' then 'hotel' else 'transport' end, 'expects' from slots union all select a, b, 'nearby' from near where a < b),
gedges as (select distinct least(a, b) as src, greatest(a, b) as dst, relation from links)"""
STEP = f"{NODES}, step as (select distinct src as x, dst as y from gedges union select dst, src from gedges)"
WHOLE_NODES, WHOLE_STEP = NODES.replace(CELLS, WHOLE_CELLS), STEP.replace(CELLS, WHOLE_CELLS)



def mined(w):
    """The day patterns of all reference itineraries, a row for each of the best of a trip length."""
    if "_mined" not in w.__dict__:
        w.__dict__["_mined"] = cut(patterns.mine(itineraries(w)))
    return w.__dict__["_mined"]


def the_graph(w):
    """The graph of a World; kept per World object, since several operators of one query use it."""
    if "_graph" not in w.__dict__:
        nodes, edges = graph.build(w.candidates, w.specs, w.transport, mined(w))
        w.__dict__["_graph"] = nodes, cut(edges)
    return w.__dict__["_graph"]


def the_whole(w):
    """The graph whose cells link all their members: nodes, all other edges, and the cells."""
    if "_whole" not in w.__dict__:
        nodes, edges = graph.build(w.candidates, w.specs, w.transport, mined(w), near=False)
        w.__dict__["_whole"] = nodes, cut(edges), graph.whole_cells(w.candidates)
    return w.__dict__["_whole"]


def neighbours(w):
    """The links of neighbours as edges, each once."""
    return graph.cell_pairs(the_whole(w)[2]).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("nearby").alias("relation"))


@query("geo_nearby_edges", "a string, b string", "select least(a, b) as a, greatest(a, b) as b from near where a < b", CELLS)
def _near(w):
    return graph.nearby(w.candidates).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query("cell_first18", "cid string, city string, rank long", "select cid, city, k as rank from cellm", CELLS)
def _cell(w):
    return graph.cell_members(w.candidates)


@query("cheapest3_per_city", "from_city string, number string, price double, rank long", "select from_city, number, price, k as rank from ways", NODES)
def _cheap(w):
    return graph.cheapest_routes(w.transport)


@query("graph_nodes", "node string, layer long, kind string", "select * from nodes0", NODES)
def _nodes(w):
    return the_graph(w)[0]


@query("graph_edges", "src string, dst string, relation string", "select * from gedges", WHOLE_NODES)
def _edges(w):
    return the_whole(w)[1].unionByName(neighbours(w))


@query("graph_stats", "nodes long, edges long, degree_max long", "select (select count(*) from nodes0) as nodes, (select count(*) from (select distinct src, dst from gedges)) as edges, (select max(d) from (select count(*) as d from step group by x)) as degree_max", WHOLE_STEP)
def _stats(w):
    return sinks.graph_stats(*the_whole(w))


@query("edges_with_ends", "relation string, n long", "select relation, count(*) as n from gedges join nodes0 a on a.node = src join nodes0 b on b.node = dst where a.layer <= 2 and b.layer <= 2 group by relation", WHOLE_NODES)
def _ends(w):
    """Edges inside the first two layers, by their ends; those of cells are counted, not made."""
    nodes, edges, cells = the_whole(w)
    low = cut(nodes.where("layer <= 2"))
    both = cells.join(low.select(F.col("node").alias("cid")), "cid", "left_semi").withColumn("size", F.count("*").over(Window.partitionBy("cell")))
    return graph.with_ends(edges, low).groupBy("relation").agg(F.count("*").alias("n")).union(graph.cell_links(both).where("n > 0").select(F.lit("nearby"), "n"))


@query("graph_upsert_rows", "label string, relation string, nodes long, edges long", """select label, relation, sum(n) as nodes, sum(e) as edges from (
  select case kind when 'city' then 'City' when 'transport' then 'Transport' when 'attraction' then 'Attraction' when 'restaurant' then 'Restaurant' when 'hotel' then 'Hotel' when 'etype' then 'EntityType' when 'preference' then 'Preference' when 'pattern' then 'Pattern' else 'PatternSlot' end as label, null as relation, 1 as n, 0 as e from nodes0
  union all select null, upper(relation), 0, 1 from gedges) group by label, relation""", WHOLE_NODES)
def _upsert(w):
    nodes, edges, cells = the_whole(w)
    n = nodes.groupBy(sinks.node_label(F.col("kind")).alias("label")).agg(F.count("*").alias("nodes"))
    e = sinks.canonical_edges(edges).groupBy(sinks.relation_type(F.col("relation")).alias("relation")).agg(F.count("*").alias("edges"))
    e = e.union(graph.cell_links(cells).where("n > 0").select(sinks.relation_type(F.lit("nearby")), "n"))
    return n.select("label", F.lit(None).cast("string").alias("relation"), "nodes", F.lit(0).alias("edges")).union(e.select(F.lit(None).cast("string"), "relation", F.lit(0), "edges"))


@query("graph_statements", "kind string, statement string", """select 'edge' as kind, 'MATCH (a:GraphNode {node_id: ' || to_json(src) || '}), (b:GraphNode {node_id: ' || to_json(dst) || '}) MERGE (a)-[r:`' || upper(relation) || '`]->(b);' as statement from gedges
  union all select 'node', 'MERGE (n:GraphNode:`' || case kind when 'etype' then 'EntityType' when 'pattern_slot' then 'PatternSlot' else upper(kind[1]) || kind[2:] end || '` {node_id: ' || to_json(node) || '}) SET n += {label: ' || to_json(label) || ', layer: ' || layer || ', node_type: ' || to_json(kind) || '};' from labelled""",
       WHOLE_NODES + f""", labels0 as (select 'city:' || {SLUG.format('city')} as node, city as label from (select departure as city from spec union select destination from spec union select city from cand)
  union all select node, upper(mode) || ' ' || number from tn union all select 'etype:' || x, x from (select unnest(['attraction', 'restaurant', 'hotel', 'transport']) as x) union all select 'pref:budget:' || x, 'budget_' || x from (select unnest(['low', 'medium', 'high', 'premium']) as x)
  union all select 'pref:intensity:' || x, 'intensity_' || x from (select unnest(['low', 'moderate', 'high']) as x) union all select cid, name from cand union all select 'pref:tag:' || {SLUG.format('tag')}, tag from tags union all select pat, days || '-day skeleton' from slots union all select node, token from slots),
  labelled as (select n.node, layer, kind, min(label) as label from nodes0 n join labels0 l on l.node = n.node group by n.node, layer, kind)""")  # fmt: skip
def _statements(w):
    return sinks.statements(*the_whole(w)[:2], neighbours(w))


def _seeds(w):
    """The query set: candidates whose key is divisible by 50."""
    return w.candidates.where("k % 50 = 0").select(F.col("cid").alias("node"))


for _hops in (1, 2, 3):

    @query(f"bfs_{_hops}", "node string, hop long", "select node, min(hop) as hop from (" + " union all ".join(
        ["select cid as node, 0 as hop from cand where k % 50 = 0"] + [f"select y, {h} from r{h}" for h in range(1, _hops + 1)]) + ") group by node",
        (WHOLE_STEP if _hops == 2 else STEP) + ", r0 as (select cid as y from cand where k % 50 = 0)" + "".join(f", r{h} as (select distinct step.y from r{h - 1} r join step on step.x = r.y)" for h in range(1, _hops + 1)))
    def _bfs(w, hops=_hops):
        _, edges, *cells = the_whole(w) if hops == 2 else the_graph(w)
        return graph.bfs(_seeds(w), edges, hops, *cells)


@query("bfs_by_request", "pid long, node string, hop long", "select pid, cid as node, 0 as hop from seed union all select distinct s.pid, near.b, 1 from seed s join near on near.a = s.cid where not exists (select 1 from seed t where t.pid = s.pid and t.cid = near.b)", f"{SEED}, {CELLS}")
def _bfs_by(w):
    """Candidates one hop around the seeds of each request."""
    return graph.bfs_by(R.seeds(scored(w)).withColumnRenamed("cid", "node"), the_graph(w)[1], 1, candidate_only=True)


HOP = " union all ".join(f"select pid, cid, {h} as hop from h{h}" for h in range(4))


@query("reached_items", "pid long, cid string, hop long", f"select pid, cid, min(hop) as hop from ({HOP}) group by pid, cid",
       f"""{STEP.replace(CELLS + ',', SEED + ', ' + CELLS + ',')}, s8 as (select pid, cid from ranked where vrank <= 2 and vector is not null), item as (select pid, cid from scored), h0 as (select pid, cid from s8),
  f1 as (select distinct pid, y from s8 join step on x = cid), f2 as (select distinct pid, step.y from f1 join step on step.x = f1.y), b1 as (select distinct pid, cid, y from item join step on x = cid),
  h1 as (select pid, cid from item join f1 using (pid) where f1.y = cid), h2 as (select distinct b1.pid, cid from b1 join f1 on f1.pid = b1.pid and f1.y = b1.y), h3 as (select distinct b1.pid, cid from b1 join f2 on f2.pid = b1.pid and f2.y = b1.y)""")  # fmt: skip
def _reached(w):
    """How far the filtered candidates are from the two best of their request."""
    s = scored(w)
    return graph.reached(s, R.seeds(s, 2), the_graph(w)[1], 3)


#: Edges of tags and places alone, where items of one city can be many hops apart.
LEVELS = ", ".join(f"f{h} as (select distinct pid, thin.y from f{h - 1} f join thin on thin.x = f.y)" for h in range(1, 7))
ALL = " union all ".join(f"select pid, y as cid, {h} as h from f{h}" for h in range(7))
THIN = f"""{STEP.replace(CELLS + ',', SEED + ', ' + CELLS + ',')}, few as (select src, dst from gedges where relation in ('has_tag', 'nearby')), thin as (select src as x, dst as y from few union select dst, src from few),
f0 as (select pid, cid as y from ranked where vrank <= 2 and vector is not null), {LEVELS}, far as (select pid, cid, min(h) as hop from ({ALL}) join scored using (pid, cid) group by pid, cid)"""


def thin(w):
    """Those edges of the graph, from candidates alone: no ride and no day pattern makes one."""
    if "_thin" not in w.__dict__:
        w.__dict__["_thin"] = cut(graph.candidate_edges(w.candidates).where("relation in ('has_tag', 'nearby')"))
    return w.__dict__["_thin"]


@query("reached_far", "pid long, cid string, hop long", "select pid, cid, hop from far", THIN)
def _reached_far(w):
    """Up to six hops from the two best of a request, by tags and places alone: all requests at once as bits."""
    s = scored(w)
    return graph.reached(s, R.seeds(s, 2), thin(w), 6)


@query("fused_hops", "hops long, pid long, cid string", """select h as hops, s.pid, s.cid from scored s cross join range(7) r(h) left join far using (pid, cid)
  where not exists (select 1 from far f where f.pid = s.pid and f.hop <= greatest(h, 1)) or hop <= greatest(h, 1)""", THIN)  # fmt: skip
def _fused_hops(w):
    """What runs of none to six hops leave of each request's candidates."""
    from wayfinder.plans.q_evaluation import bundle

    b = bundle(w, thin(w))
    settings = tuple(methods.Settings(f"hops_{h}", hops=h, topk_vector=2, use_community_retrieval=False, use_summary_layer=False) for h in range(7))
    runs = methods.table(w.spark, settings)
    return methods.told(methods.fused(methods.searched(b), runs, b).select("pid", "cid"), runs.select("run", "hops"))


@query("components", "cid string, component string", "select a as cid, min(b) as component from (select cid as a, cid as b from cand union all select a, b from near) group by a", CELLS)
def _components(w):
    e = graph.nearby(w.candidates).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return graph.components(e, w.candidates.select(F.col("cid").alias("node"))).withColumnRenamed("node", "cid")


COMM = f"""{SEED}, {CELLS},
comm as (select s.pid, s.cid, coalesce(m.city || '/' || m.cy || '/' || m.cx, s.cid) as community, seed.cid is not null as hit from scored s left join cellm m using (cid) left join seed on seed.pid = s.pid and seed.cid = s.cid),
csize as (select *, max(overlap) over (partition by pid) as best, row_number() over (partition by pid order by overlap desc, size desc, community) as k from (select pid, community, count(*) filter (where hit) as overlap, count(*) as size from comm group by pid, community))"""


@query("community_keep", "pid long, cid string, community string", "select pid, cid, community from comm join csize using (pid, community) where (best > 0 and overlap = best) or (best = 0 and k = 1)", COMM)
def _community(w):
    s = scored(w)
    return graph.keep_communities(s, w.candidates, R.seeds(s))


#: Paths of up to three hops between the pairs of `goal`, the least in order among the shortest.
PATHS = """p1 as (select src, dst, [src, dst] as path from goal join step on x = src and y = dst),
g2 as (select * from goal anti join p1 using (src, dst)), p2 as (select src, dst, min([src, a.y, dst]) as path from g2 join step a on a.x = src join step b on b.x = a.y and b.y = dst group by src, dst),
g3 as (select * from g2 anti join p2 using (src, dst)), p3 as (select src, dst, min([src, a.y, b.y, dst]) as path from g3 join step a on a.x = src join step b on b.x = a.y and b.y <> src join step c on c.x = b.y and c.y = dst group by src, dst),
paths as (select * from p1 union all select * from p2 union all select * from p3)"""


@query("shortest_path", "src string, dst string, hops long, path string", "select src, dst, len(path) - 1 as hops, array_to_string(path, ' -> ') as path from paths",
       f"{STEP}, goal as (select cid as src, unnest(['pref:tag:widget', 'pref:tag:ring', 'pref:tag:economy', 'pattern:days:4', 'attraction:7']) as dst from cand where k % 50 = 0), {PATHS}")
def _paths(w):
    """From the query set to tags, a pattern and a candidate, up to three hops away."""
    ends = F.explode(F.array(*map(F.lit, ("pref:tag:widget", "pref:tag:ring", "pref:tag:economy", "pattern:days:4", "attraction:7"))))
    pairs = w.candidates.where("k % 50 = 0").select(F.col("cid").alias("src"), ends.alias("dst"))
    return graph.shortest_paths(pairs.where("src <> dst"), the_graph(w)[1], 3).withColumn("path", F.array_join("path", " -> "))


HUBS = ["etype:hotel", "pref:budget:low", "pref:intensity:moderate", "pattern:days:7"]
HUB_ENDS = ["pref:tag:ring", "pref:intensity:high", "pattern:days:4", "pattern:days:2", "attraction:7", "restaurant:50", "hotel:3", "city:france", "no:node"]


@query("shortest_path_hubs", "src string, dst string, hops long, path string", "select src, dst, len(path) - 1 as hops, array_to_string(path, ' -> ') as path from paths union all select src, dst, 4, array_to_string(path, ' -> ') from p4 union all select src, dst, 0, src from all_goals where src = dst",
       f"""{STEP}, all_goals as (select src, unnest({HUB_ENDS}) as dst from (select node as src from nodes0 where kind = 'city' union select unnest({HUBS}))), goal as (select * from all_goals where src <> dst), {PATHS},
  g4 as (select * from goal anti join paths using (src, dst)), fw as (select distinct src, a.y as y1, b.y as y2 from (select distinct src from g4) join step a on a.x = src join step b on b.x = a.y), bw as (select distinct dst, d.x as y3, c.x as y2 from (select distinct dst from g4) join step d on d.y = dst join step c on c.y = d.x),
  p4 as (select src, dst, min([src, y1, y2, y3, dst]) as path from g4 join fw using (src) join bw using (dst, y2) group by src, dst)""")  # fmt: skip
def _paths_of_hubs(w):
    """From cities and other hubs, which any number of candidates hang on, to hubs and candidates up to four hops away."""
    starts = the_graph(w)[0].where("kind = 'city'").select(F.col("node").alias("src")).union(w.spark.createDataFrame([(h,) for h in HUBS], "src string"))
    pairs = starts.select("src", F.explode(F.array(*map(F.lit, HUB_ENDS))).alias("dst"))
    return graph.shortest_paths(pairs, the_graph(w)[1], 4).withColumn("path", F.array_join("path", " -> "))


@query("path_evidence", "pid long, cid string, paths string", """select pid, cid, array_to_string(list(said order by nth)[1:3], ' | ') as paths from (select pid, cid, nth, array_to_string(path, ' -> ') as said from asked join paths on src = cid and paths.dst = asked.dst) group by pid, cid""",
       f"""{STEP.replace(CELLS + ',', FUSED + ',')}, kept5 as (select * from placed where position <= 5), asked as (select pid, cid, unnest(range(len(d))) as nth, unnest(d) as dst from (select pid, cid, list_concat(['city:' || {SLUG.format('destination')}], list_transform(interests[1:3], lambda x: 'pref:tag:' || {SLUG.format('x')})) as d from kept5)),
  goal as (select distinct cid as src, dst from asked), {PATHS}""")  # fmt: skip
def _evidence(w):
    """The paths of each kept item to its city and to the first interests of its request, three at most."""
    from wayfinder.plans.q_retrieval import items

    found = graph.path_evidence(items(w).where("position <= 5"), the_graph(w)[1])
    return found.withColumn("paths", F.array_join("paths", " | "))
