"""Queries of filtering, search, scoring and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.functions.scratch import cut
from wayfinder.operators import dense, graph, lexical, methods, summary
from wayfinder.operators import retrieval as R
from wayfinder.plans.registry import query

TIER = """tier as (select *, case when hard and bud then 0 when hard then 1 else 2 end as tier from (select *,
  not (etype = 'restaurant' and lo is not null and not (price between lo and hi)) and not (etype = 'hotel' and category_pref is not null and not contains(lower(coalesce(category, '')), lower(category_pref))) as hard,
  coalesce(price <= budget / day * case etype when 'hotel' then 0.85e0 when 'restaurant' then 0.35e0 else 0.65e0 end, true) as bud from pool)),
filt as (select * exclude (n0, n1) from (select *, count(*) filter (where tier = 0) over (partition by pid) as n0, count(*) filter (where tier = 1) over (partition by pid) as n1 from tier)
  where tier = 0 or (tier = 1 and n0 < 6) or (tier = 2 and n0 < 6 and n0 + n1 < 6))"""
LEX = """tok as (select cid, term, count(*) as tf from (select cid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from cand) group by all),
total as (select count(distinct cid) as n from tok),
idf as (select term, count(*) as df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 as idf from tok, total group by term),
wt as (select cid, term, (1 + ln(tf)) * idf as w from tok join idf using (term)),
norm as (select cid, sqrt(sum(w * w)) as norm from wt group by cid),
qt as (select pid, term, (1 + ln(count(*))) * any_value(idf) as w from (select pid, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) as term from spec) join idf using (term) group by pid, term),
qn as (select pid, sqrt(sum(w * w)) as qn from qt group by pid)"""
VEC = f"""{TIER}, {LEX},
vec as (select pid, cid, round(sum(q.w * wt.w) / (any_value(norm) * any_value(qn)), 8) as vector from filt join wt using (cid) join qt q using (pid, term) join norm using (cid) join qn using (pid) group by pid, cid),
scored as (select filt.*, vector from filt left join vec using (pid, cid))"""
SEED = f"""{VEC},
ranked as (select *, row_number() over (partition by pid order by vector desc nulls last, tier, ord) as vrank from scored),
seed as (select pid, cid from ranked where vrank <= 30 and vector is not null),
anchor as (select pid, lat as alat, lon as alon from (select *, row_number() over (partition by pid order by coalesce(vector, 0) desc, etype = 'attraction' desc, price, tier, ord) as rk from scored) where rk = 1)"""
KM = "2 * 6371e0 * atan2(sqrt({0}), sqrt(1 - {0}))"
HAV = "(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))"
CONS = f"""{SEED},
cons0 as (select s.*, {HAV.format('alat', 'alon', 'lat', 'lon')} as hav, len(list_intersect(list_transform(tags, lambda x: lower(x)), interests)) as shared from scored s join anchor using (pid)),
cons as (select *, least(1.2e0, 0.3e0
  + case when etype = 'restaurant' and lo is not null then 0.28e0 * greatest(0, 1 - abs(price - (lo + hi) / 2) / greatest(1, hi - lo)) when etype = 'restaurant' then 0.12e0 else 0 end
  + case when etype = 'hotel' and contains(lower(category), lower(coalesce(category_pref, '?'))) then 0.2e0 else 0 end
  + case when len(tags) > 0 and len(interests) > 0 and shared > 0 then least(0.22e0, 0.08e0 * shared) else 0 end
  + case when bud then 0.1e0 else 0 end + case when opening is not null then 0.05e0 else 0 end + case when duration is not null then 0.05e0 else 0 end
  + 0.04e0 + 0.12e0 * greatest(0, 1 - {KM.format('hav')} / 20)) as constraint_score from cons0)"""
CELLS = """cellm as (select cid, city, cy, cx, k from (select cid, city, trunc(lat * 10)::int as cy, trunc(lon * 10)::int as cx, row_number() over (partition by city, trunc(lat * 10)::int, trunc(lon * 10)::int order by ord) as k from cand) where k <= 18),
near as (select a.cid as a, b.cid as b from cellm a join cellm b on a.city = b.city and a.cy = b.cy and a.cx = b.cx and a.k <> b.k)"""
#: Cells with all their members.
WHOLE_CELLS = CELLS.replace(" where k <= 18", "")
GRAPH = f"""{CONS}, {CELLS},
deg as (select cid, etype = 'attraction' as sight, len(list_distinct(list_transform(tags[1:6], lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-')))) as tags, (select count(*) from near where a = cid) as near from cand),
hits as (select s.pid, s.cid, count(*) as hits from scored s join near on a = s.cid join seed on seed.pid = s.pid and seed.cid = near.b group by s.pid, s.cid),
items as (select c.*, round(least(1.5e0, (1.5e0 * coalesce(h.hits, 0) + 1 + 0.7e0 * (1 + sight::int + deg.tags)) / (3 + sight::int + deg.tags + deg.near) + case when seed.cid is not null then 0.35e0 else 0 end), 8) as graph
  from cons c join deg using (cid) left join hits h on h.pid = c.pid and h.cid = c.cid left join seed on seed.pid = c.pid and seed.cid = c.cid)"""
SCALED = "case when max({0}) over p - min({0}) over p < 1e-9 then 0e0 else ({0} - min({0}) over p) / (max({0}) over p - min({0}) over p) end"
FUSED = f"""{GRAPH},
items2 as (select * replace (coalesce(vector, 0) as vector) from items),
fused as (select *, round(0.5e0 * vector + 0.25e0 * constraint_score + 0.25e0 * graph, 10) as raw_fused,
  round(0.5e0 * {SCALED.format('vector')} + 0.25e0 * {SCALED.format('constraint_score')} + 0.25e0 * {SCALED.format('graph')}, 10) as fused from items2 window p as (partition by pid)),
placed as (select *, row_number() over (partition by pid order by fused desc, tier, ord) as position from fused)"""


def scored(w):
    """Filtered candidates with their vector score (null: no word in common)."""
    kept = cut(R.hard_filter(R.city_filter(w.pool)).drop("query", "departure", "scope"))  # read several times by what follows
    found = lexical.search(w.candidates, "cid", F.col("text"), w.specs, "pid", F.col("query"), kept.select("pid", "cid"))
    return cut(kept.join(found.withColumnRenamed("score", "vector"), ["pid", "cid"], "left"))  # read several times by what follows


def items(w, topk: int = 30):
    """Scored candidates with constraint, graph and fused scores, and their position before reranking. Two hops reach every candidate of a city through the city, so none drops out."""
    s = scored(w)
    seeds = R.seeds(s, topk)
    s = s.join(R.anchor(s), "pid", "left").withColumn("constraint", R.constraint_score())
    g = graph.score(cut(graph.candidate_edges(w.candidates, s)), s, seeds)
    s = s.join(g, ["pid", "cid"]).fillna(0.0, ["vector"])
    f = R.fuse(s)
    return cut(f.withColumn("position", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("fused"), "tier", "ord")).cast("long")))


@query("city_filter_fallback", "pid long, n long, scope string", "select pid, count(*) as n, case when pid % 3 = 0 then 'pid_pool' else 'city:' || trim(regexp_replace(lower(any_value(destination)), '[^a-z0-9]+', '-', 'g'), '-') end as scope from pool group by pid")
def _city(w):
    moved = w.pool.withColumn("city", F.when(F.col("pid") % 3 == 0, F.lit("Elsewhere")).otherwise(F.upper("city")))
    return R.city_filter(moved).groupBy("pid").agg(F.count("*").alias("n"), F.max("scope").alias("scope"))


@query("tiered_hard_filter", "pid long, cid string, tier long", "select pid, cid, tier from filt", TIER)
def _filter(w):
    return R.hard_filter(w.pool)


@query("tier_counts", "pid long, initial long, strict long, budget_relaxed long, hard_relaxed long", "select pid, count(*) as initial, count(*) filter (where tier = 0) as strict, count(*) filter (where tier = 1) as budget_relaxed, count(*) filter (where tier = 2) as hard_relaxed from tier group by pid", TIER)
def _tiers(w):
    n = lambda k, name: F.count_if(F.col("tier") == k).alias(name)
    return R.tiers(w.pool).groupBy("pid").agg(F.count("*").alias("initial"), n(0, "strict"), n(1, "budget_relaxed"), n(2, "hard_relaxed"))


@query("dedupe_keep_first", "name string, cid string, ord long", "select name, arg_min(cid, ord) as cid, min(ord) as ord from cand group by name")
def _dedupe(w):
    return R.keep_first(w.candidates, ["name"], ["ord"])


@query("idf", "term string, df long, idf double", "select * from idf", LEX)
def _idf(w):
    return lexical.idf(lexical.terms(w.candidates, "cid", F.col("text")), "cid")


@query("doc_norms", "cid string, norm double", "select * from norm", LEX)
def _norms(w):
    t = cut(lexical.terms(w.candidates, "cid", F.col("text")))
    return lexical.norms(lexical.weigh(t, cut(lexical.idf(t, "cid"))), "cid")


@query("tfidf_topk", "item_id long, doc_id long, score score, rank long", """with t as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]')) as term from documents) group by all),
i as (select term, ln(((select count(distinct doc_id) from t) + 1) / (count(*) + 1)) + 1 as idf from t group by term), w as (select doc_id, term, (1 + ln(tf)) * idf as w from t join i using (term)), n as (select doc_id, sqrt(sum(w * w)) as n from w group by doc_id),
q as (select item_id, term, (1 + ln(count(*))) * any_value(idf) as w from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]')) as term from benchmark) join i using (term) group by all), m as (select item_id, sqrt(sum(w * w)) as m from q group by item_id),
s as (select item_id, doc_id, round(sum(q.w * w.w) / (any_value(n) * any_value(m)), 8) as score from q join w using (term) join n using (doc_id) join m using (item_id) group by all)
select * from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10""", plain=True)  # fmt: skip
def _tfidf(w):
    found = lexical.search(w.table("documents"), "doc_id", F.col("text"), w.table("benchmark"), "item_id", F.col("text"))
    return R.top(found, 10, [F.desc("score"), "doc_id"], by=("item_id",))


@query("seed_pick", "pid long, cid string", "select * from seed", SEED)
def _seeds(w):
    return R.seeds(scored(w))


@query("route_anchor", "pid long, anchor_lat double, anchor_lon double", "select pid, alat as anchor_lat, alon as anchor_lon from anchor", SEED)
def _anchor(w):
    return R.anchor(scored(w))


@query("fn_constraint_score", "pid long, cid string, score double", "select pid, cid, constraint_score as score from cons", CONS)
def _constraint(w):
    s = scored(w)
    return s.join(R.anchor(s), "pid").withColumn("score", R.constraint_score())


@query("constraint_notes", "pid long, cid string, notes string", f"""select pid, cid, array_to_string(list_filter([
  case when etype = 'restaurant' and lo is not null then printf('meal_fit=%.2f', greatest(0e0, 1 - abs(price - (lo + hi) / 2) / greatest(1, hi - lo))) end,
  case when etype = 'hotel' and category_pref is not null then 'hotel_pref_match=' || contains(lower(category), lower(category_pref))::int end,
  case when len(tags) > 0 and len(interests) > 0 then 'interest_overlap=' || shared end, case when bud then 'budget_hint=ok' else 'budget_hint=relaxed' end,
  case when opening is not null then 'opening_hours=known' end, case when duration is not null then 'duration_min=' || regexp_extract(duration, '(\\d+)', 1)::int * 60 end,
  'geo=known', printf('route_anchor_km=%.2f', {KM.format('hav')})], lambda x: x is not null), ', ') as notes from cons0""", CONS)
def _notes(w):
    s = scored(w)
    return s.join(R.anchor(s), "pid").withColumn("notes", F.array_join(R.notes(), ", "))


@query("graph_score", "pid long, cid string, graph score", "select pid, cid, graph from items", GRAPH)
def _graph_score(w):
    return items(w)


@query("minmax_fuse", "pid long, cid string, raw_fused score, fused score", "select pid, cid, raw_fused, fused from fused", FUSED)
def _fuse(w):
    return items(w)


@query("naive_retrieval_topk", "pid long, cid string, position long, vector score, fused score", "select pid, cid, position, vector, fused from placed where position <= 20", FUSED)
def _top(w):
    return items(w).where("position <= 20")


@query("quota_select", "pid long, cid string, chosen_rank long", """select pid, cid, row_number() over (partition by pid order by case when not quota then 3 when etype = 'hotel' then 0 when etype = 'attraction' then 1 else 2 end, position) as chosen_rank from (
  select *, row_number() over (partition by pid, quota order by position) as spare, count(*) over (partition by pid) as n, count(*) filter (where quota) over (partition by pid) as m from (
    select *, row_number() over (partition by pid, etype order by position) <= case etype when 'hotel' then 1 when 'attraction' then greatest(4, 2 * day) else greatest(3, 2 * day) end as quota from placed where position <= 20))
  where quota or spare <= least(n, 6 * day + 2) - m""", FUSED)
def _quota(w):
    return summary.quotas(items(w).where("position <= 20"))


SIGNALS = f"""{FUSED},
r20 as (select * from placed where position <= 20), base as (select * from r20 where position <= greatest(8, 5 * day)),
chosen as (select *, row_number() over (partition by pid order by kind, position) as crank from (select *, case when not quota then 3 when etype = 'hotel' then 0 when etype = 'attraction' then 1 else 2 end as kind from (
  select *, row_number() over (partition by pid, quota order by position) as spare, count(*) over (partition by pid) as n, count(*) filter (where quota) over (partition by pid) as m from (
    select *, row_number() over (partition by pid, etype order by position) <= case etype when 'hotel' then 1 when 'attraction' then greatest(4, 2 * day) else greatest(3, 2 * day) end as quota from r20))
  where quota or spare <= least(n, 6 * day + 2) - m)),
ga as (select *, count(*) over (partition by pid) as na, row_number() over (partition by pid order by position) as t, first(lat) over (partition by pid order by position) as flat, first(lon) over (partition by pid order by position) as flon,
  lag(lat) over (partition by pid order by position) as plat, lag(lon) over (partition by pid order by position) as plon from base where etype = 'attraction'),
gk as (select pid, t, {HAV.format('flat', 'flon', 'lat', 'lon')} as ha, {HAV.format('plat', 'plon', 'lat', 'lon')} as hs from ga where t <= greatest(3, least(na, day + 2))),
geo as (select pid, avg({KM.format('ha')}) filter (where t > 1) as anchor_km, avg({KM.format('hs')}) as step_km from gk group by pid),
fl as (select pid, greatest(0, 1 - greatest(0, max(fused) filter (where t = 1) - avg(fused) filter (where t > 1))) as flatness from (select *, row_number() over (partition by pid order by fused desc) as t from base where etype <> 'hotel') where t <= 5 group by pid),
br as (select pid, sum(case when etype = 'hotel' then case when t = 1 then price * day else 0 end when t <= 2 * day then price else 0 end) / greatest(1, any_value(budget)) as ratio from (select *, row_number() over (partition by pid, etype order by position) as t from base) group by pid),
nr as (select pid, sum(case when etype = 'hotel' then case when t = 1 then price * day else 0 end when t <= 2 * day then price else 0 end) / greatest(1, any_value(budget)) as ratio from (select *, row_number() over (partition by pid, etype order by crank) as t from chosen) group by pid),
sig as (select b.pid, any_value(day) as day, any_value(budget) as budget, count(*) filter (where etype = 'attraction') as n_attractions, count(*) filter (where etype = 'restaurant') as n_restaurants, any_value(anchor_km) as anchor_km, any_value(step_km) as step_km, coalesce(any_value(flatness), 0) as flatness,
  case when any_value(budget) > 0 then any_value(br.ratio) end as base_ratio, case when any_value(budget) > 0 then any_value(nr.ratio) end as new_ratio from base b left join geo using (pid) left join fl using (pid) left join br using (pid) left join nr using (pid) group by b.pid),
gate as (select *, case when n_attractions < 3 then 'skipped/insufficient_attractions' when new_ratio > base_ratio + 0.08e0 and new_ratio > 0.9e0 then 'skipped/summary_budget_regression'
  when anchor_km <= 4.5e0 and step_km <= 4.5e0 and base_ratio <= 0.82e0 then 'skipped/stable_rank_compact_geo' when anchor_km >= 6.5e0 or step_km >= 6 or base_ratio >= 0.9e0 then 'applied/route_or_budget_pressure'
  when flatness >= 0.58e0 and (anchor_km >= 5 or step_km >= 4.5e0 or day >= 5) then 'applied/flat_rank_needs_structuring' when day >= 4 and (step_km >= 5 or (flatness >= 0.5e0 and anchor_km >= 4.5e0)) then 'applied/multi_day_moderate_pressure' else 'skipped/marginal_gain' end as g from sig)"""


@query("geo_signals", "pid long, anchor_km double, step_km double", "select pid, anchor_km, step_km from geo", SIGNALS)
def _geo(w):
    return summary.geo_signals(summary.baseline(items(w).where("position <= 20")).where("etype = 'attraction'"))


@query("flatness", "pid long, flatness double", "select pid, coalesce(flatness, 0) as flatness from fl", SIGNALS)
def _flat(w):
    return summary.flatness(summary.baseline(items(w).where("position <= 20")), "fused")


@query("budget_risk", "pid long, ratio double, risk string", "select pid, base_ratio as ratio, case when base_ratio is null then 'unknown' when base_ratio <= 0.8e0 then 'low' when base_ratio <= 1 then 'medium' else 'high' end as risk from sig", SIGNALS)
def _risk(w):
    r = summary.budget_ratio(summary.baseline(items(w).where("position <= 20")), "position")
    return r.withColumn("risk", summary.risk(F.col("ratio")))


@query("summary_gate", "pid long, mode string, reason string, n_attractions long, flatness double, base_ratio double, new_ratio double", "select pid, split_part(g, '/', 1) as mode, split_part(g, '/', 2) as reason, n_attractions, flatness, base_ratio, new_ratio from gate", SIGNALS)
def _gate(w):
    return summary.summarize(items(w).where("position <= 20"))


CAP = "(daily * case etype when 'restaurant' then 0.3e0 else 0.55e0 end)"
FIT = f"case when {CAP} is null then 1e0 when {CAP} <= 0 then (price <= 0)::int::double when price <= {CAP} then 1e0 else greatest(0e0, {CAP} / greatest(price, 1e0)) end"
RANGE = "case when price < lo then greatest(0e0, 1 - (lo - price) / greatest(1e0, hi - lo)) when price > hi then greatest(0e0, 1 - (price - hi) / greatest(1e0, hi - lo)) else greatest(0.7e0, 1 - abs(price - (lo + hi) / 2) / greatest(1e0, hi - lo)) end"
NEXT = "list_transform(list_sort(list_transform(list_filter({0}, lambda x: not list_contains({1}, x['cid'])), lambda x: {{'s': -({2}), 'p': x['price'], 'c': x['cid']}})), lambda x: x['c'])"
G = "coalesce(m[anchor || '|' || x['cid']], 0.5e0)"
SUGGESTED = f"""{SIGNALS},
beds as (select pid, arg_min(price, crank) as bed from chosen where etype = 'hotel' group by pid),
dly as (select c.pid, any_value(day) as day, case when any_value(budget) > 0 then greatest(0e0, any_value(budget) - coalesce(any_value(bed), 0) * any_value(day)) * 0.8e0 / greatest(any_value(day), 1) end as daily from chosen c left join beds using (pid) group by c.pid),
sg as (select *, case when top - low <= 1e-9 then 1e0 else (fused - low) / (top - low) end as rel, case when etype = 'restaurant' and lo is not null then 0.6e0 * ({RANGE}) + 0.4e0 * ({FIT}) else {FIT} end as fit from (select c.*, daily, min(fused) over p as low, max(fused) over p as top from chosen c join dly using (pid) where etype <> 'hotel' window p as (partition by pid))),
nears as (select pid, map_from_entries(list((k, g))) as m from (select a.pid, a.cid || '|' || b.cid as k, greatest(0e0, 1 - {KM.format(HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon'))} / 25e0) as g from sg a join sg b on a.pid = b.pid and a.cid <> b.cid where a.etype = 'attraction') group by pid),
both_ as (select pid, any_value(day) as day, {", ".join(f"coalesce(list({{'cid': cid, 'price': price, 'rel': rel, 'fit': fit}}) filter (where etype = '{k}'), []) as {n}" for k, n in (("attraction", "sights"), ("restaurant", "meals")))} from sg group by pid),
walk(pid, d, used, picks) as (
  select pid, 0::bigint, []::varchar[], []::varchar[] from both_
  union all
  select pid, d + 1, used || picks1, picks1 from (select *, case when anchor is null then {NEXT.format("meals", "used", "0.72e0 * x['rel'] + 0.28e0 * x['fit']")}[:2] else list_concat(mine, {NEXT.format("meals", "used", f"0.34e0 * x['rel'] + 0.28e0 * {G} + 0.38e0 * x['fit']")}[:2]) end as picks1 from (
    select *, list_concat([anchor], {NEXT.format("sights", "list_append(used, anchor)", f"0.38e0 * x['rel'] + 0.46e0 * {G} + 0.16e0 * x['fit']")}[:2]) as mine from (
      select w.pid, w.d, used, sights, meals, m, coalesce({NEXT.format("sights", "used", "0.72e0 * x['rel'] + 0.28e0 * x['fit']")}[1], {NEXT.format("sights", "[]", "0.72e0 * x['rel'] + 0.28e0 * x['fit']")}[1]) as anchor from walk w join both_ b on b.pid = w.pid and w.d < b.day left join nears on nears.pid = w.pid))))"""


@query("day_suggestions", "pid long, plan_day long, picks string", "select pid, d as plan_day, array_to_string(picks, ',') as picks from walk where d > 0", SUGGESTED)
def _suggestions(w):
    s = summary.day_suggestions(summary.quotas(items(w).where("position <= 20")).withColumn("position", F.col("chosen_rank")))
    return s.withColumn("picks", F.array_join("picks", ","))


JACCARD = "coalesce(len(list_intersect({0}, {1})) / nullif(len({0}) + len({1}) - len(list_intersect({0}, {1})), 0)::double, 0)"


def _mmr_sql(n: int) -> str:
    """Picks one after another: each step takes the best of what is left, by its score, its likeness to what is taken, and hotels taken before."""
    steps = [f"""{FUSED},
x as (select pid, cid, etype, position, fused, lower(name) as plain, list_distinct(tags) as g, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from (select * replace (list_transform(tags, lambda x: lower(x)) as tags) from placed)),
m1 as (select pid, cid, etype, g, w, plain, 1 as place from x where position = 1)"""]
    for k in range(2, n + 1):
        taken = " union all ".join(f"select * from m{j}" for j in range(1, k))
        steps.append(f"""m{k} as (select pid, cid, etype, g, w, plain, {k} as place from (select *, row_number() over (partition by pid order by worth desc, position) as rk from (
  select x.pid, x.cid, any_value(x.etype) as etype, any_value(x.g) as g, any_value(x.w) as w, any_value(x.plain) as plain, any_value(x.position) as position,
    round(0.8e0 * any_value(x.fused) - (1 - 0.8e0) * max(least(1e0, 0.45e0 * {JACCARD.format('x.w', 't.w')} + 0.25e0 * {JACCARD.format('x.g', 't.g')} + 0.2e0 * (x.etype = t.etype)::int + 0.1e0 * (x.plain = t.plain)::int)) - case when any_value(x.etype) = 'hotel' and bool_or(t.etype = 'hotel') then 0.12e0 else 0 end, 10) as worth
  from x join ({taken}) t on x.pid = t.pid where (x.pid, x.cid) not in (select (pid, cid) from ({taken}) u) group by x.pid, x.cid)) where rk = 1)""")
    return ", ".join(steps)


@query("mmr_top5", "pid long, cid string, position long", " union all ".join(f"select pid, cid, place as position from m{k}" for k in range(1, 6)), _mmr_sql(5))
def _mmr(w):
    return R.rerank(items(w), 5)


@query("direct_shortlist", "pid long, cid string, rank long", """select pid, cid, row_number() over (partition by pid, etype order by -interest - overlap, penalty, ord) as rank from (
  select *, len(list_intersect(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) as overlap, len(list_intersect(list_distinct(interests), list_distinct(list_transform(tags, lambda x: lower(x))))) as interest,
    case when lo is not null and etype = 'restaurant' then (not (price between lo and hi))::int::double when budget is not null then price / greatest(budget, 1) else 0 end as penalty from pool)
  qualify rank <= case etype when 'hotel' then 1 else greatest(4, 2 * day) end""")
def _direct(w):
    return methods.shortlist(w.pool)


def _parts(long, short, of: str, like: str):
    """Rows of `long` with each part of the text `of` that is as long as some text `like` of `short`, so that containment is a join of equal texts."""
    sizes = short.agg(F.collect_set(F.length(like)).alias("_sizes"))  # one row of as many numbers as texts have lengths
    at = F.sequence(F.lit(1), F.length(of) - F.col("_n") + 1)
    cut_ = long.crossJoin(F.broadcast(sizes)).withColumn("_n", F.explode("_sizes")).where(F.col("_n") <= F.length(of))
    return cut_.select(*long.columns, F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col(of), i, F.col("_n"))))).alias("_part"))


@query("name_match", "wanted string, cid string", """select wanted, arg_min(cid, (case when lower(name) = wanted then 0 else 1 end) * 10000000000 + case when lower(name) = wanted then -ord else ord end) as cid
  from (select distinct lower(r_name) as wanted from region union select distinct lower(p_name) from part union select 'hotel ' || lower(s_name) from supplier) w join (select lower(name) as l, name, cid, ord from cand) c on l = wanted or contains(l, wanted) or contains(wanted, l) group by wanted""")
def _names(w):
    """Candidates by name: the last with just that name, else the first whose name holds the wanted one or is held by it."""
    wanted = w.table("region").select("r_name").union(w.table("part").select("p_name")).union(w.table("supplier").select(F.concat(F.lit("Hotel "), "s_name")))
    wanted = cut(wanted.select(text.normalize(F.col("r_name")).alias("wanted")).where("wanted <> ''").distinct())
    names = cut(w.candidates.select(text.normalize(F.col("name")).alias("n"), "cid", "ord").where("n <> ''"))
    exact = names.join(wanted, F.col("n") == F.col("wanted")).groupBy("wanted").agg(F.max_by("cid", "ord").alias("exact"))
    firsts = cut(names.groupBy("n").agg(F.min(F.struct("ord", "cid")).alias("x")))
    holds = _parts(firsts, wanted, "n", "wanted").join(wanted, F.col("_part") == F.col("wanted")).select("wanted", "x")
    held = _parts(wanted, firsts, "wanted", "n").join(firsts, F.col("_part") == F.col("n")).select("wanted", "x")
    loose = holds.union(held).groupBy("wanted").agg(F.min("x").alias("x"))
    return loose.join(exact, "wanted", "left").select("wanted", F.coalesce("exact", "x.cid").alias("cid"))


@query("jaccard_pairs", "a long, b long, score double", """with t as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+|[\\x{4e00}-\\x{9fff}]')) as w from benchmark)
select a.item_id as a, b.item_id as b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::double as score from t a join t b on a.item_id < b.item_id and len(list_intersect(a.w, b.w)) > 0""", plain=True)
def _jaccard(w):
    """Pairs that share a word, counted through the words they share."""
    t = w.table("benchmark").select("item_id", F.array_distinct(text.tokenize(F.col("text"))).alias("w")).withColumn("n", F.size("w"))
    one = t.select("item_id", "n", F.explode("w").alias("term"))
    a, b = (one.select(F.col("item_id").alias(x), F.col("n").alias(f"n{x}"), "term") for x in "ab")
    both = a.join(b, "term").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return both.withColumn("score", F.col("c") / (F.col("na") + F.col("nb") - F.col("c")))


@query("candidate_similarity", "pid long, a string, b string, score double", """select a.pid, a.cid as a, b.cid as b, least(1e0, 0.45e0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) + 0.25e0 * len(list_intersect(a.tags, b.tags)) / (len(a.tags) + len(b.tags) - len(list_intersect(a.tags, b.tags))) + 0.2e0 + 0.1e0 * (lower(a.name) = lower(b.name))::int) as score
from h a join h b on a.pid = b.pid and a.cid < b.cid""", "h as (select pid, cid, etype, name, list_distinct(tags) as tags, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from pool where etype = 'hotel')")
def _similar(w):
    one = w.pool.where("etype = 'hotel'").select("pid", F.struct("cid", "etype", "name", "tags", text.tokenize(F.col("text")).alias("tokens")).alias("x"))
    pairs = one.withColumnRenamed("x", "l").join(one.withColumnRenamed("x", "r"), "pid").where("l.cid < r.cid")
    return pairs.select("pid", F.col("l.cid").alias("a"), F.col("r.cid").alias("b"), R.similarity("l", "r").alias("score"))


@query("dense_topk", "query_id long, vec_id long, score double, rank long", """select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
  select q.vec_id as query_id, v.vec_id, round(greatest(0, list_dot_product(v.embedding::double[], q.embedding::double[])), 6) as score from embeddings v join embeddings q on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id)) where rank <= 10""", plain=True)
def _dense(w):
    v = w.table("embeddings")
    return dense.search(v.select("vec_id", "embedding"), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


@query("dense_city_scoped", "query_id long, vec_id long, score double, rank long", """select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
  select q.vec_id as query_id, v.vec_id, round(greatest(0, list_dot_product(v.embedding::double[], q.embedding::double[])), 6) as score from embeddings v join embeddings q on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id and v.label = q.label)) where rank <= 5""", plain=True)
def _scoped(w):
    v = w.table("embeddings")
    return dense.search(v.select("vec_id", "embedding", "label"), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label"), 5, "label")


@query("interest_coverage", "pid long, coverage double", "select pid, len(list_intersect(any_value(list_distinct(interests)), list_distinct(flatten(list(list_transform(tags, lambda x: lower(x))))))) / len(any_value(list_distinct(interests)))::double as coverage from plans group by pid")
def _coverage(w):
    p = w.plans.groupBy("pid").agg(F.first("interests").alias("i"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("t"))
    return p.select("pid", (F.size(F.array_intersect("i", "t")) / F.size(F.array_distinct("i"))).alias("coverage"))


