"""The trip tables in DuckDB SQL, for the oracles; written apart from the DataFrame definitions."""

BASE = r"""
cities as (select n_nationkey::bigint as city_key, n_name as city from nation),
c0 as (
  select 'attraction' as etype, p_partkey::bigint as k, p_partkey::bigint as ord, p_partkey % 25 as city_key, p_name as name, ((p_partkey * 17) % 400)::double as price,
    list_concat(string_split(p_name, ' '), [lower(p_type), lower(p_brand)]) as tags, null::varchar as category,
    case when p_size % 11 <> 0 then '08:00-' || (16 + p_size % 7) || ':00' end as opening, case when p_size % 9 <> 0 then (1 + p_size % 4) || ' hours' end as duration from part
  union all select 'hotel', s_suppkey::bigint, s_suppkey + 1000000000, s_nationkey, s_name, abs(s_acctbal) / 20e0, [['Economy', 'Midscale', 'Luxury'][s_suppkey % 3 + 1]], ['Economy', 'Midscale', 'Luxury'][s_suppkey % 3 + 1], null, null from supplier
  union all select 'restaurant', c_custkey::bigint, c_custkey + 2000000000, c_nationkey, c_name, abs(c_acctbal) / 50e0, [lower(c_mktsegment)], null, null, null from customer
),
cand as (select etype || ':' || k as cid, etype, k, ord, city, name, price, 30e0 + ((k // 25) * 37) % 400 / 1e3 as lat, 120e0 + ((k // 25) * 91) % 300 / 1e3 as lon, tags, category, opening, duration,
  name || ' ' || etype || ' in ' || city || ' ' || array_to_string(tags, ' ') as text from c0 join cities using (city_key)),
o0 as (select o_orderkey::bigint as pid, o_orderkey // 50 as q, o_totalprice, c_nationkey, c_mktsegment from orders join customer on o_custkey = c_custkey where o_orderkey % 50 = 0),
req as (select pid, d.city as departure, t.city as destination, (2 + q % 6)::bigint as day,
  'Plan a trip from ' || d.city || ' to ' || t.city || ' for ' || (2 + q % 6) || ' days'
  || case q % 5 when 0 then ' with a budget of $' || floor(o_totalprice / 100)::bigint || ', meal costs ranging from 20 to 90' when 1 then ', relaxed pace, meal cost over 60'
     when 2 then ' with a budget of $' || floor(o_totalprice / 100)::bigint || ' and a luxury stay' when 3 then ', moderate pace and a midscale hotel' else '' end
  || ', interested in ' || ['economy', 'large', 'medium', 'promo', 'small', 'standard'][q % 6 + 1] || ', ' || lower(c_mktsegment) || ' and parks along with rest.' as query
  from o0 join cities d on c_nationkey = d.city_key join cities t on q % 25 = t.city_key),
spec as (select pid, departure, destination, day, query,
  try_cast(nullif(regexp_extract(query, 'budget of \$([0-9]+)', 1), '') as double) as budget,
  coalesce(try_cast(nullif(regexp_extract(query, 'ranging from ([0-9]+)', 1), '') as double), try_cast(nullif(regexp_extract(query, 'cost over ([0-9]+)', 1), '') as double)) as lo,
  coalesce(try_cast(nullif(regexp_extract(query, 'ranging from [0-9]+ to ([0-9]+)', 1), '') as double), case when query like '%cost over%' then 2147483647e0 end) as hi,
  case when lower(query) like '%economy%' then 'Economy' when query like '%midscale%' then 'Midscale' when query like '%luxury%' then 'Luxury' when query like '%budget%' then 'Economy' end as category_pref,
  case when query like '%relaxed%' then 'low' when query like '%low%' then 'low' when query like '%moderate%' then 'moderate' end as intensity_pref,
  list_filter(string_split(replace(trim(regexp_extract(query, 'interested in (.*) along with', 1)), ' and ', ', '), ', '), lambda x: length(x) > 2) as interests
  from req),
pool as (select * exclude (rn) from (select s.*, c.*, row_number() over (partition by pid, etype order by (k * 13 + pid) % 1009, cid) as rn from spec s join cand c on destination = city)
  where rn <= case etype when 'hotel' then 4 when 'restaurant' then 12 else 24 end),
truth as (select * from pool where (k * 13 + pid) % 7 = 0),
transport as (select case when l_returnflag = 'R' then 'flight' else 'train' end as mode, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as number, f.city as from_city, t.city as to_city,
  (l_partkey * 7) % 1200 as start, (l_partkey * 7) % 1200 + 60 + l_quantity::bigint as stop, l_extendedprice / 100 as price
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join cities f on s_nationkey = f.city_key join cities t on c_nationkey = t.city_key where f.city <> t.city),
p0 as (select *, 1 + (k + pid) % day as plan_day, 540 + ((k * 37 + pid) % 10) * 70 as start, case when etype = 'restaurant' then 'dining' else 'sightseeing' end as action from pool where etype <> 'hotel' and (k * 7 + pid) % 3 = 0),
plans as (select *, start + 60 + (k % 3) * 45 as stop, row_number() over (partition by pid, plan_day order by start, cid) as seq from p0)
"""


def duck(body: str, more: str = "") -> str:
    """`body` over the trip tables; `more`: further common table expressions."""
    return f"with recursive {BASE}{', ' + more if more else ''}\n{body}"
