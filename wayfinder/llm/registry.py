"""Queries of the corpus operators and the SQL that expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.llm import centroids, chat, embedding, mixing, neardup, packing, pieces, prefix_trie, quality, secrets, sharding, substring, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sharding.place(docs.select("doc_id"), F.col("doc_id"), sharding.lookup_table(spark)).select("doc_id", "slot", "shard")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan_mix(_table(spark, sf_dir, "documents"), mixing.quality_weights(_table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.exchanges(_table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.EXCHANGE)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_from(docs, _table(spark, sf_dir, "labels"))
    s = F.col("_wf_stats")
    counts = [s["counts"][c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality.judge(docs, rules).select("doc_id", *counts, s["base_failed"].alias("base_failed"), s["kept"].alias("kept"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with the ledger kept between them: the second looks for the added rules alone."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    _, ledger = secrets.scan(docs, ["doc_id"], rules=secrets.BASE)
    found, _ = secrets.scan(docs, ["doc_id"], ledger=ledger)
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = lambda id_: F.crc32(id_.cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~apart(F.col("id")))
    found = toxicity.score(docs, model)
    held = F.coalesce(apart(F.col("doc_id")), F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "flagged")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.link(_table(spark, sf_dir, "embeddings"))


#: The vocabulary that the query uses; the operator takes any path.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top; it imports the operators itself

    return corpus_pipeline.run(spark, sf_dir)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


WORDS = r"[^\x20\x09-\x0D]+"


def _sql_sharding() -> str:
    names = ", ".join(f"({k}, '{x}')" for k, x in enumerate(sharding.SHARDS))
    n, m = len(sharding.SHARDS), sharding.SLOTS
    hashed = lambda x: f"('0x' || substr(md5({x}), 1, 13))::bigint"
    return f"""
with recursive shards(k, name) as (values {names}),
prefs as (select k, {hashed("'offset:' || name")} % {m} as off, {hashed("'skip:' || name")} % ({m} - 1) + 1 as skip from shards),
orders as (select k, list(((off + j * skip) % {m})::int order by j) as places from prefs, range({m}) r(j) group by k),
lists as (select list(places order by k) as prefs from orders),
fill(t, owner) as (
  select 0, list_resize([]::int[], {m}, -1)
  union all
  select t + 1, list_transform(owner, lambda x, i: case when i = place + 1 then t % {n} else x end)
  from (select t, owner, list_filter(prefs[t % {n} + 1], lambda p: owner[p + 1] = -1)[1] as place from fill, lists where t < {m}) q
),
slots as (select unnest(owner) as k, unnest(range({m})) as slot from fill where t = {m})
select d.doc_id, slot, name as shard
from (select doc_id, {hashed("coalesce(doc_id::varchar, '')")} % {m} as slot from documents) d join slots using (slot) join shards using (k)"""


def _sql_mixing() -> str:
    a, b, c = mixing.WEIGHTS
    return f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::bigint as size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5e0) / 4503599627370496e0) / case when q > 0 then 2e0 when q is not null then 0.5e0 else 1e0 end as key
  from documents left join (select doc_id, max(quality) as q from labels group by doc_id) using (doc_id)
),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) as rk, 2e0 * source_size as cap from s0),
s2 as (select *, [{a}e0, {b}e0, {c}e0][(rk - 1) % 3 + 1] as w from s1),
s3 as (select *, row_number() over o as nth,
    ((sum(source_size) over ())::double * {mixing.SHARE_PERCENT} / 100 - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (o rows between current row and unbounded following) as level
  from s2 window o as (order by cap / w, rk)),
s4 as (select *, (select arg_min(level, nth) from s3 where level * w < cap) as final from s3),
s as (select source, source_size, least(cap, coalesce(final * w, cap)) as target from s4),
e as (select d.*, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs
  from d join s on d.source is not distinct from s.source),
p as (select *, floor(target)::bigint - epochs * source_size as budget,
  coalesce(sum(size) over (partition by source order by key, doc_id::varchar, size rows between unbounded preceding and 1 preceding), 0) as ahead from e)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - ahead)))::bigint as taken from p"""


def _sql_chat() -> str:
    return f"""
with t as (
  select *, role is distinct from 'assistant' as is_call, max(turn) filter (where role = 'user') over w as asked_at
  from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)
),
calls as (
  select conv_id, turn, 'call-' || turn as id, case role when 'user' then 'reply' when 'system' then 'configure' else role end as name, text,
    len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as n, 2 * (row_number() over (partition by conv_id order by turn) - 1) as level
  from t where is_call
),
results as (select conv_id, turn, 'call-' || asked_at as id, text from t where not is_call),
j as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, c.turn as call_turn, r.turn as result_turn, coalesce(c.id, r.id) as call_id, c.turn is not null as is_call, level, name, c.text as asked, n, r.text as answer
  from calls c full join results r on c.conv_id = r.conv_id and c.id = r.id
)
select conv_id, call_turn, result_turn, call_id, level, case when not is_call then 'orphan' when result_turn is null then 'open' else 'linked' end as status,
  case when is_call then coalesce(case name when 'reply' then length(asked) >= 1 and n >= 5 when 'configure' then asked is not null end, false) end as valid,
  '{{' || case when is_call then '"arguments":{{"n_words":' || n || coalesce(',"text":' || to_json(asked)::varchar, '') || '}}' else '' end
  || coalesce(case when is_call then ',' else '' end || '"call_id":"' || call_id || '"', '') || coalesce(',"name":"' || name || '"', '') || coalesce(',"result":' || to_json(answer)::varchar, '') || '}}' as json
from j"""


def _sql_secrets() -> str:
    one = []
    for k, r in enumerate(secrets.BASE + secrets.MORE):
        p = r.pattern.replace("'", "''")
        one.append(f"""select doc_id, {k} as k, '{r.kind}' as kind, unnest(string_split_regex(t, '{p}')) as gap, unnest(regexp_extract_all(t, '{p}')) as m,
  unnest(regexp_extract_all(t, '{p}', {r.group})) as held, generate_subscripts(string_split_regex(t, '{p}'), 1) as i, {r.least} as least from t""")
    base = len(secrets.BASE)
    return f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
m as ({' union all '.join(one)}),
p as (select *, (sum(length(gap)) over w + coalesce(sum(length(m)) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as start from m window w as (partition by doc_id, k order by i)),
f as (select doc_id, k, kind, start, start + length(m) as stop from p where m is not null and length(held) >= least)
select t.doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k) filter (where k < {base}), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, k), '') as spans
from t left join f using (doc_id) group by t.doc_id"""


def _sql_minhash() -> str:
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) as (select doc_id, doc_id from w union select r.a, e.b from r join e on r.b = e.a),
k as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from k left join n using (doc_id)"""


def _sql_substring() -> str:
    return f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents),
x as (select doc_id, unnest(range(1, len(w) - 48)) as s, w from d where len(w) >= 50),
h as (select doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) as h from x),
l as (select h, min(doc_id) as least from h group by h),
c as (select doc_id, unnest(range(s, s + 50)) as p from h join l using (h) where least < doc_id),
g as (select doc_id, list(distinct p) as gone from c group by doc_id),
k as (select doc_id, w, coalesce(gone, []) as gone from d left join g using (doc_id)),
o as (select doc_id, len(w) as n_words, len(gone) as n_removed, list_filter(w, lambda x, i: not list_contains(gone, i)) as kept from k where len(gone) > 0
  union all select doc_id, len(w), 0, w from k where len(gone) = 0)
select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from o"""


def _sql_embedding() -> str:
    return """
with recursive v as (select vec_id, embedding::double[] as x from embeddings),
u as (select vec_id, x, sqrt(list_sum(list_transform(x, lambda a: a * a))) as n from v where len(list_filter(x, lambda a: a is null or not isfinite(a))) = 0),
e as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 and len(a.x) = len(b.x)
  where list_dot_product(a.x, b.x) / a.n / b.n >= 0.95e0),
r(a, b) as (select vec_id, vec_id from v union select r.a, e.b from r join e on r.b = e.a),
k as (select a as vec_id, min(b) as component_id from r group by a),
l as (select a as vec_id, count(*) as n from e group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from k left join l using (vec_id)"""


#: The CRC-32 of an ASCII text, bit by bit.
CRC = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)), lambda a, c: list_reduce(list_concat([xor(a, c)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"


def _sql_prefix_trie() -> str:
    return f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as x from conversations where conv_id is not null),
l as (select c, list(x order by i) as w from t group by c),
h as (select c, {CRC.format("c::varchar")} % 6 as h from l),
p as (select a.c, list_concat(coalesce(b.w[1:h.h], []), a.w[h.h + 1:]) as w from l a join h using (c) left join l b on b.c = a.c - a.c % 100),
m as (select c, len(w) as n, d, w[1:d] as node, coalesce(length(w[d].text), 0) as size from p, unnest(range(0, len(w) + 1)) r(d)),
v as (select node, any_value(d) as depth, min(c) as conv_id, count(*) as n_convs, coalesce(max(size), 0) as size, bool_and(n = d) as leaf,
  sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where n = d), '')) as ends_sha256 from m group by node)
select a.conv_id, a.depth, (select b.conv_id from v b where a.depth > 0 and b.node = a.node[1:a.depth - 1]) as parent_conv_id, a.n_convs, count(*) filter (where b.depth = a.depth + 1) as n_children,
  count(*) filter (where b.leaf) as n_leaves, sum((b.n_convs - 1) * b.size)::bigint as saved_tokens, a.ends_sha256
from v a join v b on b.node[1:a.depth] = a.node group by a.node, a.conv_id, a.depth, a.n_convs, a.ends_sha256"""


def _sql_centroids() -> str:
    rounds, k = 5, 40
    near = "select vec_id, r, v, arg_min(k, (d, k)) as k, min(d) as d from (select x.vec_id, x.r, v, c.k, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x, c{0} c) group by vec_id, r, v"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} as ({near.format(i)})")
        steps.append(f"s{i} as (select k, list(m order by j) as w from (select k, j, floor(sum(v[j]) / count(*))::bigint as m from a{i}, range(1, 65) q(j) group by k, j) group by k)")
        steps.append(f"c{i + 1} as (select c{i}.k, coalesce(s{i}.w, c{i}.w) as w from c{i} left join s{i} using (k))")
    return f"""
with e as (select vec_id, row_number() over () as r, embedding from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda a: a is null or not isfinite(a))) = 0),
x as (select vec_id, r, list_transform(embedding, lambda a: floor(256 * a::double)::bigint) as v from e),
c0 as (select k, v as w from (select v, row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')), v) - 1 as k from x) where k < {k}),
{", ".join(steps)},
z as ({near.format(rounds)})
select vec_id, z.k::int as cluster, d as distance, (sum(d) over (partition by z.k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(w, ',')) as centroid_sha256
from z join c{rounds} c using (k)"""


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_toxicity": op2_toxicity,
        "op3_substring": op3_substring,
        "op4_mixing": op4_mixing,
        "op5_chat": op5_chat,
        "op6_embedding": op6_embedding,
        "op7_pieces": op7_pieces,
        "op8_quality": op8_quality,
        "op9_secrets": op9_secrets,
        "op10_minhash": op10_minhash,
        "op11_packing": op11_packing,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_centroids": op13_centroids,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _sql_sharding(), "op3_substring": _sql_substring(), "op4_mixing": _sql_mixing(), "op5_chat": _sql_chat(), "op6_embedding": _sql_embedding(), "op9_secrets": _sql_secrets(), "op10_minhash": _sql_minhash(), "op12_prefix_trie": _sql_prefix_trie(), "op13_centroids": _sql_centroids()}
