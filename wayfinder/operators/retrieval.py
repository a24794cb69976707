"""Filtering, scoring, fusing and reranking the candidates of each request.

All operators take rows keyed by `pid` with the request's and the candidate's columns beside each
other. Ties keep the order of `ord`. Scores are rounded to ROUND digits before they rank, so that
the order of a sum does not decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions import geo, text

# Least candidates, rerank weight, caps of the daily budget, fusion weights.
LEAST, LAMBDA, HOTEL_PENALTY = 6, 0.8, 0.12
CAPS = {"hotel": 0.85, "restaurant": 0.35, "attraction": 0.65}
WEIGHTS = (0.5, 0.25, 0.25)
ROUND = 10  # more than the scores below have, so that no sum of them lies halfway


def by_pid():
    return Window.partitionBy("pid")


def city_filter(pool: DataFrame) -> DataFrame:
    """Candidates of the destination; requests without any keep all, with scope pid_pool."""
    same = (F.col("city") == F.col("destination")) | (text.normalize(F.col("city")) == text.normalize(F.col("destination")))
    pool = pool.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_n", F.sum(F.col("_same").cast("int")).over(by_pid()))
    scope = F.when(F.col("_n") > 0, F.concat(F.lit("city:"), text.slugify(F.col("destination")))).otherwise("pid_pool")
    return pool.where("_same or _n = 0").withColumn("scope", scope).drop("_same", "_n")


def hard_ok() -> Column:
    meal = (F.col("etype") == "restaurant") & F.col("lo").isNotNull() & ~F.col("price").between(F.col("lo"), F.col("hi"))
    hotel = (F.col("etype") == "hotel") & F.col("category_pref").isNotNull() & ~F.lower(F.coalesce("category", F.lit(""))).contains(F.lower("category_pref"))
    return ~(meal | hotel)


def budget_ok() -> Column:
    daily = F.when(F.col("budget") != 0, F.col("budget") / F.greatest(F.col("day"), F.lit(1)))
    cap = None
    for etype, share in CAPS.items():
        cap = F.when(F.col("etype") == etype, share) if cap is None else cap.when(F.col("etype") == etype, share)
    return F.coalesce(F.col("price") <= daily * cap, F.lit(True))


def tiers(pool: DataFrame) -> DataFrame:
    """`pool` with `tier`: 0 strict, 1 over the budget caps, 2 against the user's own limits."""
    return pool.withColumn("tier", F.when(hard_ok() & budget_ok(), 0).when(hard_ok(), 1).otherwise(2))


def hard_filter(pool: DataFrame) -> DataFrame:
    """The strict tier, and whole later tiers while fewer than LEAST candidates are there; first of each id."""
    t = tiers(pool)
    count = lambda k: F.sum((F.col("tier") == k).cast("int")).over(by_pid())
    t = t.withColumn("_n0", count(0)).withColumn("_n1", count(1))
    few = F.col("_n0") < LEAST
    t = t.where((F.col("tier") == 0) | ((F.col("tier") == 1) & few) | ((F.col("tier") == 2) & few & (F.col("_n0") + F.col("_n1") < LEAST)))
    return keep_first(t.drop("_n0", "_n1"), ["pid", "cid"], ["tier", "ord"])


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def top(rows: DataFrame, n: int | Column, order: list, by: tuple[str, ...] = ("pid",), at: str = "rank") -> DataFrame:
    return rows.withColumn(at, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(at) <= n)


def seeds(scored: DataFrame, topk: int | Column = 30) -> DataFrame:
    """The best `topk` by vector score; requests without scores take the 8 cheapest, hotels last."""
    scored = scored.withColumn("_any", F.count("vector").over(by_pid()))
    found = top(scored.where("vector is not null"), topk, [F.desc("vector"), "tier", "ord"])
    other = top(scored.where("_any = 0"), 8, [F.col("etype") == "hotel", "price", "tier", "ord"])
    return found.unionByName(other).select("pid", "cid")


def anchor(scored: DataFrame) -> DataFrame:
    """For each request the place of the best candidate that has one: `(pid, anchor_lat, anchor_lon)`."""
    known = scored.where("lat is not null and lon is not null")
    order = [F.desc(F.coalesce("vector", F.lit(0.0))), F.desc(F.col("etype") == "attraction"), "price", "tier", "ord"]
    return top(known, 1, order).select("pid", F.col("lat").alias("anchor_lat"), F.col("lon").alias("anchor_lon"))


def constraint_score() -> Column:
    """Needs anchor_lat and anchor_lon; capped at 1.2."""
    etype, zero = F.col("etype"), F.lit(0.0)
    mid, span = (F.col("lo") + F.col("hi")) / 2, F.greatest(F.lit(1.0), F.col("hi") - F.col("lo"))
    meal = F.when((etype == "restaurant") & F.col("lo").isNotNull(), 0.28 * F.greatest(zero, 1 - F.abs(F.col("price") - mid) / span)).when(etype == "restaurant", 0.12).otherwise(0.0)
    liked = F.lower(F.coalesce("category", F.lit(""))).contains(F.lower("category_pref"))
    hotel = F.when((etype == "hotel") & F.coalesce(liked, F.lit(False)), 0.2).otherwise(0.0)
    shared = F.size(F.array_intersect(text.normalize_all(F.col("tags")), text.normalize_all(F.col("interests"))))
    tags = F.when((F.size("tags") > 0) & (F.size("interests") > 0), text.let(shared, lambda n: F.when(n > 0, F.least(F.lit(0.22), 0.08 * n)).otherwise(0.0))).otherwise(0.0)
    sight = etype == "attraction"
    known = F.when(sight & text.opening_hours(F.col("opening")).isNotNull(), 0.05).otherwise(0.0) + F.when(sight & text.duration_minutes(F.col("duration")).isNotNull(), 0.05).otherwise(0.0)
    km = geo.haversine_km(F.col("anchor_lat"), F.col("anchor_lon"), F.col("lat"), F.col("lon"))
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), 0.04 + 0.12 * F.coalesce(F.greatest(zero, 1 - km / 20), zero)).otherwise(0.0)
    return F.least(F.lit(1.2), 0.3 + meal + hotel + tags + F.when(budget_ok(), 0.1).otherwise(0.0) + known + place)


def notes() -> Column:
    """What the constraint score saw, in the order of its terms."""
    etype = F.col("etype")
    fit = F.greatest(F.lit(0.0), 1 - F.abs(F.col("price") - (F.col("lo") + F.col("hi")) / 2) / F.greatest(F.lit(1.0), F.col("hi") - F.col("lo")))
    liked = F.lower(F.coalesce("category", F.lit(""))).contains(F.lower("category_pref"))
    km = geo.haversine_km(F.col("anchor_lat"), F.col("anchor_lon"), F.col("lat"), F.col("lon"))
    minutes = F.when(etype == "attraction", text.duration_minutes(F.col("duration")))
    out = F.array(
        F.when((etype == "restaurant") & F.col("lo").isNotNull(), F.format_string("meal_fit=%.2f", fit)),
        F.when((etype == "hotel") & F.col("category_pref").isNotNull(), F.format_string("hotel_pref_match=%d", liked.cast("int"))),
        F.when((F.size("tags") > 0) & (F.size("interests") > 0), F.format_string("interest_overlap=%d", F.size(F.array_intersect(F.transform("tags", text.normalize), F.transform("interests", text.normalize))))),
        F.when(budget_ok(), "budget_hint=ok").otherwise("budget_hint=relaxed"),
        F.when((etype == "attraction") & text.opening_hours(F.col("opening")).isNotNull(), "opening_hours=known"),
        text.let(F.struct(minutes.alias("x")), lambda m: F.when(m["x"].isNotNull(), F.format_string("duration_min=%d", m["x"]))),
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), "geo=known"),
        F.when(km.isNotNull(), F.format_string("route_anchor_km=%.2f", km)),
    )
    return F.array_compact(out)


def min_max(name: str, flat: float = 0.0, by: tuple[str, ...] = ("pid",)) -> Column:
    """A score scaled to 0 to 1 among the request's items; where all are alike, `flat`."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(name).over(w), F.max(name).over(w)
    return F.when(hi - lo < 1e-9, F.lit(flat)).otherwise((F.col(name) - lo) / (hi - lo))


def fuse(items: DataFrame, weights: tuple = WEIGHTS, by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """`items(vector, constraint, graph)` with raw_fused and fused; weights are numbers or columns."""
    raw = sum(F.col(c) * w for c, w in zip(("vector", "constraint", "graph"), weights, strict=True))
    scaled = sum(min_max(c, by=by) * w for c, w in zip(("vector", "constraint", "graph"), weights, strict=True))
    return items.withColumn("raw_fused", F.round(raw, ROUND)).withColumn("fused", F.round(scaled, ROUND))


def similarity(a: str, b: str) -> Column:
    """Of two candidate structs with cid, tokens, tags, etype and name: words, tags, type and name weighed together."""
    x, y = F.col(a), F.col(b)
    same = lambda c: (x[c] == y[c]).cast("double")
    fold = lambda t: F.transform(t, text.normalize)
    mixed = 0.45 * text.jaccard(x["tokens"], y["tokens"]) + 0.25 * text.jaccard(fold(x["tags"]), fold(y["tags"])) + 0.2 * same("etype") + 0.1 * (text.normalize(x["name"]) == text.normalize(y["name"])).cast("double")
    return F.when(x["cid"] == y["cid"], 1.0).otherwise(F.least(F.lit(1.0), mixed))


def _ratios(sets: pa.ListArray) -> Iterator[np.ndarray]:
    """For lists of lists of words, of each outer one the share of words in common of each two inner ones; an empty one shares nothing."""
    inner = sets.flatten()
    ids = inner.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
    word = np.concatenate([[0], np.cumsum(size)])
    at = 0
    for n in pc.list_value_length(sets).to_pylist():
        words, of = ids[word[at] : word[at + n]], np.repeat(np.arange(n), size[at : at + n])
        known, place = np.unique(words, return_inverse=True)
        held = np.zeros((n, len(known)), np.float32)
        held[of, place] = 1
        both, own = (held @ held.T).astype(float), held.sum(axis=1).astype(float)
        yield np.where(both > 0, both / np.maximum(own[:, None] + own - both, 1), 0.0)
        at += n


def rerank(items: DataFrame, limit: int | Column = 20) -> DataFrame:
    """Greedy diversity order, the first `limit` (a number or a column of the items): `(pid, cid, position, rerank, penalty)`.

    Sequential by nature: each pick depends on those before it. A request's items, a sandbox of
    bounded size, are one row; similarities are computed once against the last pick. Worths are
    rounded to ROUND digits before they are compared; of equal ones the earlier item wins.
    """
    most = F.lit(limit) if isinstance(limit, int) else limit
    item = F.struct((-F.col("fused")).alias("f"), "tier", "ord", "cid", "etype", text.normalize(F.col("name")).alias("plain"), text.tokenize(F.col("text")).alias("tokens"), text.normalize_all(F.col("tags")).alias("tags"))
    need = items.select("pid", most.cast("int").alias("most"), item.alias("x")).groupBy("pid").agg(F.max("most").alias("most"), F.sort_array(F.collect_list("x")).alias("items"))

    def pick(most: int, first: np.ndarray, hotel: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, float, float]]:
        closest, left, hotels, best = np.zeros(len(first)), np.ones(len(first), bool), False, None
        for _ in range(min(most, len(first))):
            if best is None:
                best, worth, penalty = 0, first[0], 0.0
            else:
                extra = np.where(hotel & hotels, HOTEL_PENALTY, 0.0)
                worths = np.where(left, LAMBDA * first - (1 - LAMBDA) * closest - extra, -np.inf)
                among = np.flatnonzero(worths >= worths.max() - 2 * 10.0**-ROUND).tolist()
                rounded = [round(worths[i].item(), ROUND) for i in among]
                worth = max(rounded)
                best = among[rounded.index(worth)]
                penalty = closest[best] + extra[best]
            yield best, worth, penalty
            hotels, left[best] = hotels or bool(hotel[best]), False
            closest = np.maximum(closest, near[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            x, n = items.flatten(), pc.list_value_length(items).to_pylist()
            lists = lambda c: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), x.field(c))  # noqa: B023, E731
            code = lambda c: pc.fill_null(x.field(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            first, etype, plain = -x.field("f").to_numpy(zero_copy_only=False), code("etype"), code("plain")
            hotel = pc.fill_null(pc.equal(x.field("etype"), "hotel"), False).to_numpy(zero_copy_only=False)
            rows, at = [], 0
            for k, (most_, tokens, tags) in enumerate(zip(batch.column("most").to_pylist(), _ratios(lists("tokens")), _ratios(lists("tags")), strict=True)):
                s = slice(at, at + n[k])
                near = 0.45 * tokens + 0.25 * tags + 0.2 * (etype[s, None] == etype[s]) + 0.1 * (plain[s, None] == plain[s])
                rows += [(k, at + i, position, worth, penalty) for position, (i, worth, penalty) in enumerate(pick(most_, first[s], hotel[s], np.minimum(near, 1.0)), 1)]
                at += n[k]
            of, which, position, worth, penalty = (np.array([r[c] for r in rows], t) for c, t in enumerate((int, int, int, float, float)))
            yield pa.RecordBatch.from_arrays([batch.column("pid").take(pa.array(of)), x.field("cid").take(pa.array(which)), pa.array(position), pa.array(worth), pa.array(penalty)], names=["pid", "cid", "position", "rerank", "penalty"])

    return need.mapInArrow(run, "pid long, cid string, position long, rerank double, penalty double")
