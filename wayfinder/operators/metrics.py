"""Evaluation of plans: rates, routes, ranking and personalisation, one row a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.operators.checks import day_routes
from wayfinder.operators.planning import BUFFER


def rate(passed: Column) -> Column:
    """The share of checked rows that pass; null rows are not checked, and 1 where none is."""
    return F.coalesce(F.avg(passed.cast("double")), F.lit(1.0))


def opening_compliance(acts: DataFrame) -> DataFrame:
    hours = text.opening_hours(F.col("opening"))
    ok = F.when((F.col("action") == "sightseeing") & hours.isNotNull(), (hours["start"] <= F.col("start")) & (F.col("end") <= hours["end"]))
    return acts.withColumn("_ok", ok).groupBy("pid").agg(rate(F.col("_ok")).alias("opening_hours_compliance"))


def stay_feasibility(acts: DataFrame) -> DataFrame:
    """Against the recommended length itself, without bounds; a meal takes an hour."""
    need = F.when(F.col("action") == "dining", 60).otherwise(text.duration_minutes(F.col("duration")))
    return acts.withColumn("_ok", F.col("end") - F.col("start") >= need).groupBy("pid").agg(rate(F.col("_ok")).alias("stay_duration_feasibility"))


def transport_feasibility(specs: DataFrame, acts: DataFrame, rides: DataFrame) -> DataFrame:
    ends = acts.groupBy("pid").agg(F.min(F.when(F.col("plan_day") == 1, F.col("start"))).alias("first"), F.max(F.when(F.col("plan_day") == F.col("day"), F.col("end"))).alias("last"))
    ways = rides.groupBy("pid").agg(F.max(F.when(F.col("direction") == "outbound", F.col("end"))).alias("arrive"), F.min(F.when(F.col("direction") == "inbound", F.col("start"))).alias("leave"))
    t = specs.select("pid").join(ends, "pid", "left").join(ways, "pid", "left")
    out, back = (F.col("arrive") + BUFFER <= F.col("first")).cast("double"), (F.col("last") + BUFFER <= F.col("leave")).cast("double")
    n = out.isNotNull().cast("int") + back.isNotNull().cast("int")
    zero = F.lit(0.0)
    return t.select("pid", F.when(n == 0, 1.0).otherwise((F.coalesce(out, zero) + F.coalesce(back, zero)) / n).alias("transport_time_feasibility"))


def ranking(evidence: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """recall_at_k and ndcg_at_k from `evidence(pid, cid, position)` and `truth(pid, cid)`."""
    n = truth.select("pid", "cid").distinct().groupBy("pid").agg(F.count("*").alias("n"))
    hits = evidence.select("pid", "cid", "position").join(truth.select("pid", "cid").distinct().withColumn("hit", F.lit(1)), ["pid", "cid"], "left")
    return rates(hits.join(n, "pid", "left").groupBy("pid"), F.first("n").alias("n"), ks)


def names(ks: tuple[int, ...] = (5, 10)) -> list[str]:
    return [f"{m}_at_{k}" for k in ks for m in ("recall", "ndcg")]


def rates(ranked: GroupedData, n: Column, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """recall_at_k and ndcg_at_k of groups of rows with `position` and `hit`; `n`: how many there are to find."""
    gain = F.col("hit") / F.log2(F.col("position") + 1)
    t = ranked.agg(n, *(f for k in ks for f in (F.sum(F.when(F.col("position") <= k, F.col("hit"))).alias(f"h{k}"), F.sum(F.when(F.col("position") <= k, gain)).alias(f"d{k}"))))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = []
    for k in ks:
        out += [text.safe_div(F.coalesce(f"h{k}", F.lit(0)).cast("double"), F.col("n")).alias(f"recall_at_{k}"), F.when(F.col("n") > 0, F.coalesce(f"d{k}", F.lit(0.0)) / ideal(k)).otherwise(0.0).alias(f"ndcg_at_{k}")]
    return t.select(*(c for c in t.columns if c != "n" and c[1:] not in map(str, ks)), *out)


def context(selected: DataFrame, evidence: DataFrame, truth: DataFrame) -> DataFrame:
    """context_precision: selected that are evidence; context_recall: truth that is evidence."""
    e = evidence.select("pid", "cid").distinct().withColumn("seen", F.lit(1))
    share = lambda rows, name: rows.select("pid", "cid").distinct().join(e, ["pid", "cid"], "left").groupBy("pid").agg((F.count("seen") / F.count("*")).alias(name))
    return share(selected, "context_precision").join(share(truth, "context_recall"), "pid", "full").fillna(0.0)


def grounding(acts: DataFrame, hotels: DataFrame, pool: DataFrame, evidence: DataFrame) -> DataFrame:
    """entity_grounding_rate, faithfulness and evidence_grounding_rate."""
    known = pool.select("pid", "cid", F.col("etype").alias("_t")).distinct()
    ev = evidence.select("pid", "cid").distinct().withColumn("_e", F.lit(1))
    a = acts.select("pid", "cid", "action").join(known, ["pid", "cid"], "left").join(ev, ["pid", "cid"], "left")
    right = (F.col("action") == "dining") == (F.col("_t") == "restaurant")
    a = a.select("pid", F.lit(1).alias("act"), F.coalesce(right, F.lit(False)).cast("int").alias("ok"), F.col("_t").isNotNull().cast("int").alias("there"), F.coalesce("_e", F.lit(0)).alias("ev"))
    h = hotels.select("pid", "cid").join(known, ["pid", "cid"], "left").select("pid", F.lit(0).alias("act"), F.coalesce(F.col("_t") == "hotel", F.lit(False)).cast("int").alias("ok"), F.lit(0).alias("there"), F.lit(0).alias("ev"))
    t = a.union(h).groupBy("pid").agg(F.count("*").alias("n"), F.sum("act").alias("acts"), F.sum("ok").alias("ok"), F.sum("there").alias("there"), F.sum("ev").alias("ev"))
    acts_n = F.greatest(F.lit(1), F.col("acts"))
    return t.select("pid", (F.col("ok") / F.col("n")).alias("entity_grounding_rate"), (F.col("there") / acts_n).alias("faithfulness"), (F.col("ev") / acts_n).alias("evidence_grounding_rate"))


def schema_validity(acts: DataFrame, hotels: DataFrame, rides: DataFrame) -> DataFrame:
    """Valid checks over 3 + hotels + rides + 2 x days + activities; a part is valid if none of its fields is null or empty."""
    full = lambda *cs: F.when(F.greatest(*(F.col(c).isNull() | (F.col(c).cast("string") == "") for c in cs)), 0).otherwise(1)
    a = acts.select("pid", full("start", "end", "price", "action", "cid").alias("ok"))
    parts = a.union(hotels.select("pid", full("price", "cid"))).union(rides.select("pid", full("mode", "number", "start", "end", "price"))).groupBy("pid").agg(F.count("*").alias("n"), F.sum("ok").alias("ok"))
    days = acts.groupBy("pid").agg(F.countDistinct("plan_day").alias("d"))
    t = parts.join(days, "pid", "left").fillna(0, ["d"])
    return t.select("pid", ((F.col("ok") + 3 + 2 * F.col("d")) / (F.col("n") + 3 + 2 * F.col("d"))).alias("schema_validity_rate"))


def transport_grounding(rides: DataFrame, transport: DataFrame, specs: DataFrame) -> DataFrame:
    """Directions whose ride is among the offers (mode, number, times and a price within 1e-6), over those expected or taken."""
    way = specs.select("pid", "departure", "destination")
    r = rides.join(way, "pid").withColumn("from_city", F.when(F.col("direction") == "outbound", F.col("departure")).otherwise(F.col("destination"))).withColumn("to_city", F.when(F.col("direction") == "outbound", F.col("destination")).otherwise(F.col("departure")))
    offers = transport.select("from_city", "to_city", "mode", "number", "start", "end", F.col("price").alias("_p"))
    hit = r.join(offers, ["from_city", "to_city", "mode", "number", "start", "end"]).where(F.abs(F.col("price") - F.col("_p")) < 1e-6).groupBy("pid").agg(F.countDistinct("direction").alias("hit"))
    routes = transport.select("from_city", "to_city").distinct()
    expected = way.select("pid", F.explode(F.array(F.struct(F.col("departure").alias("from_city"), F.col("destination").alias("to_city")), F.struct(F.col("destination").alias("from_city"), F.col("departure").alias("to_city")))).alias("x")).select("pid", "x.*").join(routes, ["from_city", "to_city"]).distinct().groupBy("pid").agg(F.count("*").alias("expected"))
    t = way.select("pid").join(hit, "pid", "left").join(expected, "pid", "left").join(rides.groupBy("pid").agg(F.count("*").alias("taken")), "pid", "left").fillna(0)
    most = F.greatest("expected", "taken")
    return t.select("pid", F.when(most == 0, 1.0).otherwise(F.col("hit") / most).alias("transport_grounding_rate"))


def routes(acts: DataFrame, truth: DataFrame) -> DataFrame:
    """average_route_distance_ratio and max_single_day_route_km of the planned days against the true ones."""
    plan = acts.select("pid", "plan_day").distinct().join(day_routes(acts), ["pid", "plan_day"], "left").fillna(0.0)
    p = plan.groupBy("pid").agg(F.avg("km").alias("p"), F.max("km").alias("max_single_day_route_km"))
    g = day_routes(truth).groupBy("pid").agg(F.avg("km").alias("g"))
    return p.join(g, "pid", "left").select("pid", F.when(F.col("g") > 0, F.col("p") / F.col("g")).otherwise(1.0).alias("average_route_distance_ratio"), "max_single_day_route_km")


def personalization(specs: DataFrame, acts: DataFrame, hotels: DataFrame) -> DataFrame:
    """meal, hotel, interest and intensity fits and their weighed sum."""
    a = acts.withColumn("_meal", (F.col("action") != "dining") | F.col("lo").isNull() | F.col("price").between(F.col("lo"), F.col("hi")))
    one = a.groupBy("pid").agg(F.min("_meal").alias("meal"), F.array_distinct(F.flatten(F.collect_set(F.transform("tags", text.normalize)))).alias("tags"), (F.count("*") / F.countDistinct("plan_day")).alias("pace"))
    h = hotels.groupBy("pid").agg(F.min_by("category", "cid").alias("category"), F.count("*").alias("beds"))
    t = specs.join(one, "pid", "left").join(h, "pid", "left")
    meal = F.coalesce(F.col("meal").cast("double"), F.lit(1.0))
    hotel = F.when(F.col("category_pref").isNull() | F.col("beds").isNull(), 1.0).otherwise(F.lower(F.coalesce("category", F.lit(""))).contains(F.lower("category_pref")).cast("double"))
    wanted = F.array_distinct(F.transform("interests", text.normalize))
    interest = F.when(F.size("interests") == 0, 1.0).otherwise(F.coalesce(F.size(F.array_intersect(wanted, "tags")), F.lit(0)) / F.size(wanted))
    pace = F.coalesce("pace", F.lit(0.0))
    want = F.col("intensity_pref")
    intensity = F.when((want == "low") & (pace > 3), 0.5).when((want == "moderate") & ~pace.between(3, 5), 0.6).when((want == "high") & (pace < 5), 0.6).otherwise(1.0)
    t = t.select("pid", meal.alias("meal_score"), hotel.alias("hotel_score"), interest.alias("interest_coverage"), intensity.alias("intensity_fit"))
    total = 0.35 * F.col("meal_score") + 0.2 * F.col("hotel_score") + 0.3 * F.col("interest_coverage") + 0.15 * F.col("intensity_fit")
    return t.withColumn("personalization_proxy", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def answer_relevancy(specs: DataFrame, acts: DataFrame) -> DataFrame:
    """Jaccard of the words of the request and of the plan's candidates, the form without an embedding model."""
    w = acts.groupBy("pid").agg(F.array_distinct(F.flatten(F.collect_set(text.tokenize(F.col("text"))))).alias("words"))
    t = specs.select("pid", F.array_distinct(text.tokenize(F.col("query"))).alias("asked")).join(w, "pid", "left")
    return t.select("pid", F.coalesce(text.jaccard(F.col("asked"), F.col("words")), F.lit(0.0)).alias("answer_relevancy"))


def feasible() -> Column:
    """1 where every hotel, activity and ride of a plan is one that there is, of the kind it is used as."""
    return F.when((F.col("entity_grounding_rate") >= 1) & (F.col("transport_grounding_rate") >= 1), 1.0).otherwise(0.0)


def text_matches(said: Column, name: Column, raw: Column | None = None) -> Column:
    """Whether a name in a plan is a candidate's: equal to its name or raw name, in it, or around it."""
    t = text.normalize(said)
    of = lambda x: (x != "") & (t.contains(x) | x.contains(t))
    found = of(text.normalize(name)) if raw is None else of(text.normalize(name)) | of(text.normalize(raw))
    return (t != "") & found


def truth_ids(reference: DataFrame, pool: DataFrame) -> DataFrame:
    """`(pid, cid)` of the candidates that a reference plan names: `reference(pid, name)` against `pool(pid, cid, name, ord)`.

    A name that is a candidate's own wins (the last such), else the first candidate whose name
    holds it or is held by it. Names meet inside one request's sandbox, which is bounded.
    """
    named = reference.select("pid", text.normalize(F.col("name")).alias("said")).where("said <> ''").distinct()
    own = pool.select("pid", "cid", "ord", text.normalize(F.col("name")).alias("n")).where("n <> ''")
    near = named.join(own, "pid").where(F.col("n").contains(F.col("said")) | F.col("said").contains(F.col("n")))
    same = F.when(F.col("n") == F.col("said"), F.struct("ord", "cid"))
    best = near.groupBy("pid", "said").agg(F.max(same).alias("same"), F.min(F.struct("ord", "cid")).alias("first"))
    return best.select("pid", F.coalesce("same.cid", "first.cid").alias("cid")).distinct()


def means(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names))


def win_rates(rows: DataFrame, metric: str, base: str) -> DataFrame:
    """`(method, win_rate)`: requests on which a method is strictly better than `base`, in one pass by a window of the request's methods."""
    of_base = F.max(F.when(F.col("method") == base, F.col(metric))).over(Window.partitionBy("pid"))
    r = rows.withColumn("_b", of_base).where("_b is not null")
    return r.groupBy("method").agg(F.when(F.first("method") == base, 0.0).otherwise(F.avg((F.col(metric) > F.col("_b")).cast("double"))).alias("win_rate"))
