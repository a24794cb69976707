"""Plans, requests, retrieval and diagnostics as text and JSON, and what a language model is asked and answers.

A model is a table of replies, `(pid, attempt, reply)`, written by whatever serves it; prompts are
a column, so that serving them is a join away. Nothing here calls a service.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.functions.scratch import cut
from wayfinder.operators import recover
from wayfinder.operators.planning import BUFFER

#: Candidates that a prompt lists at most; fixed words of prompts and forms.
LISTED = 24
PLANNER = "You are a travel planner. Output valid JSON only. Never invent candidate ids. Only use ids from the provided shortlist."
JUDGE = "You are an itinerary evaluator. Compare two travel plans for the same user request. Focus only on which plan better fits the user's stated preferences and constraints. Output valid JSON only."
REPAIR = "You repair malformed JSON. Output exactly one valid JSON object and nothing else. Use double quotes for every key and every string value."
PLAN_FORM = json.dumps({"hotel_candidate_id": "one hotel candidate id", "days": {"1": [{"candidate_id": "attraction or restaurant id", "action": "sightseeing or dining"}]}})
JUDGE_FORM = json.dumps({"winner": "A or B or tie", "itinerary_a_score": "0-10", "itinerary_b_score": "0-10", "rationale": "short reason"})


def ordered(rows: DataFrame, line: Column, *order: str, between: str = "\n", name: str = "said", by: tuple[str, ...] = ("pid",)) -> DataFrame:
    """Lines of a group, in order, as one text; a group is a plan or a shortlist, which days and sandbox bound."""
    one = rows.select(*by, F.struct(*order, line.alias("_line")).alias("x")).groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return one.select(*by, F.array_join(F.transform("x", lambda x: x["_line"]), between).alias(name))


def money(price: Column) -> Column:
    return F.format_string("%.2f", price)


def plan_words(acts: DataFrame, hotels: DataFrame, rides: DataFrame, pool: DataFrame) -> DataFrame:
    """`(pid, text)`: a plan as the texts of its hotel, rides and activities in turn; a ride is its mode, route, number, time and price."""
    known = pool.select("pid", "cid", F.col("text").alias("_text")).dropDuplicates(["pid", "cid"])
    h = hotels.select("pid", "cid", "name").join(known, ["pid", "cid"], "left").select("pid", F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.coalesce("_text", "name").alias("line"))
    r = rides.select("pid", F.lit(1), F.when(F.col("direction") == "outbound", 0).otherwise(1).cast("long"), F.lit(0).cast("long"), F.concat_ws(" ", "mode", "number", text.format_range(F.col("start"), F.col("end")), F.col("price").cast("string")))
    a = acts.select("pid", F.lit(2), "plan_day", "seq", F.coalesce("text", F.concat_ws(" ", text.format_range(F.col("start"), F.col("end")), "cid", "action", F.col("price").cast("string"))))
    return ordered(h.union(r).union(a).where("line <> ''"), F.col("line"), "a", "b", "c", between=" ", name="text")


def plan_form(whole: DataFrame) -> DataFrame:
    """`(pid, said)` from the rows of `planning.whole`: a line for the hotel, one for the rides, one for each day."""
    kind = F.col("kind")
    time = text.format_range(F.col("start"), F.col("end"))
    at = F.concat(F.lit("day "), F.col("plan_day").cast("string"), F.lit(": "))
    item = F.when(kind == "hotel", F.concat(at, "name", F.lit(" ("), money(F.col("price")), F.lit("/night)"))).when(kind == "transport", F.concat(at, F.concat_ws(" ", "action", "route", "name", time, money(F.col("price"))))).otherwise(F.concat(F.concat_ws(" ", time, "action", "name"), F.lit(" ("), money(F.col("price")), F.lit(")")))
    part = F.when(kind == "hotel", 0).when(kind == "transport", 1).otherwise(F.col("plan_day") + 1)
    head = F.when(kind == "hotel", "hotel: ").when(kind == "transport", "transport: ").otherwise(F.concat(F.lit("day_"), F.col("plan_day").cast("string"), F.lit(": ")))
    rows = whole.withColumn("part", part).withColumn("head", head).withColumn("seq", F.coalesce("seq", F.col("plan_day")))
    lines = ordered(rows, item, "plan_day", "seq", "name", between="; ", name="line", by=("pid", "part", "head"))
    return ordered(lines, F.concat("head", "line"), "part")


def reference_form(plans: DataFrame) -> DataFrame:
    """`(pid, said)` from reference plans in JSON, `plans(pid, final_plan_json)`, in the same form."""
    schema = "hotel array<struct<day:string,name:string,price_per_night:string>>, transportation array<struct<day:string,mode:string,route:string,number:string,time:string,price:string>>, itinerary map<string,array<struct<time:string,action:string,location:string,price:string>>>"
    p = F.from_json("final_plan_json", schema)
    blank = lambda c: F.coalesce(c, F.lit(""))
    stay = F.array_join(F.transform(p["hotel"], lambda x: F.concat(F.lit("day "), blank(x["day"]), F.lit(": "), blank(x["name"]), F.lit(" ("), blank(x["price_per_night"]), F.lit("/night)"))), "; ")
    ride = F.array_join(F.transform(p["transportation"], lambda x: F.concat(F.lit("day "), blank(x["day"]), F.lit(": "), F.concat_ws(" ", x["mode"], x["route"], x["number"], x["time"], x["price"]))), "; ")
    day = lambda e: F.concat(e["key"], F.lit(": "), F.array_join(F.transform(e["value"], lambda x: F.concat(F.concat_ws(" ", x["time"], x["action"], x["location"]), F.lit(" ("), blank(x["price"]), F.lit(")"))), "; "))
    days = F.transform(F.array_sort(F.map_entries(p["itinerary"])), day)
    parts = F.concat(F.array(F.when(F.size(p["hotel"]) > 0, F.concat(F.lit("hotel: "), stay)), F.when(F.size(p["transportation"]) > 0, F.concat(F.lit("transport: "), ride))), F.coalesce(days, F.array().cast("array<string>")))
    return plans.select("pid", F.array_join(F.array_compact(parts), "\n").alias("said"))


def request_block() -> Column:
    """A request as JSON."""
    meal = F.when(F.col("lo").isNotNull(), F.array("lo", "hi"))
    return F.to_json(F.struct(F.col("query").alias("query_text"), F.col("day").alias("trip_days"), "budget", meal.alias("meal_price_range"), F.col("category_pref").alias("hotel_category_pref"), "intensity_pref", F.col("interests").alias("interest_tags")))


def judge_prompts(specs: DataFrame, generated: DataFrame, reference: DataFrame) -> DataFrame:
    """`(pid, a_is_generated, prompt)`: both plans in an order that the request alone decides."""
    rows = specs.join(generated.select("pid", F.col("said").alias("_g")), "pid").join(reference.select("pid", F.col("said").alias("_r")), "pid")
    rows = rows.withColumn("a_is_generated", text.blind_first(F.col("pid"), F.col("query")))
    a, b = F.when(F.col("a_is_generated"), F.col("_g")).otherwise(F.col("_r")), F.when(F.col("a_is_generated"), F.col("_r")).otherwise(F.col("_g"))
    said = F.concat(F.lit("Which itinerary suits the user better? The order of the two means nothing.\n\nUser request:\n"), request_block(), F.lit("\n\nItinerary A:\n"), a, F.lit("\n\nItinerary B:\n"), b, F.lit(f"\n\nReturn JSON with this schema:\n{JUDGE_FORM}"))
    return rows.select("pid", "a_is_generated", said.alias("prompt"))


def judged(replies: DataFrame) -> DataFrame:
    """`(pid, a_is_generated, score, winner, generated_score, reference_score, rationale)` from `replies(pid, a_is_generated, reply)`; replies without an object are left out."""
    rows = recover.json_objects(replies, "reply").where("payload is not null")
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    a, b = (recover.clamp(field(f"itinerary_{x}_score").try_cast("double")) for x in "ab")
    won = F.lower(F.trim(field("winner")))
    first = F.col("a_is_generated")
    winner = F.when((won == "a") == first, "generated").otherwise("reference")
    rows = rows.select("pid", "a_is_generated", F.when(first, a).otherwise(b).alias("generated_score"), F.when(first, b).otherwise(a).alias("reference_score"), F.when(won.isin("a", "b"), winner).otherwise("tie").alias("winner"), F.trim(F.coalesce(field("rationale"), F.lit(""))).alias("rationale"))
    return rows.withColumn("score", recover.preference(F.col("generated_score"), F.col("reference_score")))


def agreement(scored: DataFrame) -> DataFrame:
    """`scored`, the rows of `judged` for both orders of presentation, with `agree`: whether a request has a score in both and both name one winner."""
    both = scored.groupBy("pid").agg(F.count_distinct("a_is_generated").alias("_n"), F.min("winner").alias("_low"), F.max("winner").alias("_high"))
    return scored.join(both, "pid").withColumn("agree", (F.col("_n") == 2) & (F.col("_low") == F.col("_high"))).drop("_n", "_low", "_high")


def transport_lines(specs: DataFrame, rides: DataFrame, windows: DataFrame) -> DataFrame:
    """`(pid, said)`: what the rides leave of each day, a line each."""
    there = F.col("direction") == "outbound"
    ends = rides.join(specs.select("pid", "day"), "pid")
    limit = F.when(there, F.concat(F.lit("day_1 earliest activity start >= "), text.format_minutes(F.col("end") + BUFFER))).otherwise(F.concat(F.lit("day_"), F.col("day").cast("string"), F.lit(" latest activity end <= "), text.format_minutes(F.col("start") - BUFFER)))
    day = F.concat(F.lit("day_"), F.col("plan_day").cast("string"))
    usable = F.concat(day, F.lit(" usable window is "), text.format_range(F.col("open"), F.col("close")), F.lit(", for no more than "), F.col("most").cast("string"), F.lit(" activities"))
    usable = F.when(F.col("close") - F.col("open") < 45, F.concat(day, F.lit(" has almost no time beside transport; leave it empty or plan one short meal"))).otherwise(usable)
    rows = ends.select("pid", F.when(there, 0).otherwise(1).cast("long").alias("at"), limit.alias("line")).union(windows.select("pid", F.col("plan_day") + 1, usable))
    return ordered(rows, F.concat(F.lit("- "), F.col("line")), "at")


def prompts(specs: DataFrame, chosen: DataFrame, rides: DataFrame, windows: DataFrame, suggestions: DataFrame | None = None, risk: DataFrame | None = None) -> DataFrame:
    """`(pid, system, prompt)` that ask a model for a plan of the chosen candidates, LISTED of them at most."""
    note = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"; {name}="), F.col(c))).otherwise("")
    tags = F.when(F.size("tags") > 0, F.array_join(F.slice("tags", 1, 4), ", ")).otherwise("none")
    line = F.concat(F.lit("- id="), F.col("cid"), F.lit("; type="), F.col("etype"), F.lit("; name="), F.col("name"), F.lit("; price="), money(F.col("price")), F.lit("; tags="), tags, note("opening", "opening"), note("recommended_duration", "duration"), F.lit("; text="), F.col("text"))
    listed = ordered(chosen.where(F.col("position") <= LISTED), line, "position", name="listed")
    rows = specs.join(listed, "pid", "left").join(transport_lines(specs, rides, windows).withColumnRenamed("said", "ways"), "pid", "left")
    names = chosen.select("pid", "cid", "name")
    if suggestions is not None:
        picks = suggestions.select("pid", "plan_day", F.posexplode("picks").alias("at", "cid")).join(names, ["pid", "cid"])
        days = ordered(picks, F.concat_ws(":", "cid", "name"), "at", between=", ", name="line", by=("pid", "plan_day"))
        rows = rows.join(ordered(days, F.concat(F.lit("- day_"), F.col("plan_day").cast("string"), F.lit(" -> "), F.col("line")), "plan_day", name="clusters"), "pid", "left")
    else:
        rows = rows.withColumn("clusters", F.lit(None).cast("string"))
    rows = rows.join(risk.select("pid", "risk"), "pid", "left") if risk is not None else rows.withColumn("risk", F.lit(None).cast("string"))
    said = lambda name, c, none="unknown": F.concat(F.lit(f"- {name}="), F.coalesce(c.cast("string"), F.lit(none)), F.lit("\n"))
    meal = F.when(F.col("lo").isNotNull(), F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    asked = F.concat(said("trip_days", F.col("day")), said("departure_city", F.col("departure")), said("destination_city", F.col("destination")), said("budget", F.col("budget")), said("meal_price_range", meal), said("hotel_category_pref", F.col("category_pref"), "none"), said("intensity_pref", F.col("intensity_pref"), "none"), said("interest_tags", F.array_join("interests", ", ")), said("budget_risk_hint", F.col("risk")))
    block = lambda title, c: F.when(c.isNotNull(), F.concat(F.lit(f"\n{title}:\n"), c, F.lit("\n"))).otherwise("")
    prompt = F.concat(
        F.lit("Plan an itinerary from the shortlist, with 2 to 5 activities a day. Keep days compact, keep to opening hours, budget and preferences, and repeat no place while others are left.\n\nRequest:\n"), asked,
        block("Transport windows", F.col("ways")), block("Suggested days", F.col("clusters")), block("Shortlist", F.col("listed")), F.lit(f"\nReturn JSON with this schema:\n{PLAN_FORM}"),
    )
    return rows.select("pid", F.lit(PLANNER).alias("system"), prompt.alias("prompt"))


def retry_prompt(prompt: Column, attempt: Column, reply: Column, error: Column) -> Column:
    """The prompt of a later attempt: what was wrong with the one before it, and what it said."""
    again = F.concat(prompt, F.lit("\n\nYour last answer was no valid JSON object. Return exactly one, without fences, comments or trailing commas."), F.coalesce(F.concat(F.lit("\nError: "), error), F.lit("")), F.coalesce(F.concat(F.lit("\nLast answer:\n"), reply), F.lit("")))
    return F.when(attempt <= 1, prompt).otherwise(again)


def repair_prompt(reply: Column, error: Column) -> Column:
    return F.concat(F.lit("Rewrite this as one valid JSON object with the same content, double quotes around keys and strings, and nothing else.\n"), F.coalesce(F.concat(F.lit("Parser error: "), error, F.lit("\n")), F.lit("")), F.lit("To repair:\n"), text.sanitize(reply))


def resolved(refs: DataFrame, pool: DataFrame) -> DataFrame:
    """`refs(pid, at, ref, etype)` with `cid`: the candidate with that id if its type is right, else none; no id, the first of the type whose name holds the reference or is held by it."""
    own = pool.select("pid", F.col("cid").alias("_cid"), F.col("etype").alias("_type"), F.col("ord").alias("_ord"), text.normalize(F.col("name")).alias("_name"))
    both = refs.withColumn("_said", text.normalize(F.col("ref"))).join(own, "pid", "left")
    exact = F.col("_cid") == F.col("ref")
    right = F.col("_type") == F.col("etype")
    near = right & (F.col("_said") != "") & (F.col("_name") != "") & (F.col("_name").contains(F.col("_said")) | F.col("_said").contains(F.col("_name")))
    one = both.groupBy(*refs.columns).agg(F.max(exact).alias("there"), F.max(F.when(exact & right, F.col("_cid"))).alias("same"), F.min(F.when(near, F.struct("_ord", "_cid"))).alias("first"))
    return one.select(*refs.columns, F.when(F.col("there"), F.col("same")).otherwise(F.col("first._cid")).alias("cid"))


#: What a plan's JSON holds.
SHAPE = "hotel_candidate_id string, days map<string,array<struct<candidate_id:string,name:string,action:string>>>"


def converse(prompts: DataFrame, serve, attempts: int = 3, repairs: int = 2) -> tuple[DataFrame, DataFrame]:
    """Asks a model for plans until each request has one or its attempts are used up: `(pid, payload, asks)` and the log `(pid, attempt, repair, error, response)`.

    `serve(asked)` answers `asked(pid, attempt, repair, prompt)` with `(pid, attempt, repair, reply)`;
    a missing answer counts as an empty one. A reply without an object is sent back to be repaired,
    `repairs` times at most; then, or where its days are no object, the next attempt says what was
    wrong. Every round asks for the open requests alone and is kept as a table; there are
    attempts * (repairs + 1) rounds at most. A request that never settles has a null payload.
    """
    open_ = cut(prompts.select("pid", F.col("prompt").alias("base"), F.lit(1).alias("attempt"), F.lit(0).alias("repair"), "prompt"))
    rounds = []
    while not open_.isEmpty():
        heard = open_.join(serve(open_.select("pid", "attempt", "repair", "prompt")).select("pid", "attempt", "repair", "reply"), ["pid", "attempt", "repair"], "left")
        parsed = recover.json_objects(heard, "reply")
        days = F.trim(F.get_json_object("payload", "$.days"))
        error = F.when(F.col("payload").isNull(), "no JSON object").when(days.isNotNull() & ~days.startswith("{"), "days is no object")
        now = cut(parsed.withColumn("error", error).withColumn("response", text.sanitize(F.col("reply"))))
        rounds.append(now.select("pid", "attempt", "repair", "error", "response", "payload"))
        again = F.col("payload").isNull() & (F.col("repair") < repairs)
        failed = now.where("error is not null").where(again | (F.col("attempt") < attempts))
        later = retry_prompt(F.col("base"), F.col("attempt") + 1, F.col("response"), F.col("error"))
        asked = F.when(again, repair_prompt(F.coalesce("reply", F.lit("")), F.col("error"))).otherwise(later)
        open_ = cut(failed.select("pid", "base", F.when(again, F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"), F.when(again, F.col("repair") + 1).otherwise(0).alias("repair"), asked.alias("prompt")))
    if not rounds:
        none = prompts.select("pid", F.lit(0).alias("attempt"), F.lit(0).alias("repair"), *(F.lit(None).cast("string").alias(c) for c in ("error", "response", "payload"))).limit(0)
        rounds = [none]
    log = rounds[0]
    for r in rounds[1:]:
        log = log.unionByName(r)
    settled = log.groupBy("pid").agg(F.max(F.when(F.col("error").isNull(), F.col("payload"))).alias("payload"), F.count("*").alias("asks"), F.max_by("error", F.struct("attempt", "repair")).alias("last_error"))
    return settled, log.drop("payload")


def planned_items(payloads: DataFrame, pool: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `payloads(pid, payload)` plan: activities `(pid, plan_day, seq, cid, action)` and hotels `(pid, cid)`.

    An activity needs a known action and a candidate of its type, once a day, within what the day takes.
    """
    good = payloads.select("pid", F.from_json("payload", SHAPE).alias("p"))
    items = good.select("pid", F.explode("p.days").alias("d", "list")).select("pid", F.col("d").try_cast("long").alias("plan_day"), F.posexplode("list").alias("n", "x"))
    items = items.join(windows.select("pid", "plan_day", "most"), ["pid", "plan_day"]).where(F.col("n") < F.col("most"))
    act = F.lower(F.trim("x.action"))
    items = items.withColumn("action", act).where(act.isin("sightseeing", "dining")).withColumn("etype", F.when(act == "dining", "restaurant").otherwise("attraction"))
    refs = items.select("pid", F.concat_ws("/", F.col("plan_day").cast("string"), F.col("n").cast("string")).alias("at"), F.trim(F.coalesce("x.candidate_id", "x.name", F.lit(""))).alias("ref"), "etype", "plan_day", "n", "action")
    found = resolved(refs, pool).where("cid is not null").groupBy("pid", "plan_day", "cid", "action").agg(F.min("n").alias("n"))
    acts = found.select("pid", "plan_day", (F.col("n") + 1).cast("long").alias("seq"), "cid", "action")
    beds = good.select("pid", F.lit("hotel").alias("at"), F.trim(F.coalesce("p.hotel_candidate_id", F.lit(""))).alias("ref"), F.lit("hotel").alias("etype")).where("ref <> ''")
    return acts, resolved(beds, pool).where("cid is not null").select("pid", "cid")


def model_plans(replies: DataFrame, pool: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stored replies plan: activities and hotels as of `planned_items`, and failures `(pid, attempt, error, response)`. Of the attempts of a request the first with an object that has days counts."""
    parsed = recover.json_objects(replies, "reply").withColumn("p", F.from_json("payload", SHAPE))
    error = F.when(F.col("payload").isNull(), "no JSON object").when(F.col("p.days").isNull(), "no days")
    parsed = cut(parsed.withColumn("error", error))
    failures = parsed.where("error is not null").select("pid", "attempt", "error", text.sanitize(F.col("reply")).alias("response"))
    good = parsed.where("error is null").groupBy("pid").agg(F.min_by("payload", "attempt").alias("payload"))
    acts, beds = planned_items(good, pool, windows)
    return acts, beds, failures


def reasons() -> Column:
    """Why an item stands where it stands, as its scores."""
    parts = ["vector", "constraint", "graph", "fused", "rerank"]
    return F.format_string(", ".join(f"{p}=%.3f" for p in parts) + ", diversity_penalty=%.3f", *parts, "penalty")


def traces(items: DataFrame) -> DataFrame:
    """`(pid, reasons, top_candidates)`: maps of reasons by candidate, and the first ten items as JSON."""
    scores = F.struct(F.round("vector", 6).alias("vector"), F.round("constraint", 6).alias("constraint"), F.round("graph", 6).alias("graph"), F.col("fused"))
    shown = F.struct("position", F.col("cid").alias("candidate_id"), "name", F.col("etype").alias("entity_type"), "city", F.round("price", 2).alias("price"), scores.alias("scores"), "rerank", F.col("penalty").alias("diversity_penalty"), F.col("notes").alias("constraint_notes"))
    one = items.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("cid", reasons().alias("why")))).alias("reasons"), F.sort_array(F.collect_list(F.when(F.col("position") <= 10, shown))).alias("top"))
    return one.select("pid", "reasons", F.to_json("top").alias("top_candidates"))


def diagnostics(plan: dict[str, DataFrame]) -> DataFrame:
    """`(pid, diagnostics)`: counts of the retrieval, summary, and what the checks said, as JSON."""
    tier = lambda k, name: F.count_if(F.col("tier") == k).alias(name)
    trace = plan["items"].groupBy("pid").agg(F.count("*").alias("final_count"), tier(0, "strict"), tier(1, "budget_relaxed"), tier(2, "hard_relaxed"), F.max("scope").alias("vector_scope"))
    rows = plan["report"].join(trace, "pid", "left").join(traces(plan["items"]), "pid", "left").join(plan["summaries"].select("pid", "mode", "reason", "risk", F.col("chosen").alias("chosen_ids")), "pid", "left")
    checks_ = [c for c in plan["report"].columns if c.endswith("_ok")]
    retrieval = F.struct("final_count", "strict", "budget_relaxed", "hard_relaxed", "vector_scope")
    gate = F.struct(F.col("mode").alias("gate_mode"), F.col("reason").alias("gate_reason"), F.col("risk").alias("budget_risk"), "chosen_ids")
    report = F.struct(F.col("errors").alias("validator_failure_reasons"), F.struct(*checks_).alias("validator_checks"), F.col("repaired").alias("validator_repaired"))
    return rows.select("pid", F.to_json(F.struct(retrieval.alias("trace"), gate.alias("summary"), report.alias("validator"), "reasons")).alias("diagnostics"))


def flat(metrics: DataFrame, names: list[str]) -> DataFrame:
    """`(…, metric, value)`: rows of a comparison, one for each metric."""
    return metrics.unpivot([c for c in metrics.columns if c not in names], names, "metric", "value")
