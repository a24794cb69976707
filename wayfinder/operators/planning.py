"""Day-by-day plans: transport, hotel, pattern slots, scheduling, and one repair pass.

Windows, durations and opening hours are columns. Filling slots and placing activities are folds over
a request's days inside the JVM, with one clock. A plan row is `(pid, plan_day, seq, start,
end, action, cid, price)`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.functions.scratch import cut
from wayfinder.operators.retrieval import top

# The day, buffers and lengths in minutes; the times of slots.
DAY_START, DAY_END, BUFFER, GAP, MEAL, USUAL, SHORTEST, LONGEST = 540, 1320, 30, 15, 60, 90, 30, 480
SLOT_START = {"morning": 540, "noon": 720, "afternoon": 840, "evening": 1080, "unknown": 900}
SCHEMA = "pid long, plan_day long, seq long, start long, end long, action string, cid string, price double"


def cheapest(transport: DataFrame, specs: DataFrame) -> DataFrame:
    """`(pid, direction, mode, number, start, end, price)`: the cheapest ride there and back, trains before flights."""
    there = specs.select("pid", F.lit("outbound").alias("direction"), F.col("departure").alias("from_city"), F.col("destination").alias("to_city"))
    back = specs.select("pid", F.lit("inbound").alias("direction"), F.col("destination").alias("from_city"), F.col("departure").alias("to_city"))
    # once a route, not once a request; the least of a route is found in every task before the shuffle
    ride = F.struct("price", (F.col("mode") == "flight").alias("air"), "number", "mode", "start", "end")
    best = transport.groupBy("from_city", "to_city").agg(F.min(ride).alias("x")).select("from_city", "to_city", "x.*")
    return there.union(back).join(best, ["from_city", "to_city"]).select("pid", "direction", "mode", "number", "start", "end", "price")


def day_windows(specs: DataFrame, rides: DataFrame) -> DataFrame:
    """`(pid, plan_day, open, close, most)`: the usable minutes of each day and how many activities they take."""
    days = specs.select("pid", "day", F.explode(F.sequence(F.lit(1).cast("long"), "day")).alias("plan_day"))
    out = rides.where("direction = 'outbound'").select("pid", F.col("end").alias("_arrive"))
    back = rides.where("direction = 'inbound'").select("pid", F.col("start").alias("_leave"))
    d = days.join(out, "pid", "left").join(back, "pid", "left")
    start = F.when(F.col("plan_day") == 1, F.greatest(F.lit(DAY_START), F.col("_arrive") + BUFFER)).otherwise(DAY_START)
    end = F.when(F.col("plan_day") == F.col("day"), F.least(F.lit(DAY_END), F.col("_leave") - BUFFER)).otherwise(DAY_END)
    d = d.select("pid", "day", "plan_day", F.coalesce(start, F.lit(DAY_START)).cast("long").alias("open"), F.coalesce(end, F.lit(DAY_END)).cast("long").alias("close"))
    d = d.withColumn("close", F.greatest("open", "close"))
    room = F.col("close") - F.col("open")
    n = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(room / 105)))
    n = F.when((F.col("day") > 1) & ((F.col("plan_day") == 1) | (F.col("plan_day") == F.col("day"))), F.least(n, F.lit(3))).otherwise(n)
    return d.select("pid", "plan_day", "open", "close", F.when(room < 60, 0).otherwise(n).cast("long").alias("most"))


def price_index(pool: DataFrame) -> DataFrame:
    """`pool` with `cheap`, the place of a candidate among those of its type by price."""
    return pool.withColumn("cheap", F.row_number().over(Window.partitionBy("pid", "etype").orderBy("price", "ord", "cid")).cast("long"))


def hotel_of(chosen: DataFrame, pool: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """`(pid, cid, price, category, name)`: the hotel that `named(pid, cid)` says, else the first chosen one, else the cheapest of the sandbox."""
    first = top(chosen.where("etype = 'hotel'"), 1, ["position"]).select("pid", "cid", F.lit(0).alias("_from"))
    cheapest = price_index(pool.where("etype = 'hotel'")).where("cheap = 1").select("pid", "cid", F.lit(1).alias("_from"))
    said = [named.select("pid", "cid", F.lit(-1).alias("_from"))] if named is not None else []
    for more in (cheapest, *said):
        first = first.union(more)
    one = first.groupBy("pid").agg(F.min(F.struct("_from", "cid")).alias("x")).select("pid", F.col("x.cid").alias("cid"))
    return pool.select("pid", "cid", "price", "category", "name").join(one, ["pid", "cid"]).dropDuplicates(["pid"])


def whole(acts: DataFrame, hotels: DataFrame, rides: DataFrame, specs: DataFrame) -> DataFrame:
    """All rows of plans: `(pid, kind, plan_day, seq, start, end, action, cid, name, price, route)` for hotel, transport and activity."""
    ends = specs.select("pid", "day", "departure", "destination")
    there = F.col("direction") == "outbound"
    route = F.when(there, F.concat_ws(" to ", "departure", "destination")).otherwise(F.concat_ws(" to ", "destination", "departure"))
    h = hotels.select("pid", F.lit("hotel").alias("kind"), F.lit(1).cast("long").alias("plan_day"), "cid", "name", F.round("price", 2).alias("price"))
    r = rides.join(ends, "pid").select("pid", F.lit("transport").alias("kind"), F.when(there, 1).otherwise(F.col("day")).cast("long").alias("plan_day"), "start", "end", F.col("mode").alias("action"), F.col("number").alias("name"), "price", route.alias("route"))
    a = acts.select("pid", F.lit("activity").alias("kind"), "plan_day", "seq", "start", "end", "action", "cid", "name", F.round("price", 2).alias("price"))
    return a.unionByName(h, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)


def needed() -> Column:
    """Minutes an activity takes: a meal an hour, a sight what it recommends within bounds."""
    sight = text.let(text.duration_minutes(F.col("duration")), lambda d: F.when(d.isNotNull(), F.least(F.greatest(d, F.lit(SHORTEST)), F.lit(LONGEST))).otherwise(USUAL))
    return F.when(F.col("etype") == "restaurant", MEAL).otherwise(sight).cast("long")


PLACED = "array<struct<start:bigint,end:bigint,cid:string,etype:string,price:double>>"


def item() -> Column:
    """A candidate as what planning asks of it; opening hours bind attractions alone."""
    bare = lambda h: F.struct(F.col("cid").alias("cid"), F.col("etype").alias("etype"), F.col("price").cast("double").alias("price"), needed().alias("need"), h["x"]["start"].cast("long").alias("o"), h["x"]["end"].cast("long").alias("c"))
    return text.let(F.struct(F.when(F.col("etype") == "attraction", text.opening_hours(F.col("opening"))).alias("x")), bare)


def clock(acts: Column, gone: Column, open_: Column, close: Column) -> Column:
    """Activities of a day in order at their times, an array of PLACED: one after another with a gap, within the window and opening hours.

    Those that do not fit, that the day has already or that are `gone` are left out; a day of under
    45 minutes takes none.
    """
    zero = F.struct(open_.alias("now"), F.array().cast(PLACED).alias("out"))

    def step(s, x):
        def at(span):
            start, end = span["start"], span["start"] + x["need"]
            free = ~F.array_contains(gone, x["cid"]) & ~F.exists(s["out"], lambda y: y["cid"] == x["cid"])
            fits = free & (end <= close) & (x["c"].isNull() | (end <= x["c"])) & (close - open_ >= 45)
            grown = F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["cid"].alias("cid"), x["etype"].alias("etype"), x["price"].alias("price"))))
            return F.when(fits, F.struct(F.least(close, end + GAP).alias("now"), grown.alias("out"))).otherwise(s)

        return text.let(F.struct(F.greatest(s["now"], F.coalesce(x["o"], s["now"])).alias("start")), at)

    return F.aggregate(acts, zero, step, lambda s: s["out"])


def schedule(items: DataFrame, windows: DataFrame) -> DataFrame:
    """Times for ordered activities of a day, in the JVM: `(pid, plan_day, seq, cid, start, end)`; a day's length bounds its array.

    items: pid, plan_day, seq, cid, etype, price, opening, duration.
    """
    days = items.groupBy("pid", "plan_day").agg(F.sort_array(F.collect_list(F.struct("seq", "cid", item().alias("x")))).alias("acts")).join(windows, ["pid", "plan_day"])
    done = days.select("pid", "plan_day", clock(F.transform("acts", lambda x: x["x"]), F.array().cast("array<string>"), F.col("open"), F.col("close")).alias("out"))
    return done.select("pid", "plan_day", F.posexplode("out").alias("at", "x")).select("pid", "plan_day", (F.col("at") + 1).cast("long").alias("seq"), F.col("x.cid").alias("cid"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))


class _Day:
    """The clock of one day: places items one after another within its window."""

    def __init__(self, window: dict, used: set[str]):
        self.now, self.close, self.used, self.rows = window["open"], window["close"], used, []
        self.usable = window["close"] - window["open"] >= 45

    def span(self, item: dict) -> tuple[int, int] | None:
        start = self.now
        if item["etype"] == "attraction" and item["o"] == item["o"] and item["o"] is not None:
            start = max(start, item["o"])
            if start + item["need"] > item["c"]:
                return None
        return (start, start + item["need"]) if start + item["need"] <= self.close else None

    def put(self, item: dict | None) -> bool:
        at = self.span(item) if item and self.usable and item["cid"] not in self.used else None
        if at is None:
            return False
        self.rows.append((*at, item))
        self.now = min(self.close, at[1] + GAP)
        self.used.add(item["cid"])
        return True


def _frame(pid: int, days: dict[int, list]) -> pd.DataFrame:
    rows = [(pid, d, k, s, e, "dining" if x["etype"] == "restaurant" else "sightseeing", x["cid"], x["price"]) for d, acts in sorted(days.items()) for k, (s, e, x) in enumerate(acts, 1)]
    return pd.DataFrame(rows, columns=["pid", "plan_day", "seq", "start", "end", "action", "cid", "price"])


def _unused(pool: Column, used: Column, at: Column) -> Column:
    """The first candidate that is not used, from place `at` of the pool on and around; null if there is none."""
    n = F.size(pool)
    turn = F.when(n > 0, at % n).otherwise(0)
    around = F.concat(F.slice(pool, turn + 1, n), F.slice(pool, F.lit(1), turn))
    return F.get(F.filter(around, lambda x: ~F.array_contains(used, x["cid"])), F.lit(0))


def _else(pool: Column, used: Column, at: Column) -> Column:
    """The first that is not used, or what stands at place `at`, around."""
    return F.coalesce(_unused(pool, used, F.lit(0)), F.get(pool, F.when(F.size(pool) > 0, (at % F.size(pool)).cast("int"))))


def _ids(items: Column) -> Column:
    return F.transform(items, lambda x: x["cid"])


def fallback_day(sights: Column, meals: Column, used: Column, day: Column, most: Column) -> Column:
    """What fills an empty day: a sight, a meal and another sight, as many as the day takes, unused ones first."""
    none = F.size(sights) == 0

    def with_first(a):
        taken = F.when(a.isNull(), used).otherwise(F.array_append(used, a["cid"]))

        def with_meal(m):
            both = F.when(m["x"].isNull(), m["used"]).otherwise(F.array_append(m["used"], m["x"]["cid"]))
            held = F.when(a.isNull(), 0).otherwise(1) + F.when(m["x"].isNull(), 0).otherwise(1)
            last = F.when(~none & (held < most), _else(sights, both, day))
            return F.array_compact(F.array(a, m["x"], last))

        return text.let(F.struct(F.when(F.when(a.isNull(), 0).otherwise(1) < most, _else(meals, taken, day - 1)).alias("x"), taken.alias("used")), with_meal)

    filled = text.let(F.struct(_else(sights, used, day - 1).alias("a")), lambda s: with_first(s["a"]))
    return F.when(most > 0, filled).otherwise(F.array().cast(ITEMS))


ITEMS = "array<struct<cid:string,etype:string,price:double,need:bigint,o:bigint,c:bigint>>"
_TOKENS = "struct<used:array<string>,today:array<string>,a:int,r:int,acts:" + ITEMS + ">"


def _filled(tokens: Column, picks: Column, sights: Column, meals: Column, used: Column, a: Column, r: Column) -> Column:
    """A day's activities by its tokens, a struct of _TOKENS: suggested picks first, then the next of the pool that the trip lacks, then that the day lacks."""
    zero = F.struct(used.alias("used"), F.array().cast("array<string>").alias("today"), a.alias("a"), r.alias("r"), F.array().cast(ITEMS).alias("acts"))

    def step(s, kind):
        sight = kind == "attraction"
        pool, at = F.when(sight, sights).otherwise(meals), F.when(sight, s["a"]).otherwise(s["r"])
        pick = F.get(F.filter(picks, lambda x: (x["etype"] == kind) & ~F.array_contains(s["used"], x["cid"])), F.lit(0))
        found = F.coalesce(pick, _unused(pool, s["used"], at), _unused(pool, s["today"], at))
        taken = lambda x: F.struct(F.array_append(s["used"], x["cid"]).alias("used"), F.array_append(s["today"], x["cid"]).alias("today"), F.when(sight, s["a"] + 1).otherwise(s["a"]).alias("a"), F.when(sight, s["r"]).otherwise(s["r"] + 1).alias("r"), F.array_append(s["acts"], x).alias("acts"))
        return F.when(kind.isin("attraction", "restaurant"), text.let(F.struct(found.alias("x")), lambda f: F.when(f["x"].isNull(), s).otherwise(taken(f["x"])).cast(_TOKENS))).otherwise(s)

    return F.aggregate(tokens, zero.cast(_TOKENS), step)


_TRIP = f"struct<used:array<string>,trip:array<string>,a:int,r:int,out:array<struct<plan_day:bigint,acts:{PLACED}>>>"


def build(chosen: DataFrame, windows: DataFrame, slots: DataFrame, suggestions: DataFrame | None = None, pool: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """Plans from chosen items in order (`position`), windows, `slots(days, day, slot, token)` and suggested picks for days.

    A request is one row, whose arrays its days and shortlist bound, folded day after day in the
    JVM. A day is filled by its tokens or, where `given(pid, plan_day, seq, cid)` has any row of the
    request (be its cid null), by what that has for the day; one that stays empty gets `fallback_day`, and so does one on
    which nothing fits, from what the trip has not visited. `pool`, sandboxes, stands in by price
    where nothing of a type was chosen.
    """
    bare = F.struct("position", item().alias("x"))
    asked = chosen.groupBy("pid").agg(F.sort_array(F.collect_list(bare)).alias("items"), F.first("day").cast("int").alias("day"))
    tokens = slots.groupBy("days", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "token"))), lambda x: x["token"]).alias("tokens"))
    tokens = tokens.groupBy("days").agg(F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("long"), "tokens"))).alias("tokens"))
    days = windows.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("plan_day", "open", "close", "most"))).alias("windows"))
    rows = days.join(asked, "pid", "left" if pool is not None else "inner").join(tokens, F.col("day") == F.col("days"), "left").drop("days")
    none = lambda kind: F.lit(None).cast(kind)
    if pool is not None:
        all_ = price_index(pool).groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("etype", "cheap", item().alias("x")))).alias("all"))
        rows = rows.join(all_, "pid", "left").withColumn("all", F.transform("all", lambda x: x["x"]))
    else:
        rows = rows.withColumn("all", none(ITEMS))
    if suggestions is not None:
        rows = rows.join(suggestions.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("plan_day", "picks"))).alias("picks")), "pid", "left")
    else:
        rows = rows.withColumn("picks", none("map<bigint,array<string>>"))
    if given is not None:
        known = given.join((pool if pool is not None else chosen).select("pid", "cid", item().alias("x")).dropDuplicates(["pid", "cid"]), ["pid", "cid"])
        known = known.groupBy("pid", "plan_day").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "cid", "x"))), lambda x: x["x"]).alias("acts"))
        known = known.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("plan_day", "acts"))).alias("given"))
        rows = rows.join(given.select("pid", F.lit(True).alias("_said")).distinct(), "pid", "left").join(known, "pid", "left")
        rows = rows.withColumn("given", F.when(F.col("_said"), F.coalesce("given", F.create_map().cast(f"map<bigint,{ITEMS}>")))).drop("_said")
    else:
        rows = rows.withColumn("given", none(f"map<bigint,{ITEMS}>"))
    empty, no_ids = F.array().cast(ITEMS), F.array().cast("array<string>")
    rows = rows.withColumn("items", F.coalesce(F.transform("items", lambda x: x["x"]), empty)).withColumn("all", F.coalesce("all", empty)).withColumn("day", F.coalesce(F.col("day"), F.size("windows")))
    of = lambda items, kind: F.filter(items, lambda x: x["etype"] == kind)
    for kind, name in (("attraction", "sights"), ("restaurant", "meals")):
        rows = rows.withColumn(f"own_{name}", of(F.col("items"), kind)).withColumn(f"all_{name}", of(F.col("all"), kind))
        stand_in = F.when(F.col("given").isNull(), F.slice(F.col(f"all_{name}"), F.lit(1), F.greatest(F.lit(2), F.col("day")))).otherwise(empty)
        rows = rows.withColumn(name, F.when(F.size(f"own_{name}") > 0, F.col(f"own_{name}")).otherwise(stand_in))
        rows = rows.withColumn(f"last_{name}", F.when(F.size(f"own_{name}") > 0, F.col(f"own_{name}")).otherwise(F.col(f"all_{name}")))
    zero = F.struct(no_ids.alias("used"), no_ids.alias("trip"), F.lit(0).alias("a"), F.lit(0).alias("r"), F.array().cast(f"array<struct<plan_day:bigint,acts:{PLACED}>>").alias("out")).cast(_TRIP)
    kinds = lambda t: F.transform(t, lambda x: F.when(x.endswith(":sightseeing"), "attraction").when(x.endswith(":dining"), "restaurant").otherwise("-"))
    both = F.col("items") if pool is None else F.concat("items", "all")

    def one(s, w):
        d, most = w["plan_day"], w["most"].cast("int")
        own = F.slice(F.coalesce(F.try_element_at(F.col("given"), d), empty), F.lit(1), most)
        asked_ = F.coalesce(F.try_element_at(F.col("picks"), d), no_ids)
        picks = F.array_compact(F.transform(asked_, lambda c: F.get(F.filter(both, lambda x: x["cid"] == c), F.lit(0))))
        by_tokens = _filled(F.slice(kinds(F.coalesce(F.try_element_at(F.col("tokens"), d), no_ids)), F.lit(1), most), picks, F.col("sights"), F.col("meals"), s["used"], s["a"], s["r"])
        by_model = F.struct(F.array_union(s["used"], _ids(own)).alias("used"), no_ids.alias("today"), s["a"].alias("a"), s["r"].alias("r"), own.alias("acts")).cast(_TOKENS)

        def placed(f):
            acts = F.when(F.size(f["acts"]) > 0, f["acts"]).otherwise(fallback_day(F.col("sights"), F.col("meals"), f["used"], d.cast("int"), most))

            def timed(g):
                first = clock(F.slice(g["acts"], F.lit(1), most), s["trip"], w["open"], w["close"])
                again = clock(fallback_day(F.col("last_sights"), F.col("last_meals"), s["trip"], d.cast("int"), most), s["trip"], w["open"], w["close"])
                on = lambda out: F.struct(F.array_union(f["used"], _ids(g["acts"])).alias("used"), F.concat(s["trip"], _ids(out["x"])).alias("trip"), f["a"].alias("a"), f["r"].alias("r"), F.array_append(s["out"], F.struct(d.alias("plan_day"), out["x"].alias("acts"))).alias("out"))
                return text.let(F.struct(text.let(F.struct(first.alias("x")), lambda x: F.when(F.size(x["x"]) > 0, x["x"]).otherwise(again)).alias("x")), on)

            return text.let(F.struct(acts.alias("acts")), timed)

        return F.when(most > 0, text.let(F.when(F.col("given").isNull(), by_tokens).otherwise(by_model), placed).cast(_TRIP)).otherwise(s)

    rows = cut(rows.select("pid", "windows", "tokens", "picks", "given", "items", "all", "sights", "meals", "last_sights", "last_meals"))
    done = rows.select("pid", F.explode(F.aggregate("windows", zero, one, lambda s: s["out"])).alias("x"))
    done = done.select("pid", F.col("x.plan_day").alias("plan_day"), F.posexplode("x.acts").alias("at", "y"))
    action = F.when(F.col("y.etype") == "restaurant", "dining").otherwise("sightseeing")
    return done.select("pid", "plan_day", (F.col("at") + 1).cast("long").alias("seq"), F.col("y.start").alias("start"), F.col("y.end").alias("end"), action.alias("action"), F.col("y.cid").alias("cid"), F.col("y.price").alias("price"))


def repair(plans: DataFrame, ranked: DataFrame, windows: DataFrame, totals: DataFrame) -> DataFrame:
    """One repair pass: meals out of range, repeats within a day, times, then prices, and times again.

    ranked: candidates with day, lo, hi, budget in order of `position`; totals: `(pid, fixed)`, what
    hotel and rides cost. A request is one row of arrays whose sizes its days and sandbox bound.
    """
    hours = text.opening_hours(F.col("opening"))
    item = F.struct("position", "cid", "etype", "price", needed().alias("need"), hours["start"].cast("long").alias("o"), hours["end"].cast("long").alias("c"))
    pool = ranked.groupBy("pid").agg(F.sort_array(F.collect_list(item)).alias("items"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("budget").alias("budget"))
    acts = plans.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("plan_day", "seq", "cid", "price", "action"))).alias("acts"))
    days = windows.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("plan_day", "open", "close", "most"))).alias("windows"))
    rows = acts.join(pool, "pid").join(days, "pid").join(totals, "pid", "left")

    def fix(row) -> pd.DataFrame:
        items = [dict(x) for x in row["items"]]
        by_id = {x["cid"]: x for x in items}
        pools = {t: [x for x in items if x["etype"] == t] for t in ("attraction", "restaurant")}
        kind = lambda a: "restaurant" if a["action"] == "dining" else "attraction"
        days: dict[int, list[dict | None]] = {w["plan_day"]: [] for w in map(dict, row["windows"])}
        lo, hi = row["lo"], row["hi"]
        fair = [x for x in pools["restaurant"] if lo == lo and lo is not None and lo <= x["price"] <= hi] or pools["restaurant"]
        turn = 0
        for a in map(dict, row["acts"]):
            x = by_id.get(a["cid"]) or {"cid": a["cid"], "etype": kind(a), "price": a["price"], "need": USUAL, "o": None, "c": None, "gone": True}
            if a["action"] == "dining" and lo is not None and lo == lo and not lo <= x["price"] <= hi and fair:
                x, turn = fair[turn % len(fair)], turn + 1
            days.setdefault(a["plan_day"], []).append(x)
        for acts in days.values():
            seen: set[str] = set()
            for i, x in enumerate(acts):
                if x["cid"] in seen:
                    acts[i] = next((y for y in pools[x["etype"]] if y["cid"] not in seen), x)
                seen.add(acts[i]["cid"])

        def timed(days):
            trip: set[str] = set()
            out = {}
            for w in map(dict, row["windows"]):
                day = _Day(w, set())
                for x in days.get(w["plan_day"], []):
                    if x.get("gone") or not day.put(x):
                        blocked = day.used | trip | {x["cid"]}
                        other = next((y for y in pools[x["etype"]] if y["cid"] not in blocked and day.span(y)), None)
                        day.put(other)
                trip |= day.used
                out[w["plan_day"]] = day.rows
            return out

        placed = timed(days)
        budget = row["budget"]
        if budget is not None and budget == budget and budget > 0:
            fixed = row["fixed"] if row["fixed"] is not None and row["fixed"] == row["fixed"] else 0.0
            cost = lambda: fixed + sum(x["price"] for acts in placed.values() for _, _, x in acts)
            for acts in placed.values():
                for i in sorted(range(len(acts)), key=lambda i: -acts[i][2]["price"]):
                    if cost() <= budget:
                        break
                    s, e, x = acts[i]
                    acts[i] = (s, e, next((y for y in pools[x["etype"]] if y["price"] < x["price"]), x))
            placed = timed({d: [x for _, _, x in acts] for d, acts in placed.items()})
        return _frame(row["pid"], placed)

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                yield fix(row)

    return rows.mapInPandas(run, SCHEMA)
