"""Trip tables derived from the star schema: candidates, requests, sandboxes, transport, plans.

Every table is a DataFrame; keys are arithmetic on the schema's own keys, so a table is the same
in every run. Dimension tables are joined without hints: their sizes follow the scale, and the
optimizer broadcasts those it measures as small.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.functions.scratch import cut

TYPES = ["economy", "large", "medium", "promo", "small", "standard"]
CAPS = {"hotel": 4, "restaurant": 12, "attraction": 24}
RING = 1009


def _place(k: Column) -> list[Column]:
    j = F.floor(k / 25)
    return [(30 + (j * 37) % 400 / 1e3).alias("lat"), (120 + (j * 91) % 300 / 1e3).alias("lon")]


class World:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def cities(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("city_key"), F.col("n_name").alias("city"))

    @cached_property
    def candidates(self) -> DataFrame:
        """cid, etype, k, ord, city, name, price, lat, lon, tags, category, opening, duration, text."""
        part = self.table("part").withColumn("k", F.col("p_partkey").cast("long"))
        a = part.select(
            F.lit("attraction").alias("etype"), "k", F.col("k").alias("ord"), (F.col("k") % 25).alias("city_key"), F.col("p_name").alias("name"),
            ((F.col("k") * 17) % 400).cast("double").alias("price"),
            F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lower("p_brand"))).alias("tags"), F.lit(None).cast("string").alias("category"),
            F.when(F.col("p_size") % 11 != 0, F.format_string("08:00-%d:00", 16 + F.col("p_size") % 7)).alias("opening"),
            F.when(F.col("p_size") % 9 != 0, F.format_string("%d hours", 1 + F.col("p_size") % 4)).alias("duration"),
        )
        none = [F.lit(None).cast("string").alias(c) for c in ("opening", "duration")]
        supplier = self.table("supplier").withColumn("k", F.col("s_suppkey").cast("long"))
        level = F.element_at(F.array(*map(F.lit, ("Economy", "Midscale", "Luxury"))), (F.col("k") % 3 + 1).cast("int"))
        h = supplier.select(F.lit("hotel").alias("etype"), "k", (F.col("k") + 1_000_000_000).alias("ord"), F.col("s_nationkey").cast("long").alias("city_key"), F.col("s_name").alias("name"), (F.abs("s_acctbal") / 20).alias("price"), F.array(level).alias("tags"), level.alias("category"), *none)
        customer = self.table("customer").withColumn("k", F.col("c_custkey").cast("long"))
        r = customer.select(F.lit("restaurant").alias("etype"), "k", (F.col("k") + 2_000_000_000).alias("ord"), F.col("c_nationkey").cast("long").alias("city_key"), F.col("c_name").alias("name"), (F.abs("c_acctbal") / 50).alias("price"), F.array(F.lower("c_mktsegment")).alias("tags"), F.lit(None).cast("string").alias("category"), *none)
        all_ = a.unionByName(h).unionByName(r).join(self.cities, "city_key").drop("city_key")
        words = F.concat_ws(" ", "name", "etype", F.lit("in"), "city", F.array_join("tags", " "))
        return all_.select(F.concat("etype", F.lit(":"), F.col("k").cast("string")).alias("cid"), "etype", "k", "ord", "city", "name", "price", *_place(F.col("k")), "tags", "category", "opening", "duration", words.alias("text"))

    @cached_property
    def requests(self) -> DataFrame:
        """Raw requests: pid, departure, destination, day, text."""
        o = self.table("orders").where("o_orderkey % 50 = 0").withColumn("q", F.floor(F.col("o_orderkey") / 50))
        o = o.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        o = o.join(self.cities.withColumnRenamed("city", "departure"), F.col("c_nationkey") == F.col("city_key")).drop("city_key")
        o = o.join(self.cities.withColumnRenamed("city", "destination"), F.col("q") % 25 == F.col("city_key"))
        money = F.floor(F.col("o_totalprice") / 100).cast("string")
        v = F.col("q") % 5
        extra = (
            F.when(v == 0, F.concat(F.lit(" with a budget of $"), money, F.lit(", meal costs ranging from 20 to 90")))
            .when(v == 1, ", relaxed pace, meal cost over 60")
            .when(v == 2, F.concat(F.lit(" with a budget of $"), money, F.lit(" and a luxury stay")))
            .when(v == 3, ", moderate pace and a midscale hotel")
            .otherwise("")
        )
        day = (2 + F.col("q") % 6).cast("long")
        kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("q") % 6 + 1).cast("int"))
        body = F.concat(F.lit("Plan a trip from "), "departure", F.lit(" to "), "destination", F.lit(" for "), day.cast("string"), F.lit(" days"), extra, F.lit(", interested in "), kind, F.lit(", "), F.lower("c_mktsegment"), F.lit(" and parks along with rest."))
        return o.select(F.col("o_orderkey").cast("long").alias("pid"), "departure", "destination", day.alias("day"), body.alias("query"))

    @cached_property
    def specs(self) -> DataFrame:
        """Parsed requests: also budget, lo, hi, category_pref, intensity_pref, interests."""
        meal = text.parse_meal_range(F.col("query"))
        return self.requests.select("*", text.parse_budget(F.col("query")).alias("budget"), meal["lo"].alias("lo"), meal["hi"].alias("hi"), text.hotel_category(F.col("query")).alias("category_pref"), text.intensity(F.col("query")).alias("intensity_pref"), text.interest_tags(F.col("query")).alias("interests"))

    @cached_property
    def pool(self) -> DataFrame:
        """Sandboxes: specs joined with up to CAPS candidates of each type in the destination city.

        A request takes the candidates of a city in the order of (13 k + pid) modulo RING, then id:
        one circle for all requests, entered at a place that follows from the request. Of each
        step of the circle only the first few candidates can be taken, so what requests meet is a
        table of bounded size, by equal keys: city, type and place.
        """
        cap = F.when(F.col("etype") == "hotel", CAPS["hotel"]).when(F.col("etype") == "restaurant", CAPS["restaurant"]).otherwise(CAPS["attraction"])
        step = Window.partitionBy("city", "etype", "_step")
        ring = Window.partitionBy("city", "etype")
        c = self.candidates.withColumn("_step", (F.col("k") * 13) % RING)
        c = c.withColumn("_nth", F.row_number().over(step.orderBy("cid"))).where(F.col("_nth") <= cap).drop("_nth")
        c = c.withColumn("_at", F.row_number().over(ring.orderBy("_step", "cid")) - 1).withColumn("_all", F.count("*").over(ring))
        c = cut(c)
        firsts = c.groupBy("city", "etype", "_step").agg(F.min("_at").alias("_at"), F.first("_all").alias("_all"))
        firsts = firsts.withColumn("_before", F.coalesce(F.lag("_step").over(ring.orderBy("_step")), F.lit(-1)))
        enter = firsts.select("city", "etype", "_all", "_at", F.explode(F.sequence(F.col("_before") + 1, F.col("_step"))).alias("_enter"))
        late = firsts.groupBy("city", "etype").agg(F.max("_step").alias("_last"), F.first("_all").alias("_all")).where(F.col("_last") < RING - 1)
        enter = enter.unionByName(late.select("city", "etype", "_all", F.lit(0).alias("_at"), F.explode(F.sequence(F.col("_last") + 1, F.lit(RING - 1).cast("long"))).alias("_enter")))
        asked = self.specs.withColumn("_enter", (RING - F.col("pid") % RING) % RING)
        asked = asked.join(enter, (asked.destination == enter.city) & (asked._enter == enter._enter)).drop("_enter")
        asked = asked.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_all"), cap) - 1)))
        asked = asked.withColumn("_at", (F.col("_at") + F.col("_j")) % F.col("_all")).drop("_all", "_j")
        return asked.join(c.drop("_all", "_step"), ["city", "etype", "_at"]).drop("_at")

    @cached_property
    def sandbox(self) -> DataFrame:
        """`pool`, computed once for the operators that read it several times."""
        return cut(self.pool)

    @cached_property
    def truth(self) -> DataFrame:
        return self.sandbox.where((F.col("k") * 13 + F.col("pid")) % 7 == 0)

    @cached_property
    def transport(self) -> DataFrame:
        """mode, number, from_city, to_city, start, end (minutes), price, ord."""
        li = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        li = li.join(self.cities.withColumnRenamed("city", "from_city"), F.col("s_nationkey") == F.col("city_key")).drop("city_key")
        li = li.join(self.cities.withColumnRenamed("city", "to_city"), F.col("c_nationkey") == F.col("city_key")).drop("city_key")
        start = (F.col("l_partkey") * 7) % 1200
        return li.where("from_city <> to_city").select(
            F.when(F.col("l_returnflag") == "R", "flight").otherwise("train").alias("mode"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("number"),
            "from_city", "to_city", start.cast("long").alias("start"), (start + 60 + F.col("l_quantity").cast("long")).cast("long").alias("end"), (F.col("l_extendedprice") / 100).alias("price"),
        )

    @cached_property
    def plans(self) -> DataFrame:
        """Activities of one plan for each request: pid, plan_day, seq, start, end, action and the candidate."""
        p = self.sandbox.where((F.col("etype") != "hotel") & ((F.col("k") * 7 + F.col("pid")) % 3 == 0))
        start = 540 + ((F.col("k") * 37 + F.col("pid")) % 10) * 70
        p = p.withColumn("plan_day", 1 + (F.col("k") + F.col("pid")) % F.col("day")).withColumn("start", start).withColumn("end", start + 60 + (F.col("k") % 3) * 45)
        w = Window.partitionBy("pid", "plan_day").orderBy("start", "cid")
        return cut(p.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("action", F.when(F.col("etype") == "restaurant", "dining").otherwise("sightseeing")))
