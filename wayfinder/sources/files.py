"""Readers of the trip files: requests, itineraries, sandbox information, schedules, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.sources.elements import elements

REQUEST = "pid long, query string, departure_city string, destination_city string, day int, budget double, meal_price_range array<double>, final_plan_json string"
ITINERARY = "pid long, day int, final_plan array<string>"
RIDE = "Train_Number string, Departure_Time string, Arrival_Time string, Second_Class_Price double, `Flight Number` string, Flight_Number string, `Departure Time` string, `Arrival Time` string, Price double"
BLOCK = f"struct<train_options: array<struct<{RIDE.replace(' string', ': string').replace(' double', ': double')}>>, flight_options: array<struct<{RIDE.replace(' string', ': string').replace(' double', ': double')}>>>"


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a JSON array, in many tasks, with `nth`, their place in their file."""
    return elements(spark, path).select(F.from_json("text", schema).alias("x"), "nth").select("x.*", "nth")


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation requests: a JSON array. Fields win over what the text says."""
    raw = objects(spark, path, REQUEST)
    q = F.col("query")
    meal = text.parse_meal_range(q)
    pair = F.size("meal_price_range") == 2
    return raw.select(
        "pid", F.trim("departure_city").alias("departure"), F.trim("destination_city").alias("destination"), F.greatest(F.lit(1), F.coalesce("day", F.lit(1))).cast("long").alias("day"), q,
        F.coalesce("budget", text.parse_budget(q)).alias("budget"),
        F.when(pair, F.get("meal_price_range", F.lit(0))).otherwise(meal["lo"]).alias("lo"), F.when(pair, F.get("meal_price_range", F.lit(1))).otherwise(meal["hi"]).alias("hi"),
        text.hotel_category(q).alias("category_pref"), text.intensity(q).alias("intensity_pref"), text.interest_tags(q).alias("interests"), "final_plan_json",
    )


def itineraries(spark: SparkSession, path: str) -> DataFrame:
    return objects(spark, path, ITINERARY).withColumnRenamed("nth", "ord")


def keyed_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """`(pid, info)` from one JSON object keyed by pid; `value` is the DDL type of its values."""
    one = F.concat(F.lit("{"), "text", F.lit("}"))
    return elements(spark, path).select(F.explode(F.from_json(one, f"map<string,{value}>")).alias("pid", "info")).withColumn("pid", F.col("pid").try_cast("long"))


def _any(x: Column, *names: str) -> Column:
    return F.coalesce(*(x.getItem(n) for n in names))


def candidates(info: DataFrame) -> DataFrame:
    """Candidates from `(pid, city, info)` where info holds arrays of string maps for hotel, attractions and restaurants."""
    def rows(kind: str, field: str):
        return info.select("pid", "city", F.posexplode(F.col("info")[field]).alias("ord", "x")).withColumn("etype", F.lit(kind))

    x, city = F.col("x"), F.col("city")
    named = lambda kind, name: F.concat_ws(":", F.lit(kind), text.slugify(city), text.slugify(name))
    tags = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    place = [text.safe_float(x["latitude"], float("nan")).alias("lat"), text.safe_float(x["longitude"], float("nan")).alias("lon")]
    place = [F.when(~F.isnan(c), c).alias(n) for c, n in zip(place, ("lat", "lon"), strict=True)]
    none = F.lit(None).cast("string")
    hotel_name, food_name = _any(x, "Hotel Name", "name"), _any(x, "name_en", "name")
    h = rows("hotel", "hotel").select("pid", "city", "ord", "etype", named("hotel", hotel_name).alias("cid"), hotel_name.alias("name"), text.safe_float(x["Average Price"]).alias("price"), *place, F.array_compact(F.array(x["Category"])).alias("tags"), x["Category"].alias("category"), none.alias("opening"), none.alias("duration"))
    a = rows("attraction", "attractions").select("pid", "city", "ord", "etype", F.concat(F.lit("attraction:"), _any(x, "poiid", "poiId")).alias("cid"), food_name.alias("name"), text.safe_float(x["price"]).alias("price"), *place, tags(x["tag"]).alias("tags"), none.alias("category"), x["opening_hours"].alias("opening"), x["recommended_duration"].alias("duration"))
    r = rows("restaurant", "restaurants").select("pid", "city", "ord", "etype", named("restaurant", food_name).alias("cid"), food_name.alias("name"), text.safe_float(_any(x, "price", "avg_price")).alias("price"), *place, tags(_any(x, "tag", "small_cate")).alias("tags"), none.alias("category"), none.alias("opening"), none.alias("duration"))
    all_ = h.unionByName(a).unionByName(r)
    return all_.withColumn("text", F.concat_ws(" ", "name", "etype", F.lit("in"), "city", F.array_join("tags", " ")))


def flights(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    minutes = lambda c: text.time_to_minutes(F.col(c)).cast("long")
    start, end = minutes("Departure Time"), minutes("Arrival Time")
    return raw.select(F.lit("flight").alias("mode"), F.col("Flight Number").alias("number"), F.col("Departure City").alias("from_city"), F.col("Arrival City").alias("to_city"), start.alias("start"), F.when(end < start, end + 1440).otherwise(end).alias("end"), text.safe_float(F.col("Price")).alias("price"))


def first_and_last(stops: DataFrame) -> DataFrame:
    """Trains of `stops(number, station_number, station, departure, arrival, price)` from first to last stop, of two stops at least."""
    at = F.struct("station_number", "ord")
    t = stops.groupBy("number").agg(F.count("*").alias("n"), F.min_by(F.struct("station", "departure"), at).alias("a"), F.max_by(F.struct("station", "arrival", "price"), F.struct("station_number", -F.col("ord"))).alias("b"))
    city = lambda c: F.try_element_at(F.split(F.trim(c), r"\s+"), F.lit(1))
    return t.where("n >= 2").select(F.lit("train").alias("mode"), "number", city(F.col("a.station")).alias("from_city"), city(F.col("b.station")).alias("to_city"), F.col("a.departure").alias("departure"), F.col("b.arrival").alias("arrival"), F.col("b.price").alias("price"), F.col("n").alias("stops"))


def trains(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path).withColumn("ord", F.monotonically_increasing_id())
    return first_and_last(raw.select(F.col("Train_Number").alias("number"), text.safe_int(F.col("Station_Number")).alias("station_number"), F.col("Station_Name").alias("station"), F.col("Departure_Time").alias("departure"), F.col("Arrival_Time").alias("arrival"), text.safe_float(F.col("Second_Class_Price")).alias("price"), "ord"))


def timed(trains_: DataFrame) -> DataFrame:
    """Trains with minutes `start` and `end`, an arrival before its departure being the next day's."""
    start, end = (text.time_to_minutes(F.col(c)).cast("long") for c in ("departure", "arrival"))
    return trains_.withColumn("start", start).withColumn("end", F.when(end < start, end + 1440).otherwise(end))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a settings sweep: a CSV whose numbers and booleans are typed by column."""
    raw = spark.read.option("header", True).csv(path)
    yes = lambda c: F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on")
    whole, words = {"hops", "topk_vector", "topk_final", "n", "run_index", "run_total"}, {"run_id", "output_dir"}
    kind = lambda c: F.col(c) if c in words or c.startswith("llm_") else yes(F.col(c)) if c.startswith("use_") else text.safe_int(F.col(c)) if c in whole else F.col(c).try_cast("double")
    return raw.select(*(kind(c).alias(c) for c in raw.columns))


def finished(spark: SparkSession, path: str) -> DataFrame:
    """`(pid, method)` of predictions written before."""
    return spark.read.schema("pid long, method string").json(path).where("pid is not null").distinct()
