"""All files of a trip data set as the tables that runs read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.functions.scratch import cut
from wayfinder.operators import graph, metrics, patterns, sinks
from wayfinder.operators import retrieval as R
from wayfinder.operators.methods import Bundle
from wayfinder.sources import files

_PARTS = "array<map<string,string>>"
INFO = f"struct<hotel:{_PARTS},attractions:{_PARTS},restaurants:{_PARTS},transport_otd:{files.BLOCK},transport_dto:{files.BLOCK}>"
#: Candidates of a sandbox stand in the order of their kinds, then of their lists.
KINDS = {"hotel": 0, "attraction": 1, "restaurant": 2}
STEP = 10_000_000


def offers(info: DataFrame, specs: DataFrame) -> DataFrame:
    """Rides that sandboxes offer, as `files.flights` has them; times are minutes, an arrival before its departure is the next day's."""
    both = info.join(specs.select("pid", "departure", "destination"), "pid")
    x = F.col("x")
    blocks = []
    for field, a, b in (("transport_otd", "departure", "destination"), ("transport_dto", "destination", "departure")):
        for mode, options in (("train", "train_options"), ("flight", "flight_options")):
            blocks.append(both.select(F.lit(mode).alias("mode"), F.col(a).alias("from_city"), F.col(b).alias("to_city"), F.explode(F.col(f"info.{field}.{options}")).alias("x")))
    rows = blocks[0]
    for block in blocks[1:]:
        rows = rows.unionByName(block)
    either = lambda *names: F.coalesce(*(x[n] for n in names))
    start, end = (text.time_to_minutes(either(*n)).cast("long") for n in (("Departure_Time", "Departure Time"), ("Arrival_Time", "Arrival Time")))
    rows = rows.select("mode", either("Train_Number", "Flight Number", "Flight_Number").alias("number"), "from_city", "to_city", start.alias("start"), F.when(end < start, end + 1440).otherwise(end).alias("end"), F.coalesce(either("Second_Class_Price", "Price"), F.lit(0.0)).alias("price"))
    return rows.where("number is not null").distinct()


def reference(requests: DataFrame) -> DataFrame:
    """`(pid, plan_day, seq, name)` of the hotels and activities that reference plans name; a hotel has no day."""
    schema = "hotel array<struct<name:string>>, itinerary map<string,array<struct<location:string>>>"
    p = requests.select("pid", F.from_json("final_plan_json", schema).alias("p"))
    beds = p.select("pid", F.explode("p.hotel.name").alias("name")).select("pid", F.lit(None).cast("long").alias("plan_day"), F.lit(0).cast("long").alias("seq"), "name")
    days = p.select("pid", F.explode("p.itinerary").alias("d", "acts")).select("pid", F.regexp_extract("d", r"(\d+)", 1).try_cast("long").alias("plan_day"), F.posexplode("acts.location").alias("seq", "name"))
    return beds.unionByName(days.withColumn("seq", F.col("seq").cast("long")))


def truth(requests: DataFrame, pool: DataFrame) -> DataFrame:
    """`(pid, cid, plan_day, seq, lat, lon)`: the candidates that reference plans name, at each place that names them."""
    said = reference(requests).withColumn("said", text.normalize(F.col("name")))
    own = pool.select("pid", "cid", "ord", "lat", "lon", text.normalize(F.col("name")).alias("n")).where("n <> ''")
    near = said.where("said <> ''").join(own, "pid").where(F.col("n").contains(F.col("said")) | F.col("said").contains(F.col("n")))
    at = F.struct("ord", "cid", "lat", "lon")
    best = near.groupBy("pid", "plan_day", "seq", "said").agg(F.max(F.when(F.col("n") == F.col("said"), at)).alias("same"), F.min(at).alias("first"))
    return best.select("pid", "plan_day", "seq", F.coalesce("same", "first").alias("x")).select("pid", "plan_day", "seq", "x.cid", "x.lat", "x.lon")


def load(spark: SparkSession, folder: str, requests: str = "test.json", itineraries: str = "train.json", info: str = "infomation.json", flights: str = "Flight_Schedule.csv", trains: str = "Train_Schedule.csv") -> Bundle:
    """The bundle of a folder. Patterns are mined from the itineraries, the graph is built over all sandboxes."""
    asked = cut(files.requests(spark, f"{folder}/{requests}"))
    specs = asked.drop("final_plan_json")
    boxes = cut(files.keyed_object(spark, f"{folder}/{info}", INFO).join(specs.select("pid", F.col("destination").alias("city")), "pid"))
    own = files.candidates(boxes)
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    own = own.withColumn("ord", F.element_at(kind, F.col("etype")) * STEP + F.col("ord")).withColumn("k", F.col("ord"))
    own = cut(R.keep_first(own, ["pid", "cid"], ["ord"]))
    pool = cut(specs.join(own, "pid"))
    candidates = R.keep_first(own, ["cid"], ["pid", "ord"]).drop("pid")
    rides = offers(boxes, specs)
    for name, read in ((flights, files.flights), (trains, lambda s, p: files.timed(files.trains(s, p)))):
        if sinks.exists(spark, f"{folder}/{name}"):
            rides = rides.unionByName(read(spark, f"{folder}/{name}").select(*rides.columns))
    mined = patterns.mine(files.itineraries(spark, f"{folder}/{itineraries}"))
    transport = cut(rides.distinct())
    _, edges = graph.build(candidates, specs, transport, mined)
    return Bundle(specs, pool, candidates, transport, cut(truth(asked, pool)), cut(edges), graph.skeletons(spark, mined))


def truth_ids(requests: DataFrame, pool: DataFrame) -> DataFrame:
    return metrics.truth_ids(reference(requests), pool)
