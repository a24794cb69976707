"""Mining of day patterns from reference itineraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.operators.graph import default_tokens

# A header is a whole line but for spaces at its ends.
HEADER = r"(?<![^\r\n]) *###[\s&&[^\r\n]]*([^|\r\n]+?)\|[\s&&[^\r\n]]*([^\r\n\x{85}\x{2028}\x{2029}]*[^ \r\n\x{85}\x{2028}\x{2029}]|[^\r\n\x{85}\x{2028}\x{2029}]+(?=[\x{85}\x{2028}\x{2029}] *(?![^\r\n]))) *[\x{85}\x{2028}\x{2029}]? *(?![^\r\n])"
KEPT, TOKENS = 8, 8


def day_tokens(body: Column, day: Column, days: Column) -> Column:
    """The slot:action tokens of one day's text, by start and then line; the default day where no line parses."""
    parts = lambda k: F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(HEADER), F.lit(k))

    def parsed(line, i):
        start = F.coalesce(text.parse_time_range(line["0"])["start"], F.lit(1440))
        return F.struct(start.alias("start"), i.alias("i"), text.classify_action(line["1"]).alias("action"))

    token = lambda x: F.concat_ws(":", text.time_to_slot(x["start"]), x["action"])
    found = F.transform(F.slice(F.sort_array(F.transform(F.arrays_zip(parts(1).alias("0"), parts(2).alias("1")), parsed)), 1, TOKENS), token)
    return text.let(found, lambda tokens: F.when(F.size(tokens) > 0, tokens).otherwise(default_tokens(day, days)))


def mine(itineraries: DataFrame) -> DataFrame:
    """`(day_count, rank, signature, support)`: the most frequent signatures of each trip length, ties by first appearance.

    itineraries: pid, day, final_plan (array of day texts), ord.
    """
    days = F.col("day").cast("int")
    signature = F.transform(F.sequence(F.lit(1), days), lambda d: day_tokens(F.get(F.col("final_plan"), d - 1), d, days))
    one = itineraries.where("day > 0 and size(final_plan) > 0").select(F.col("day").cast("long").alias("day_count"), signature.alias("signature"), "ord")
    counted = one.groupBy("day_count", "signature").agg(F.count("*").alias("support"), F.min("ord").alias("first"))
    rank = F.row_number().over(Window.partitionBy("day_count").orderBy(F.desc("support"), "first")).cast("long")
    return counted.withColumn("rank", rank).where(F.col("rank") <= KEPT).select("day_count", "rank", "signature", "support")
