"""Elements of large JSON files: an array of objects, or an object of objects, read in many tasks.

A file is cut at every closing brace and its byte ranges are read like lines. Whether a piece
begins inside a string follows from the quotes before it, and its depth from the brackets outside
of strings before it; both are running sums, taken within a byte range and carried from range to
range by a fold over a row a range. An element ends where the depth is one again. No task holds
more than its byte range, or more than the pieces of an element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfinder.functions.scratch import cut

_OPENING, _CLOSING = r"[^{\[]", r"[^}\]]"


def _depth(outside: Column) -> Column:
    return F.length(F.regexp_replace(outside, _OPENING, "")) - F.length(F.regexp_replace(outside, _CLOSING, ""))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """`(file, nth, text)`: the objects of each file's array, or the `"key": object` of its object, in order; other elements are not told apart from the object after them."""
    read = spark.read.option("lineSep", "}").text(path)
    read = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.concat("value", F.lit("}")).alias("text"))
    bare = F.split(F.regexp_replace("text", r"\\.", ""), '"')
    parts = read.withColumn("_p", bare).withColumn("quotes", (F.size("_p") - 1) % 2)
    side = lambda k: _depth(F.array_join(F.filter("_p", lambda x, i: i % 2 == k), ""))
    pieces = cut(parts.select("file", "block", "id", "text", "quotes", side(0).alias("d0"), side(1).alias("d1")))
    w = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    # as if the range began outside of a string, and as if inside
    begins = (F.sum("quotes").over(w) - F.col("quotes")) % 2
    both = pieces.withColumn("s", begins).withColumn("e0", F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1"))).withColumn("e1", F.when(F.col("s") == 0, F.col("d1")).otherwise(F.col("d0")))
    both = both.withColumn("r0", F.sum("e0").over(w)).withColumn("r1", F.sum("e1").over(w))
    both = cut(both.select("file", "block", "id", "text", "quotes", "s", "r0", "r1"))
    ranges = both.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("q"), F.max_by("r0", "id").alias("r0"), F.max_by("r1", "id").alias("r1"))
    starts = _fold(ranges, ["inside", "depth"], lambda s, x: ((s["inside"] + x["q"]) % 2, s["depth"] + F.when(s["inside"] == 0, x["r0"]).otherwise(x["r1"])), ["q", "r0", "r1"])
    at = both.join(starts, ["file", "block"])
    depth = F.col("depth") + F.when(F.col("inside") == 0, F.col("r0")).otherwise(F.col("r1"))
    ends = (depth == 1) & ((F.col("inside") + F.col("s") + F.col("quotes")) % 2 == 0)
    at = at.select("file", "block", "id", "text", ends.cast("long").alias("end"))
    at = cut(at.withColumn("n", F.sum("end").over(w) - F.col("end")))
    counts = at.groupBy("file", "block").agg(F.sum("end").alias("ends"))
    before = _fold(counts, ["before"], lambda s, x: (s["before"] + x["ends"],), ["ends"])
    one = at.join(before, ["file", "block"]).groupBy("file", (F.col("n") + F.col("before")).alias("nth"))
    one = one.agg(F.max("end").alias("whole"), F.sort_array(F.collect_list(F.struct("block", "id", "text"))).alias("x")).where("whole = 1")
    joined = F.array_join(F.transform("x", lambda x: x["text"]), "")
    begin = F.when(F.col("nth") == 0, F.regexp_replace(joined, r"^\s*[\[{]\s*", "")).otherwise(F.regexp_replace(joined, r"^[\s,]+", ""))
    return one.select("file", "nth", begin.alias("text"))


def _fold(ranges: DataFrame, state: list[str], step, columns: list[str]) -> DataFrame:
    """`(file, block, *state)`: what a fold of whole numbers over the ranges of a file says before each; a file is a list of a few numbers a range."""
    kind = f"struct<{','.join(f'{c}:bigint' for c in state)}>"
    rows = ranges.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("all"))
    zero = F.struct(F.struct(*(F.lit(0).alias(c) for c in state)).cast(kind).alias("now"), F.array().cast(f"array<struct<block:bigint,start:{kind}>>").alias("out"))
    grown = lambda s, x: F.struct(F.struct(*(v.alias(c) for c, v in zip(state, step(s["now"], x), strict=True))).cast(kind).alias("now"), F.array_append(s["out"], F.struct(x["block"].alias("block"), s["now"].alias("start"))).alias("out"))
    found = rows.select("file", F.explode(F.aggregate("all", zero, grown, lambda s: s["out"])).alias("x"))
    return found.select("file", "x.block", "x.start.*")
