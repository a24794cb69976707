"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word target by weight. Whole epochs of a source come first; what is left of
its target is filled with documents in the order of exponential keys -ln(u) / weight, with u
drawn from the MD5 of the id, until the prefix sum of sizes meets the budget. The document that
crosses the budget is taken in part, so a source's taken words equal its target rounded down.

A source may hold any share of the rows: keys are cut into monotone bins, the bins' sums find the
one bin in which a source's budget ends, and only that bin's rows are put in order. That gives one
cut-off for each source, and each row is then decided by itself.

Nulls: a null text has no words, a null source is a source of its own that sorts last, a null or
non-positive weight counts as 1, a null id draws as the empty string. Rows with equal key, id and
size share alike what is left at the cut-off. Empty tables give empty results; a source without
words has target 0. Other columns are kept and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch
from wayfinder.llm._shared import words

#: Weights of the sources in order, repeating; the targets' share of all sizes; most epochs.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MOST = 150, 2
#: Rows that a bin should hold; a source of any size has bins of about so many.
BIN_ROWS = 2000
#: A table with a row for each source is broadcast up to so many rows (under 20 MB), else joined with a shuffle.
BROADCAST_SOURCES = 100_000
#: Weights up to so many rows (16 bytes each) are broadcast to the texts; beyond, both are shuffled.
BROADCAST_WEIGHTS = 400_000


def uniform(key: Column) -> Column:
    """A double in (0, 1) from the MD5 of a key as text (null: empty), the same in every run."""
    head = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(4503599627370496.0)


def draw(id_: Column, weight: Column) -> Column:
    return -F.ln(uniform(id_)) / F.when(weight > 0, weight.cast("double")).otherwise(F.lit(1.0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """`sizes(source, source_size, n_docs)` with `target`: shares by weight, each at most MOST times its size.

    Water-filling in closed form: in the order of capacity per weight, sources are full up to the
    first whose share of what remains lies below its capacity; from there on the rest is shared by
    weight. One row for each source, so the windows see only the number of sources.
    """
    cycle = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    one = sizes.withColumn("_rank", rank).withColumn("_w", F.element_at(cycle, (F.col("_rank") - 1) % len(WEIGHTS) + 1))
    one = one.withColumn("_cap", F.col("source_size").cast("double") * MOST)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy()).cast("double") * SHARE_PERCENT / 100
    one = one.withColumn("_level", (whole - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    one = one.withColumn("_at", F.row_number().over(order))
    first = F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct("_at", "_level"))).over(Window.partitionBy())
    share = F.coalesce(first["_level"] * F.col("_w"), F.col("_cap"))
    return one.select("source", "source_size", "n_docs", F.least(F.col("_cap"), share).alias("target"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def rank(slim: DataFrame) -> Column:
    return F.struct(slim["key"], F.coalesce(slim["id"].cast("string"), F.lit("")).alias("id"), slim["size"])


def cutoffs(slim: DataFrame, scratch: Scratch) -> DataFrame:
    """From `slim(id, source, size, key)`, for each source: `name, source_size, target, epochs, cut, part`.

    A row whose (key, id, size) lies below `cut` is in the last epoch as a whole; at `cut`, `part` words of it are.
    """
    sums = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    sums = sums.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    sums = sums.withColumn("budget", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    sums = scratch.cut(sums.withColumn("bins", F.ceil(F.col("n_docs") / F.lit(BIN_ROWS))).withColumn("name", name(F.col("source"))).drop("source", "n_docs"), "sources")
    placed = slim.withColumn("name", name(F.col("source"))).join(_small(sums), "name")
    placed = placed.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * F.col("bins")))
    bins = placed.groupBy("name", "bin").agg(F.sum("size").alias("held"), F.first("budget").alias("budget"))
    bins = bins.withColumn("before", F.sum("held").over(Window.partitionBy("name").orderBy("bin")) - F.col("held"))
    ends = bins.where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("held") >= F.col("budget")))
    ends = scratch.cut(ends.groupBy("name").agg(F.min(F.struct("bin", "before")).alias("e")).select("name", "e.bin", "e.before"), "ends")
    near = placed.join(_small(ends), ["name", "bin"])
    near = near.groupBy("name", "budget", "before", rank(near).alias("cut")).agg(F.count("*").alias("m"))
    held = F.col("cut.size") * F.col("m")
    ahead = F.col("before") + F.sum(held).over(Window.partitionBy("name").orderBy("cut")) - held
    near = near.withColumn("ahead", ahead).where((F.col("ahead") < F.col("budget")) & (F.col("ahead") + held >= F.col("budget")))
    near = near.select("name", "cut", F.floor((F.col("budget") - F.col("ahead")) / F.col("m")).alias("part"))
    return scratch.cut(sums.select("name", "source_size", "target", "epochs").join(near, "name", "left"), "cutoffs")


def taken(slim: DataFrame, cuts: DataFrame) -> DataFrame:
    """`slim` with `source_size`, `target` and `taken`, its words in the mix; all rows stay."""
    at = rank(slim)
    both = slim.withColumn("name", name(slim["source"])).withColumn("_wf_rank", at).join(_small(cuts), "name")
    part = F.when(F.col("_wf_rank") < F.col("cut"), F.col("size")).when(F.col("_wf_rank") == F.col("cut"), F.col("part")).otherwise(F.lit(0))
    return both.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("name", "_wf_rank", "epochs", "cut", "part")


def quality_weights(labels: DataFrame) -> DataFrame:
    """`(id, weight)`: 2 for documents labelled good, 0.5 for those labelled bad; any other counts as 1."""
    one = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("q")).where("id is not null and q is not null").groupBy("id").agg(F.max("q").alias("q"))
    return one.select("id", F.when(F.col("q") > 0, F.lit(2.0)).otherwise(F.lit(0.5)).alias("weight"))


def plan_mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Rows `(id, source, size, key, source_size, target, taken)` for documents with doc_id, source and text."""
    scratch = Scratch(docs.sparkSession, "mix")
    slim = docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size"))
    slim = slim.withColumn("weight", F.lit(1.0)) if weights is None else slim.join(weights, "id", "left")
    slim = scratch.cut(slim.select("id", "source", "size", draw(F.col("id"), F.col("weight")).alias("key")), "sizes")
    return taken(slim, cutoffs(slim, scratch))


def mix(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken, all columns kept; `weights` as in `plan_mix`.

    A document taken in part comes once more if at least half of its words are taken. Documents
    without words are not in a mix. Rows are decided one by one against the sources' cut-offs, so
    texts are not shuffled unless more than BROADCAST_WEIGHTS weights are other than 1.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    other = None if weights is None else scratch.cut(weights.where("weight <> 1"), "weights")
    few = other is not None and other.count() <= BROADCAST_WEIGHTS

    def keyed(*more: Column) -> DataFrame:
        rows = docs.select(*more, F.col("doc_id").alias("id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
        rows = rows.withColumn("weight", F.lit(1.0)) if other is None else rows.join(F.broadcast(other) if few else other, "id", "left")
        return rows.withColumn("key", draw(F.col("id"), F.col("weight"))).drop("weight")

    slim = scratch.cut(keyed(), "sizes")
    cuts = cutoffs(slim, scratch)
    whole = keyed(F.struct(*docs.columns).alias("_wf_row"))
    times = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    found = taken(whole, cuts).where("size > 0").withColumn("_wf_times", times).where("_wf_times > 0")
    return found.select("_wf_row", F.explode(F.sequence(F.lit(1), F.col("_wf_times")))).select("_wf_row.*")
