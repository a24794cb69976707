"""TF-IDF search: log term frequency, smoothed inverse document frequency, cosine on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.functions import text
from wayfinder.functions.scratch import cut

#: Terms of queries are broadcast up to so many rows; postings of a term that one task should hold.
BROADCAST_TERMS, PART = 200_000, 100_000
#: Bytes of text whose terms one task holds; the most frequent terms, whose weights are broadcast.
PART_BYTES, COMMON = 1 << 22, 10_000


def parts(rows: DataFrame, body: Column) -> int:
    """Into how many parts texts are dealt, so that a task's share does not grow with them."""
    size = rows.agg(F.sum(F.octet_length(body)).alias("n")).first()["n"]
    return -(-(size or 1) // PART_BYTES)


def terms(rows: DataFrame, key: str, body: Column, n: int | None = None) -> DataFrame:
    """`(key, term, tf)`."""
    # rows are dealt by key before they are cut into terms, so that a task's terms follow from the size of a part, not of a file
    n = n or parts(rows, body)
    return rows.select(key, body.alias("_body")).repartition(n, key).select(key, F.explode(text.tokenize(F.col("_body"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(postings: DataFrame, key: str) -> DataFrame:
    """`(term, df, idf)`: ln((N + 1) / (df + 1)) + 1, N the documents with a term. N is one row, so joining it costs nothing."""
    n = postings.agg(F.countDistinct(key).alias("n"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weigh(postings: DataFrame, idfs: DataFrame) -> DataFrame:
    """`postings` with `w`. The COMMON most frequent terms are broadcast; none of the others has more than that share of the postings, so they are dealt by term."""
    common = F.broadcast(cut(idfs.orderBy(F.desc("df"), "term").limit(COMMON).select("term", "idf")))
    often = postings.join(common, "term")
    seldom = postings.join(common, "term", "left_anti").join(idfs.select("term", "idf").join(common, "term", "left_anti"), "term")
    return often.unionByName(seldom).withColumn("w", (1 + F.log("tf")) * F.col("idf")).drop("idf")


def norms(weighted: DataFrame, key: str) -> DataFrame:
    return weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def _pairs(asked: DataFrame, weighted: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """Postings of asked terms. A small set of queries is broadcast; else a frequent term's postings are dealt out, with the queries that hold it copied to each part."""
    if asked.count() <= BROADCAST_TERMS:
        return weighted.join(F.broadcast(asked), "term")
    parts = weighted.groupBy("term").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1")
    right = weighted.join(parts, "term", "left").withColumn("part", F.pmod(F.xxhash64(doc_key), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    left = asked.join(parts, "term", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, ["term", "part"])


def _allowed(postings: DataFrame, idfs: DataFrame, asked: DataFrame, allowed: DataFrame, query_key: str, doc_key: str, digits: int) -> DataFrame:
    """Scores of given pairs: what a document holds of the asked terms is an array beside its norm, what a query asks a map, so that a pair stays one row."""
    known = idfs.select("term", "idf").join(asked.select("term").distinct().withColumn("_asked", F.lit(True)), "term", "left")
    mine = postings.join(allowed.select(doc_key).distinct(), doc_key, "left_semi").join(known, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    held = mine.groupBy(doc_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("_asked"), F.struct("term", "w"))).alias("_held"))
    asks = asked.groupBy(query_key).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"), F.map_from_entries(F.collect_list(F.struct("term", "qw"))).alias("_asks"))
    dot = F.aggregate("_held", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.try_element_at(F.col("_asks"), x["term"]), F.lit(0.0)))
    rows = allowed.join(held, doc_key).join(asks, query_key)
    return rows.select(query_key, doc_key, F.round(dot / (F.col("norm") * F.col("qnorm")), digits).alias("score")).where("score > 0")


def search(documents: DataFrame, doc_key: str, body: Column, queries: DataFrame, query_key: str, query_body: Column, allowed: DataFrame | None = None, digits: int = 8) -> DataFrame:
    """`(query_key, doc_key, score)` with score above 0. `allowed(query_key, doc_key)` restricts pairs before they are scored.

    Texts are cut into terms once; weights, norms and pairs all read those postings.
    """
    n = parts(documents, body)
    postings = cut(terms(documents, doc_key, body, n))
    idfs = cut(idf(postings, doc_key))
    asked = cut(weigh(terms(queries, query_key, query_body), idfs).select(query_key, "term", F.col("w").alias("qw")))
    if allowed is not None:
        return _allowed(postings, idfs, asked, allowed.select(query_key, doc_key).distinct(), query_key, doc_key, digits)
    weighted = weigh(postings, idfs).repartition(n, doc_key)  # scores and norms of a document are added up where it lies
    pairs = _pairs(asked, weighted, query_key, doc_key)
    dots = pairs.groupBy(query_key, doc_key).agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    qnorms = norms(asked.withColumnRenamed("qw", "w"), query_key).withColumnRenamed("norm", "qnorm")
    found = dots.join(norms(weighted, doc_key), doc_key).join(qnorms, query_key)
    return found.select(query_key, doc_key, F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), digits).alias("score")).where("score > 0")
