"""What is kept between runs: vectors by fingerprint, graphs by version, summaries; and which of them a run uses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.operators import dense, sinks


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON file as one row, or none where there is no file."""
    return spark.read.option("multiLine", True).json(path) if sinks.exists(spark, path) else None


def vectors_ready(spark: SparkSession, folder: str, fingerprint: str, model: str) -> bool:
    """Whether a folder holds whole vectors of just these texts and this model."""
    meta = read_json(spark, f"{folder}/{fingerprint}/meta.json")
    if meta is None or not sinks.exists(spark, f"{folder}/{fingerprint}/vectors/_SUCCESS"):
        return False
    row = meta.select("fingerprint", "model", "count").first()
    return (row["fingerprint"], row["model"]) == (fingerprint, model) and row["count"] == spark.read.parquet(f"{folder}/{fingerprint}/vectors").count()


def vectors(rows: DataFrame, key: str, body: str, model: str, folder: str, build: Callable[[DataFrame], DataFrame], rebuild: bool = False) -> tuple[DataFrame, str]:
    """Vectors of texts and what was done: loaded where the folder has them, else built, written and read again.

    The meta file is written last, so a broken write is never taken for vectors.
    """
    spark = rows.sparkSession
    mark = dense.fingerprint(rows, key, body, model).first()["fingerprint"]
    at = f"{folder}/{mark}"
    action = "loaded"
    if rebuild or not vectors_ready(spark, folder, mark, model):
        build(rows).write.mode("overwrite").parquet(f"{at}/vectors")
        n = spark.read.parquet(f"{at}/vectors").count()
        sinks.write_json(spark, {"fingerprint": mark, "model": model, "count": n}, f"{at}/meta.json")
        action = "built"
    return spark.read.parquet(f"{at}/vectors"), action


@dataclass(frozen=True)
class Resolved:
    """What a run uses, where it came from and what was done."""

    value: object
    source: str
    action: str
    details: str = ""


def resolve_search(backend: str, lexical: Callable[[], DataFrame], vectorial: Callable[[], DataFrame]) -> Resolved:
    """Scores by words or by vectors; `auto` takes vectors and, if they cannot be had, words."""
    if backend not in ("auto", "tfidf", "dense"):
        raise ValueError(f"unknown search {backend}")
    if backend != "tfidf":
        try:
            return Resolved(vectorial(), "dense", "built_dense")
        except Exception as e:
            if backend == "dense":
                raise
            return Resolved(lexical(), "tfidf", "fallback_tfidf", str(e))
    return Resolved(lexical(), "tfidf", "built_tfidf")


def resolve_graph(spark: SparkSession, source: str, path: str | None, build: Callable[[], tuple[DataFrame, DataFrame]], override: tuple[DataFrame, DataFrame] | None = None, bootstrap: bool = True, clear: bool = True) -> Resolved:
    """Nodes and edges: given ones, built ones, or stored ones, which are built and stored where there are none.

    `auto` without a path, or with one that cannot be read, builds.
    """
    if override is not None:
        return Resolved(override, "override", "override")
    if source not in ("auto", "local", "store"):
        raise ValueError(f"unknown graph source {source}")
    if source == "local" or (source == "auto" and not path):
        return Resolved(build(), "local", "built_local", "" if source == "local" else "no store is named")
    try:
        if sinks.graph_exists(spark, path):
            return Resolved(sinks.read_graph(spark, path), "store", "loaded_store")
        if not bootstrap:
            raise RuntimeError("the store holds no graph, and none may be built for it")
        sinks.write_graph(*build(), path, clear)
        return Resolved(sinks.read_graph(spark, path), "store", "bootstrapped_store")
    except Exception as e:
        if source != "auto":
            raise
        return Resolved(build(), "local", "built_local", str(e))


def stats(graph: tuple[DataFrame, DataFrame]) -> dict:
    return sinks.graph_stats(*graph).first().asDict()


def embed(rows: DataFrame, key: str, terms: DataFrame, words: DataFrame) -> DataFrame:
    """`(key, embedding)`: the mean of the vectors of a text's terms, of length one.

    terms: (key, term), a row for each time a term stands there; words: (term, vector). A text
    none of whose terms has a vector has no row.
    """
    one = terms.groupBy(key, "term").agg(F.count("*").alias("n")).join(words, "term").select(key, "n", F.posexplode("vector").alias("d", "x"))
    dims = one.groupBy(key, "d").agg(F.sum(F.col("n") * F.col("x").cast("double")).alias("x"))
    whole = dims.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))  # as long as a vector
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select(key).join(whole.withColumn("norm", norm), key).select(key, F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("embedding"))


def cosine(a: Column, b: Column) -> Column:
    """Of two vector columns; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))
