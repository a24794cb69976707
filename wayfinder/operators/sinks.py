"""Sinks: JSON lines with resume, comparison tables, graph tables and statements, splits, tables for print."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfinder.functions.scratch import cut
from wayfinder.operators import graph

# Labels of node types; what is no part of a name, and what a name starts with.
LABELS = {"city": "City", "transport": "Transport", "attraction": "Attraction", "restaurant": "Restaurant", "hotel": "Hotel", "etype": "EntityType", "preference": "Preference", "pattern": "Pattern", "pattern_slot": "PatternSlot"}


def node_label(kind: Column) -> Column:
    known = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), kind)
    parts = F.filter(F.split(F.trim(kind), "[^0-9A-Za-z]+"), lambda x: x != "")
    camel = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")
    camel = F.when(camel == "", "Unknown").when(camel.rlike("^[A-Za-z]"), camel).otherwise(F.concat(F.lit("Node"), camel))
    return F.coalesce(known, camel)


def relation_type(relation: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(relation), "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    t = F.when(t == "", "RELATED").when(t.rlike("^[A-Za-z]"), t).otherwise(F.concat(F.lit("REL_"), t))
    return F.upper(t)


def quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once for each relation, its ends in order."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "relation").distinct()


def _string(value: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)


def statements(nodes: DataFrame, edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """`(kind, statement)`: one MERGE for each node and each canonical edge, to be written with `write.text`. `pairs` are further edges, canonical already."""
    links = canonical_edges(edges) if pairs is None else canonical_edges(edges).unionByName(pairs)
    props = F.concat(F.lit("{label: "), _string(F.col("label")), F.lit(", layer: "), F.col("layer").cast("string"), F.lit(", node_type: "), _string(F.col("kind")), F.lit("}"))
    n = nodes.select(F.lit("node").alias("kind"), F.concat(F.lit("MERGE (n:GraphNode:"), quoted(node_label(F.col("kind"))), F.lit(" {node_id: "), _string(F.col("node")), F.lit("}) SET n += "), props, F.lit(";")).alias("statement"))
    e = links.select(F.lit("edge").alias("kind"), F.concat(F.lit("MATCH (a:GraphNode {node_id: "), _string(F.col("src")), F.lit("}), (b:GraphNode {node_id: "), _string(F.col("dst")), F.lit("}) MERGE (a)-[r:"), quoted(relation_type(F.col("relation"))), F.lit("]->(b);")).alias("statement"))
    return n.union(e)


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """`rows` with `batch`, by the order of a column; a size of 0 or less is one batch.

    Rows are numbered in ranges of the order, each after the counts of the ranges before it, so
    that no task sees all rows. Alike values are in one range.
    """
    if size <= 0:
        return rows.withColumn("batch", F.lit(0).cast("long"))
    ranged = cut(rows.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    at = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(order).asc_nulls_first())) - 1
    return ranged.withColumn("_at", at).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_at")) / size)).drop("_part", "_at", "_before")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, clear: bool = True) -> None:
    """A version of the graph: nodes and canonical edges as Parquet, merged with the version before it unless `clear`, the new rows first.

    Each version is a folder of its own, named in `versions` once it is whole, so a crash leaves
    the last one as it was.
    """
    spark = nodes.sparkSession
    old = graph_versions(spark, path)
    new = (max(old) if old else 0) + 1
    for name, rows, key in (("nodes", nodes, ["node"]), ("edges", canonical_edges(edges), ["src", "dst", "relation"])):
        if not clear and old:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v{max(old)}/{name}").join(rows, key, "left_anti"))
        rows.write.parquet(f"{path}/v{new}/{name}", mode="overwrite")
    spark.createDataFrame([(new,)], "version int").write.mode("append").json(f"{path}/versions")


def graph_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a stored graph, a few rows; none where there is no graph."""
    return sorted(r["version"] for r in spark.read.schema("version int").json(f"{path}/versions").collect()) if exists(spark, f"{path}/versions") else []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def graph_exists(spark: SparkSession, path: str) -> bool:
    return bool(graph_versions(spark, path))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the last version; an edge without a relation has that of its type."""
    at = f"{path}/v{max(graph_versions(spark, path))}"
    edges = spark.read.parquet(f"{at}/edges")
    if "type" in edges.columns:
        edges = edges.withColumn("relation", F.coalesce("relation", F.lower("type")))
    return spark.read.parquet(f"{at}/nodes"), edges


def graph_stats(nodes: DataFrame, edges: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges (each pair of ends once) and the highest degree. `cells(cid, cell, size)` link all their members, and `edges` then none of them."""
    pairs = edges.select("src", "dst").distinct()
    ends = pairs.select(F.col("src").alias("n"), F.lit(1).cast("long").alias("d")).union(pairs.select("dst", F.lit(1).cast("long")))
    many = pairs.agg(F.count("*").alias("edges"))
    if cells is not None:
        ends = ends.union(cells.where("size > 1").select("cid", F.col("size") - 1))
        many = many.crossJoin(graph.cell_links(cells)).select((F.col("edges") + F.col("n")).alias("edges"))
    ends = ends.groupBy("n").agg(F.sum("d").alias("d")).agg(F.max("d").alias("degree_max"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(many).crossJoin(ends)  # one row each


def resume(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done, keys, "left_anti")


def append_predictions(rows: DataFrame, path: str, keep: bool = True) -> None:
    """Prediction rows as JSON lines by method; what is there stays if `keep`. A write is whole or not there at all."""
    rows.write.mode("append" if keep else "overwrite").partitionBy("method").json(path)


def run_resumed(work: DataFrame, path: str, predict, size: int = 1000) -> int:
    """Predict what `path` has not been asked for yet, `size` requests at a time, each (pid, method) exactly once: how many batches ran.

    work: a row for each pid and method; predict: rows of work to prediction rows. New work is listed
    under `path/_work`, a file a batch, and read as a stream; a batch is an epoch that replaces the
    folder of its number, and the stream's checkpoint is the ledger of epochs that are done. A run
    that ends anywhere goes on with the epoch it was at and writes it again in the same place.
    """
    spark = work.sparkSession
    todo = f"{path}/_work"
    if exists(spark, todo):
        work = resume(work, spark.read.schema(work.schema).parquet(todo).select("pid", "method").distinct(), ["pid", "method"])
    numbered = cut(batches(work, "pid", size))
    last = numbered.agg(F.max("batch").alias("n")).first()["n"]
    if last is not None:
        numbered.repartition(last + 1, "batch").write.mode("append").partitionBy("batch").parquet(todo)
    if not exists(spark, todo):
        return 0
    ran = []

    def write(rows: DataFrame, epoch: int) -> None:
        predict(rows).write.mode("overwrite").partitionBy("method").json(f"{path}/epoch={epoch}")
        ran.append(epoch)

    stream = spark.readStream.schema(work.schema).option("maxFilesPerTrigger", 1).parquet(todo)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return len(ran)


def write_text(spark: SparkSession, said: str, path: str) -> None:
    """One small text as a file, in any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(said.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, value, path: str) -> None:
    write_text(spark, json.dumps(value, ensure_ascii=False, indent=2, default=str), path)


def write_summary(aggregated: DataFrame, path: str, meta: dict | None = None) -> dict:
    """The summary of an experiment: each method's means and `n`, a row a method, as one JSON file."""
    methods = {}
    for r in aggregated.collect():
        row = r.asDict()
        methods[row.pop("method")] = {"n": row.pop("n"), "aggregated": row}
    found = {"methods": methods, "meta": meta or {}}
    write_json(aggregated.sparkSession, found, path)
    return found


def _write_rows(rows: DataFrame, path: str) -> None:
    one = rows.coalesce(1)  # a row for each run
    one.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    one.write.mode("overwrite").json(f"{path}.jsonl")


def write_comparison(rows: DataFrame, folder: str, target: str) -> dict:
    """Runs of several models and hop counts, `rows(run_id, method, model, hops, metrics)`: CSV, JSON lines, and the best by method, model and hops."""
    from wayfinder.operators import runs

    _write_rows(runs.ranked(rows, runs.order_for(target)).orderBy("place"), f"{folder}/comparison")
    found = {"target": target, "best": [r.asDict() for r in runs.bests(rows, target).orderBy("method", "model", "hops").collect()]}
    write_json(rows.sparkSession, found, f"{folder}/comparison_summary.json")
    return found


def write_ablation(rows: DataFrame, folder: str, target: str, top: int = 5) -> dict:
    """Runs of a sweep in order, as CSV and JSON lines, and the best of them as JSON."""
    from wayfinder.operators import runs

    placed = cut(runs.ranked(rows, runs.sweep_order(target)))
    _write_rows(placed.orderBy("place"), f"{folder}/ablation_runs")
    best = [r.asDict() for r in placed.where(F.col("place") <= top).orderBy("place").collect()]
    found = {"target": target, "best_run": best[0] if best else None, "top": best}
    write_json(rows.sparkSession, found, f"{folder}/ablation_summary.json")
    return found


def write_failures(failures: DataFrame, path: str) -> None:
    """What models answered that could not be read: `failures(pid, attempt, error, response)`, as JSON lines by attempt."""
    failures.write.mode("append").partitionBy("attempt").json(path)


def write_split(rows: DataFrame, key: str, share: float, folder: str, seed: int = 42) -> dict:
    """Both parts as JSON lines, their keys as tables, and a manifest with counts."""
    parted = cut(split(rows, key, share, seed))
    n = {r["part"]: r["count"] for r in parted.groupBy("part").count().collect()}
    for part in ("dev", "test"):
        one = parted.where(F.col("part") == part).drop("part")
        one.write.mode("overwrite").json(f"{folder}/{part}")
        one.select(key).write.mode("overwrite").parquet(f"{folder}/{part}_keys")
    size = sum(n.values())
    found = {"seed": seed, "source_size": size, "dev_size": n.get("dev", 0), "test_size": n.get("test", 0), "dev_ratio_effective": n.get("dev", 0) / size if size else 0.0}
    write_json(rows.sparkSession, found, f"{folder}/manifest.json")
    return found


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nodes as rows of a store: what is no plain value, such as the map `meta`, as JSON; empty strings as null."""
    plain = {"string", "int", "bigint", "double", "float", "boolean"}
    value = lambda c, t: F.nullif(F.trim(c), F.lit("")) if t == "string" else F.col(c) if t in plain else F.to_json(c)
    return nodes.select(*(value(c, t).alias(c) for c, t in nodes.dtypes))


def with_meta(rows: DataFrame, meta: str = "map<string,string>") -> DataFrame:
    """Rows of a store as nodes again."""
    return rows.withColumn("meta", F.coalesce(F.from_json("meta", meta), F.create_map().cast(meta)))


def split(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """`rows` with `part` dev or test by a hash of the key: the same for any order, size and number of tasks."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % 10000
    return rows.withColumn("part", F.when(at < int(share * 10000), "dev").otherwise("test"))


def _tex(value) -> str:
    return f"{value:.4f}" if isinstance(value, float) else str(value).replace("_", r"\_")


def latex_rows(rows: DataFrame, columns: list[str]) -> list[str]:
    """Lines of a booktabs table from a small result, numbers with four digits."""
    return [" & ".join(_tex(r[c]) for c in columns) + r" \\" for r in rows.select(*columns).collect()]


def latex_table(rows: DataFrame, columns: dict[str, str], caption: str, label: str) -> str:
    """A whole table of a small result; `columns` are names with their heads."""
    head = " & ".join(columns.values()) + r" \\"
    body = [r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' + 'r' * (len(columns) - 1)}}}", r"\toprule", head, r"\midrule", *latex_rows(rows, list(columns)), r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    return "\n".join(body)


#: The cuts that a figure of a sweep compares.
CUTS = (15, 20)


def latex_figure(stats: DataFrame, metrics: list[str], caption: str, label: str) -> str:
    """A bar plot of metrics by the cut of the ranking, from `runs.topk_stats`; both CUTS must be there."""
    found = {r["topk_final"]: r for r in stats.collect()}
    if any(c not in found for c in CUTS):
        raise ValueError(f"a figure needs runs with topk_final {' and '.join(map(str, CUTS))}")
    names = ",".join(m.replace("_", " ") for m in metrics)
    plots = [rf"\addplot coordinates {{{' '.join(f'({m.replace(chr(95), chr(32))},{found[c][m]:.4f})' for m in metrics)}}};" for c in CUTS]
    return "\n".join([r"\begin{figure}[t]", r"\centering", r"\begin{tikzpicture}", rf"\begin{{axis}}[ybar, symbolic x coords={{{names}}}, xtick=data]", *plots, rf"\legend{{{','.join(f'top {c}' for c in CUTS)}}}", r"\end{axis}", r"\end{tikzpicture}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\end{figure}"])


def standalone(body: str) -> str:
    """A document that holds one table or figure."""
    return "\n".join([r"\documentclass{standalone}", r"\usepackage{booktabs,pgfplots}", r"\begin{document}", body, r"\end{document}"])
