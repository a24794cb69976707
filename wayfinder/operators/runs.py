"""Grids of experiment settings and comparisons across runs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The modules and metrics that are compared; metrics of which less is better.
MODULES = ["use_vector", "use_graph_expansion", "use_community_retrieval", "use_summary_layer"]
LOWER_BETTER = ["average_route_distance_ratio", "max_single_day_route_km"]


def normalized(wv: Column, wc: Column, wg: Column) -> list[Column]:
    total = wv + wc + wg
    return [F.round(F.when(total > 0, w / total).otherwise(d), 6) for w, d in ((wv, 0.5), (wc, 0.25), (wg, 0.25))]


def grid(spark: SparkSession, hops=(1, 2), topk_vector=(20, 30), topk_final=(15, 20), weights=((0.5, 0.25, 0.25),), flags=((True,), (True, False), (True, False), (True, False)), max_runs: int | None = None) -> DataFrame:
    """All combinations but community retrieval without expansion, as a table with run_index; a handful of literals."""
    rows = [(h, v, f, *map(float, w), *on) for h, v, f, w in product(hops, topk_vector, topk_final, weights) for on in product(*flags) if on[1] or not on[2]]
    rows = [(i, *r) for i, r in enumerate(rows, 1)][:max_runs]
    t = spark.createDataFrame(rows, "run_index long, hops long, topk_vector long, topk_final long, wv double, wc double, wg double, " + ", ".join(f"{m} boolean" for m in MODULES))
    wv, wc, wg = normalized(F.col("wv"), F.col("wc"), F.col("wg"))
    return t.select("run_index", F.format_string("run_%03d", "run_index").alias("run_id"), "hops", "topk_vector", "topk_final", wv.alias("w_vector"), wc.alias("w_constraint"), wg.alias("w_graph"), *MODULES)


def module_stats(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """`(module, state, metric means)` with each module on and off, from one pass over unpivoted flags."""
    long = rows.unpivot([c for c in rows.columns if c not in MODULES], [c for c in MODULES if c in rows.columns], "module", "state")
    return long.groupBy("module", "state").agg(*(F.avg(m).alias(m) for m in metrics))


def module_deltas(stats: DataFrame, metrics: list[str]) -> DataFrame:
    """On minus off; where less is better, off minus on."""
    of = lambda m, on: F.max(F.when(F.col("state") == on, F.col(m)))
    return stats.groupBy("module").agg(*((of(m, False) - of(m, True) if m in LOWER_BETTER else of(m, True) - of(m, False)).alias(m) for m in metrics))


#: What decides between runs that the target leaves equal, in order.
KEYS = ("constraint_satisfaction_rate", "feasibility_pass_rate", "personalization_proxy", "average_route_distance_ratio")


def _best_first(c: str) -> Column:
    return F.coalesce(c, F.lit(999999.0)).asc() if c in LOWER_BETTER else F.coalesce(c, F.lit(0.0)).desc()


def order_for(target: str, keys: tuple[str, ...] = KEYS) -> list[Column]:
    """Best first: the target, then the keys."""
    return [_best_first(c) for c in (target, *keys)]


def sweep_order(target: str, keys: tuple[str, ...] = KEYS) -> list[Column]:
    """The order of a settings sweep: every key descends, and all ascend where less of the target is better."""
    values = [-F.coalesce(c, F.lit(999999.0)) if c in LOWER_BETTER and c != target else F.coalesce(c, F.lit(0.0)) for c in (target, *keys)]
    return [v.asc() if target in LOWER_BETTER else v.desc() for v in values]


def ranked(rows: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with `place`; runs are few, one row for each."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def bests(rows: DataFrame, target: str) -> DataFrame:
    """The best value for each method, each model and method, and each hop count and method, in one pass of grouping sets."""
    best = F.min(target) if target in LOWER_BETTER else F.max(target)
    return rows.groupingSets([[F.col("method")], [F.col("model"), F.col("method")], [F.col("hops"), F.col("method")]], "method", "model", "hops").agg(best.alias("best"), F.count("*").alias("n"))


#: The order of the default choice among runs.
DEFAULT = ("constraint_satisfaction_rate", "average_route_distance_ratio", "ndcg_at_5")


def default_best(rows: DataFrame, limit: int = 1, keys: tuple[str, ...] = DEFAULT) -> DataFrame:
    return rows.orderBy(*(F.col(c).asc() if c in LOWER_BETTER else F.col(c).desc() for c in keys), "run_id").limit(limit)


def route_best(rows: DataFrame, key: str = "average_route_distance_ratio") -> DataFrame:
    return default_best(rows, 1, (key,))


def strong_subspace(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return rows.where("use_graph_expansion and use_community_retrieval").groupBy("use_summary_layer").agg(*(F.avg(m).alias(m) for m in metrics))


def topk_stats(rows: DataFrame, metrics: list[str]) -> DataFrame:
    return rows.groupBy("topk_final").agg(*(F.avg(m).alias(m) for m in metrics))


def scatter_group() -> Column:
    part = lambda c, name: F.concat(F.lit(f"{name}_"), F.when(F.col(c), "on").otherwise("off"))
    return F.concat_ws("_", part("use_community_retrieval", "community"), part("use_summary_layer", "summary"))


def lookup(rows: DataFrame, run_id: str | None, order: list[Column]) -> DataFrame:
    """The run with an id, or the first in order where none has it."""
    return rows.withColumn("_other", F.coalesce(F.col("run_id") != F.lit(run_id), F.lit(True))).orderBy("_other", *order).limit(1).drop("_other")


def top_runs(rows: DataFrame, ids: list[str], order: list[Column], n: int = 5) -> DataFrame:
    """The runs with these ids in their order, or where there are none the first `n`."""
    at = F.array_position(F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>"), F.col("run_id"))
    known = rows.withColumn("_at", at).withColumn("_any", F.max("_at").over(Window.partitionBy()))  # a row for each run
    return known.where("_at > 0 or _any = 0").orderBy("_at", *order).limit(n).drop("_at", "_any")
