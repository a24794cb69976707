"""All queries of the engine, by name, and the DuckDB SQL that expresses them.

A query is declared once with its output columns; the same declaration casts and rounds the Spark
result and the oracle, so that schemas agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.plans.base_sql import duck
from wayfinder.sources.domain import World

_TYPES = {"long": ("bigint", "bigint"), "double": ("double", "double"), "string": ("string", "varchar"), "boolean": ("boolean", "boolean")}
#: Digits of numbers; scores are rounded before they rank, and not to fewer digits afterwards.
_DIGITS = {"double": 6, "score": 10}
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, columns: str, sql: str | None = None, more: str = "", plain: bool = False):
    """Register a function of a World under a name; `sql` is the oracle's body over the trip tables (plain: over the raw ones)."""
    fields = [c.split() for c in columns.split(", ")]

    def add(function: Callable[[World], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(World(spark, sf_dir))
            return df.select(*(F.round(F.col(c).cast("double"), _DIGITS[t]).alias(c) if t in _DIGITS else F.col(c).cast(_TYPES[t][0]).alias(c) for c, t in fields))

        _queries[name] = run
        if sql is not None:
            body = sql if plain else duck(sql, more)
            outer = ", ".join(f'round("{c}"::double, {_DIGITS[t]}) as "{c}"' if t in _DIGITS else f'"{c}"::{_TYPES[t][1]} as "{c}"' for c, t in fields)
            _oracles[name] = f"select {outer} from ({body}) result"
        return function

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty candidates of each request by vector, constraint and graph scores together."""
    return queries()["naive_retrieval_topk"](spark, sf_dir)


def _load() -> None:
    from wayfinder.plans import q_evaluation, q_graph, q_retrieval, q_text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
