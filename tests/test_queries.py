"""Queries against their SQL at the smallest scale, and the entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from wayfinder.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["query_specs", "candidates_union", "tiered_hard_filter", "seed_pick", "fn_tokenize", "fn_budget_fit", "pattern_top8", "budget_totals", "validator_checks", "ranking_metrics", "schedule_recurrence", "best_by_grouping_sets", "geo_nearby_edges", "dense_topk", "fn_judge_score", "judge_both_orders", "day_suggestions", "plan_by_model", "reached_far"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    cursor = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in order]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["pid", "cid", "position", "vector", "fused"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_nothing_private():
    assert not any(k.startswith("_") for k in entry.queries()) and os.path.isdir(SF)
