"""Every registered query against its reference SQL, and what no plan may contain."""

import re

import pytest

import __spark_entry__ as entry
from check_queries import database, difference
from storelens.plans.oracle import ORACLE
from storelens.plans.queries import QUERIES

ROWS_ONLY = {
    "model_compare",
    "model_tuning",
    "feature_importance",
    "order_risk_scores",
    "rfm_kmeans",
    "rfm_kmeans_profile",
}


@pytest.fixture(scope="module")
def con(star_dir):
    return database(star_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    rows = {r["delivery_status"]: r["avg_score"] for r in entry.entry(spark).collect()}
    assert rows["On-Time"] > rows["Late"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees(spark, star_dir, con, name):
    df = QUERIES[name](spark, star_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups|ArrowEval", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(df, con, ORACLE[name]) is None
