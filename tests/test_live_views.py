"""Persisted views: the same rows as the DataFrame analyses, and always of the tables as they are."""

import re

import pytest
from pyspark.sql import functions as F

from storelens.plans.live_views import publish_views
from storelens.plans.views import published_views
from storelens.session import release
from storelens.sources.schemas import SCHEMAS


@pytest.fixture(scope="module")
def live(spark, star):
    spark.sql("CREATE DATABASE IF NOT EXISTS live_shop")
    for name in SCHEMAS:
        star[name].write.mode("overwrite").saveAsTable(f"live_shop.{name}")
    yield publish_views(spark, "live_shop")
    spark.sql("DROP DATABASE live_shop CASCADE")


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def tables_now(spark):
    spark.catalog.clearCache()
    return {name: spark.table(f"live_shop.{name}") for name in SCHEMAS}


def test_rows_are_those_of_the_analyses(spark, live):
    wanted = published_views(tables_now(spark))
    assert set(live) == set(wanted) and len(live) == 12
    for name, df in wanted.items():
        view = spark.table(f"live_shop.{name}")
        assert set(view.columns) == set(df.columns), name
        assert rows(view, df.columns) == rows(df, df.columns), name


def test_appended_rows_show_up_everywhere(spark, live):
    before = {r["customer_unique_id"]: r["rfm_segment"] for r in spark.table("live_shop.rfm_segmentation").collect()}
    orders, items = spark.table("live_shop.orders"), spark.table("live_shop.order_items")
    customers = spark.table("live_shop.customers")
    newest = orders.agg(F.max("order_purchase_timestamp")).head()[0]
    some = orders.orderBy("order_id").limit(30)
    ids = some.select("order_id", "customer_id")
    moved = lambda c, kind: F.col(c) + 10**9 if kind != "string" else F.concat(F.lit("new-"), c)
    kind = {c: orders.schema[c].dataType.simpleString() for c in ("order_id", "customer_id")}
    person = customers.schema["customer_unique_id"].dataType.simpleString()
    new_orders = some.withColumns({c: moved(c, k).cast(k) for c, k in kind.items()}).withColumn("order_purchase_timestamp", F.lit(newest).cast(orders.schema["order_purchase_timestamp"].dataType))
    new_customers = customers.join(ids, "customer_id", "left_semi").withColumns({"customer_id": moved("customer_id", kind["customer_id"]).cast(kind["customer_id"]), "customer_unique_id": moved("customer_unique_id", person).cast(person)})
    new_items = items.join(ids, "order_id", "left_semi").withColumn("order_id", moved("order_id", kind["order_id"]).cast(kind["order_id"]))
    for name, df in (("orders", new_orders), ("customers", new_customers), ("order_items", new_items)):
        df.select(spark.table(f"live_shop.{name}").columns).write.insertInto(f"live_shop.{name}")
    release(spark)
    after = {r["customer_unique_id"]: r["rfm_segment"] for r in spark.table("live_shop.rfm_segmentation").collect()}
    assert set(before) < set(after)
    for name, df in published_views(tables_now(spark)).items():
        assert rows(spark.table(f"live_shop.{name}"), df.columns) == rows(df, df.columns), name


def test_ranks_are_not_made_in_one_task(spark, live):
    plan = spark.table("live_shop.rfm_segmentation")._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"row_number\(\) windowspecdefinition\(([^#]+)#", plan)
    assert windows and set(windows) == {"c"}  # each is partitioned by score, part and sub-part
    assert "CartesianProduct" not in plan
