"""A third of all rows under one key: results stay exact and no task holds the key's rows."""

import pytest
from builders import rows_of
from pyspark.sql import functions as F

from storelens.operators import audit, customers, descriptive, diagnostic, kpi
from storelens.operators.mart import items_agg, order_mart

HOT_ORDER, HOT_PRODUCT = 12, 7


@pytest.fixture(scope="module")
def hot(spark, star):
    """The star tables with every third item, payment and review moved to one order, every
    third item to one product, and every third order to one person."""
    third = F.pmod(F.xxhash64("seed"), F.lit(3)) == 0

    def move(df, column, value, *seed):
        moved = df.withColumn("seed", F.concat_ws("-", *seed))
        typed = F.lit(value).cast(df.schema[column].dataType)
        return moved.withColumn(column, F.when(third, typed).otherwise(F.col(column))).drop("seed")

    items = move(star["order_items"], "order_id", HOT_ORDER, "order_id", "order_item_id", "product_id")
    items = move(items, "product_id", HOT_PRODUCT, "product_id", "seller_id", "price")
    return dict(star) | {
        "order_items": items.cache(),
        "payments": move(star["payments"], "order_id", HOT_ORDER, "order_id", "payment_sequential").cache(),
        "reviews": move(star["reviews"], "order_id", HOT_ORDER, "review_id").cache(),
        "customers": move(star["customers"], "customer_unique_id", 1, "customer_id").cache(),
    }


def test_keys_are_hot(hot):
    for name, key, value in (
        ("order_items", "order_id", HOT_ORDER),
        ("order_items", "product_id", HOT_PRODUCT),
        ("payments", "order_id", HOT_ORDER),
        ("customers", "customer_unique_id", 1),
    ):
        assert hot[name].filter(F.col(key) == value).count() > 0.3 * hot[name].count()


def test_mart_keeps_one_row_per_order_and_all_revenue(hot):
    mart = order_mart(hot, None)
    assert mart.count() == hot["orders"].count()
    items = items_agg(hot["order_items"]).join(hot["orders"], "order_id", "left_semi")
    expected = items.agg(F.sum("total_price") + F.sum("total_freight")).head()[0]
    assert mart.agg(F.sum("order_revenue")).head()[0] == expected


def test_payment_by_item_averages_without_the_pairs(hot):
    """The hot order alone would give millions of pairs; a closed form checks the result."""
    items = hot["order_items"].groupBy("order_id").agg(
        F.count("*").alias("n"), F.sum(F.col("price") + F.col("freight_value")).alias("amount")
    )
    pairs = hot["payments"].join(items, "order_id").join(hot["orders"], "order_id")
    expected = pairs.groupBy("payment_installments").agg(
        F.round(F.sum("amount").cast("double") / F.sum("n"), 4).alias("avg_order_value")
    )
    found = rows_of(diagnostic.installments_items(hot), "payment_installments", "avg_order_value")
    assert sorted(found) == sorted(rows_of(expected))
    plan = diagnostic.installments_items(hot)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 6


def test_hot_person_counts_once(hot):
    mart = order_mart(hot, None).cache()
    people = hot["customers"].select("customer_unique_id").distinct().count()
    head = kpi.kpi_headline(mart).head()
    assert head["unique_customers"] == people
    states = descriptive.by_state(mart).agg(F.sum("orders")).head()[0]
    assert states == head["total_orders"]
    first = {r["customer_type"]: r["customers"] for r in diagnostic.first_order_compare(mart).collect()}
    assert sum(first.values()) == people
    cohorts = customers.cohort_counts(mart)
    assert cohorts.filter("month_number = 0").agg(F.sum("active_customers")).head()[0] == people
    mart.unpersist()


def test_reference_checks_with_a_hot_key(hot):
    orphans = {r["reference"]: r["orphan_count"] for r in audit.audit_orphans(hot).collect()}
    assert set(orphans.values()) == {0}
    broken = hot | {"orders": hot["orders"].filter(F.col("order_id") != HOT_ORDER)}
    orphans = {r["reference"]: r["orphan_count"] for r in audit.audit_orphans(broken).collect()}
    assert orphans["order_items.order_id"] == hot["order_items"].filter(F.col("order_id") == HOT_ORDER).count()


def test_category_results_equal_distinct_counts(hot):
    products = hot["products"].join(hot["category_translation"], "product_category_name", "left").select(
        "product_id", F.coalesce("product_category_name_english", F.lit("uncategorized")).alias("category")
    )
    expected = (
        hot["order_items"]
        .join(products, "product_id")
        .groupBy("category")
        .agg(F.countDistinct("order_id").alias("orders"), F.sum("price").cast("double").alias("revenue"))
    )
    found = rows_of(
        descriptive.category_items(hot, k=10_000), "product_category_name_english", "orders", "revenue"
    )
    assert sorted(found) == sorted(rows_of(expected))


def test_hot_join_key_is_split_at_run_time(spark, hot):
    """With thresholds scaled down to the test data the adaptive plan splits the hot product."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        spread = hot | {"order_items": hot["order_items"].repartition(12)}
        df = descriptive.category_items(spread, k=10_000)
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_merged_partitions_do_not_grow_with_the_rows(spark):
    """A task's hash table or sort holds the keys of one merged partition: 8 MB of them, not a task's share of all."""
    rows = spark.range(5_000_000).select(F.xxhash64("id").alias("order_id"), F.xxhash64("id", F.lit(1)).alias("order_item_id"))
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        keys = rows.groupBy("order_id", "order_item_id").agg(F.count(F.lit(1)).alias("cnt"))
        each = keys.where("cnt > 0").groupBy(F.spark_partition_id().alias("part")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
    assert sum(r["count"] for r in each) == 5_000_000
    assert max(r["count"] for r in each) < 500_000
