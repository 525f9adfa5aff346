"""What happened: breakdowns by status, place, time, category, score and payment.

Results are keyed by status, state, month, category and the like: tens or hundreds of
rows. Windows without a partition run only on such results.

Distinct counts per low-cardinality key are written as two groupings, so the first
shuffle spreads over (key, id) instead of sending each key's ids to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from storelens.functions.exprs import avg_of, pct, ratio, total
from storelens.operators.kpi import uses
from storelens.operators.mart import before_cutoff, item_categories
from storelens.operators.stats import histogram, share_of_total
from storelens.sources.files import Tables

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def every_row() -> WindowSpec:
    """A window over a whole small result."""
    return Window.partitionBy()


@uses("order_status", "order_revenue")
def by_status(mart: DataFrame) -> DataFrame:
    grouped = mart.groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"),
        total("order_revenue").alias("revenue"),
        avg_of("order_revenue").alias("avg_order_value"),
    )
    return grouped.withColumn("orders_pct", pct(F.col("orders"), F.sum("orders").over(every_row()))).orderBy(
        F.col("revenue").desc_nulls_last(), "order_status"
    )


@uses("order_status", "is_delivered")
def undelivered_by_status(mart: DataFrame) -> DataFrame:
    return (
        mart.filter(F.col("is_delivered") == 0)
        .groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("orders"), "order_status")
    )


@uses("customer_state", "customer_unique_id", "order_revenue")
def by_state(mart: DataFrame) -> DataFrame:
    people = mart.groupBy("customer_state", "customer_unique_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_revenue").alias("revenue"),
        F.count("order_revenue").alias("with_items"),
    )
    grouped = people.groupBy("customer_state").agg(
        F.count("customer_unique_id").alias("unique_customers"),
        F.sum("orders").alias("orders"),
        F.sum("revenue").alias("revenue"),
        ratio(F.sum("revenue"), F.sum("with_items")).alias("avg_order_value"),
    )
    return grouped.select(
        "customer_state",
        "unique_customers",
        "orders",
        F.col("revenue").cast("double").alias("revenue"),
        "avg_order_value",
        pct(F.col("revenue"), F.sum("revenue").over(every_row())).alias("revenue_pct"),
    ).orderBy(F.col("revenue").desc_nulls_last(), "customer_state")


@uses("order_month", "order_revenue")
def by_month(mart: DataFrame) -> DataFrame:
    return (
        mart.groupBy("order_month")
        .agg(F.count(F.lit(1)).alias("orders"), total("order_revenue").alias("revenue"))
        .orderBy("order_month")
    )


@uses("order_month", "order_revenue")
def peak_month(mart: DataFrame) -> DataFrame:
    """The busiest month; the earliest one if several tie."""
    return by_month(mart).orderBy(F.desc("orders"), "order_month").limit(1)


@uses("order_dow", "order_dow_num")
def by_weekday(mart: DataFrame) -> DataFrame:
    """Orders per weekday, Monday to Sunday, days without orders included."""
    week = mart.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "order_dow_num int, order_dow string")
    counts = mart.groupBy("order_dow_num").agg(F.count(F.lit(1)).alias("orders"))
    return week.join(counts, "order_dow_num", "left").fillna(0, "orders").orderBy("order_dow_num")


@uses("order_purchase_timestamp")
def by_hour(mart: DataFrame) -> DataFrame:
    return (
        mart.groupBy(F.hour("order_purchase_timestamp").alias("order_hour"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("order_hour")
    )


def category_items(t: Tables, k: int = 10, cutoff: str | None = None) -> DataFrame:
    """Top categories by item revenue, at item grain."""
    items = item_categories(t).select("order_id", "product_category_name_english", "price")
    if cutoff is not None:
        orders = before_cutoff(t["orders"].select("order_id", "order_purchase_timestamp"), cutoff)
        items = items.join(orders.select("order_id"), "order_id")
    per_order = items.groupBy("product_category_name_english", "order_id").agg(
        F.sum("price").alias("price"), F.count("price").alias("items")
    )
    return (
        per_order.groupBy("product_category_name_english")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            total("price").alias("revenue"),
            ratio(F.sum("price"), F.sum("items")).alias("avg_item_price"),
        )
        .orderBy(F.col("revenue").desc_nulls_last(), "product_category_name_english")
        .limit(k)
    )


@uses("product_category_name_english", "order_revenue")
def category_orders(mart: DataFrame, k: int = 10) -> DataFrame:
    """Top categories with each order's revenue credited to its first item."""
    return (
        mart.filter(F.col("product_category_name_english").isNotNull())
        .groupBy("product_category_name_english")
        .agg(F.count(F.lit(1)).alias("orders"), total("order_revenue").alias("revenue"))
        .orderBy(F.col("revenue").desc_nulls_last(), "product_category_name_english")
        .limit(k)
    )


@uses("review_score")
def score_distribution(mart: DataFrame) -> DataFrame:
    return share_of_total(mart, "review_score").orderBy("review_score")


@uses("delivery_delay_days", "is_late")
def delivery_summary(mart: DataFrame) -> DataFrame:
    return mart.agg(
        avg_of("delivery_delay_days").alias("avg_delay_days"),
        pct(F.sum("is_late"), F.count("is_late")).alias("late_pct"),
    )


@uses("delivery_delay_days")
def delay_histogram(mart: DataFrame, low: float = -60, high: float = 40, bins: int = 60) -> DataFrame:
    """Delay in bins over a clipped range; the first and last bin numbers hold what lies outside."""
    return histogram(mart, "delivery_delay_days", low, high, bins)


@uses("delivery_delay_days")
def delay_histogram_full(mart: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(mart, "delivery_delay_days", None, None, bins)


@uses("customer_state", "is_late")
def late_by_state(mart: DataFrame) -> DataFrame:
    return (
        mart.filter(F.col("is_late").isNotNull())
        .groupBy("customer_state")
        .agg(
            F.count(F.lit(1)).alias("delivered_orders"),
            pct(F.sum("is_late"), F.count(F.lit(1))).alias("late_rate_pct"),
        )
        .orderBy(F.desc("late_rate_pct"), "customer_state")
    )


def payments_by_type(payments: DataFrame) -> DataFrame:
    """Payment rows per type; an order counts once per type it used."""
    per_order = payments.groupBy("payment_type", "order_id").agg(
        F.sum("payment_installments").alias("installments"),
        F.count("payment_installments").alias("n_installments"),
        F.sum("payment_value").alias("value"),
        F.count("payment_value").alias("n_value"),
    )
    return (
        per_order.groupBy("payment_type")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            ratio(F.sum("installments"), F.sum("n_installments")).alias("avg_installments"),
            ratio(F.sum("value"), F.sum("n_value")).alias("avg_payment_value"),
        )
        .orderBy(F.desc("orders"), "payment_type")
    )


@uses("payment_type", "max_installments", "total_payment")
def payment_mix(mart: DataFrame) -> DataFrame:
    """Orders by the type of their first payment."""
    grouped = (
        mart.filter(F.col("payment_type").isNotNull())
        .groupBy("payment_type")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            avg_of("max_installments").alias("avg_installments"),
            avg_of("total_payment").alias("avg_payment"),
        )
    )
    return grouped.withColumn("orders_pct", pct(F.col("orders"), F.sum("orders").over(every_row()))).orderBy(
        F.desc("orders"), "payment_type"
    )


def top_k_share(mart: DataFrame, key: str, k: int) -> DataFrame:
    """Number of groups and the revenue share of the ``k`` largest."""
    groups = (
        mart.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("order_revenue").alias("revenue"))
    )
    place = F.row_number().over(Window.orderBy(F.col("revenue").desc_nulls_last(), key))
    return groups.withColumn("place", place).agg(
        F.count(F.lit(1)).alias("groups"),
        pct(F.sum(F.when(F.col("place") <= k, F.col("revenue"))), F.sum("revenue")).alias("top_share_pct"),
    )


@uses("customer_state", "order_revenue")
def top3_state_share(mart: DataFrame) -> DataFrame:
    return top_k_share(mart, "customer_state", 3)


@uses("product_category_name_english", "order_revenue")
def top3_category_share(mart: DataFrame) -> DataFrame:
    return top_k_share(mart, "product_category_name_english", 3)
