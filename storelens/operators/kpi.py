"""Headline indicators over the order mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import flag, pct, ratio, rows_where


def uses(*columns: str):
    """Record the mart columns an analysis reads, so the mart is built with only these."""

    def mark(function):
        function.columns = columns
        return function

    return mark


@uses("customer_unique_id")
def kpi_repeat_rate(mart: DataFrame) -> DataFrame:
    """Customers with two or more orders; the mart holds one row per order."""
    people = mart.filter(F.col("customer_unique_id").isNotNull()).groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("orders")
    )
    repeat = rows_where(F.col("orders") > 1)
    return people.agg(
        F.count(F.lit(1)).alias("total_customers"),
        repeat.alias("repeat_customers"),
        pct(repeat, F.count(F.lit(1))).alias("repeat_rate_pct"),
    )


@uses("is_late")
def kpi_on_time(mart: DataFrame) -> DataFrame:
    return mart.agg(pct(rows_where(F.col("is_late") == 0), F.count("is_late")).alias("on_time_rate_pct"))


@uses("is_low_review")
def kri_low_review(mart: DataFrame) -> DataFrame:
    return mart.agg(pct(F.sum("is_low_review"), F.count("is_low_review")).alias("low_review_rate_pct"))


@uses("order_revenue")
def kpi_aov(mart: DataFrame, all_orders: bool = False) -> DataFrame:
    """Revenue per order with items, or per order of any kind with ``all_orders``."""
    orders = F.count(F.lit(1)) if all_orders else F.count("order_revenue")
    return mart.agg(ratio(F.sum("order_revenue"), orders).alias("avg_order_value"))


@uses(
    "customer_unique_id",
    "order_status",
    "order_revenue",
    "review_score",
    "is_low_review",
    "is_late",
    "delivery_delay_days",
)
def kpi_headline(mart: DataFrame) -> DataFrame:
    """All headline KPIs in one row and one pass.

    Measures are first reduced per customer, which is the only shuffle, then summed.
    """
    status = F.col("order_status")
    measures = {
        "orders": F.count(F.lit(1)),
        "revenue": F.sum("order_revenue"),
        "with_items": F.count("order_revenue"),
        "on_time": rows_where(F.col("is_late") == 0),
        "late": rows_where(F.col("is_late") == 1),
        "delivered_orders": F.count("is_late"),
        "delay": F.sum("delivery_delay_days"),
        "reviewed": F.count("review_score"),
        "score": F.sum("review_score"),
        "low": F.sum("is_low_review"),
        "status_delivered": rows_where(status == "delivered"),
        "status_canceled": rows_where(status == "canceled"),
    }
    people = mart.groupBy("customer_unique_id").agg(*[m.alias(n) for n, m in measures.items()])
    sums = people.agg(
        *[F.sum(n).alias(n) for n in measures],
        F.count("customer_unique_id").alias("customers"),
        F.sum(flag((F.col("orders") > 1) & F.col("customer_unique_id").isNotNull())).alias("repeat_customers"),
    )
    c = F.col
    return sums.select(
        c("revenue").cast("double").alias("total_revenue"),
        c("orders").alias("total_orders"),
        c("customers").alias("unique_customers"),
        pct(c("repeat_customers"), c("customers")).alias("repeat_rate_pct"),
        pct(c("on_time"), c("delivered_orders")).alias("on_time_rate_pct"),
        pct(c("late"), c("delivered_orders")).alias("late_rate_pct"),
        pct(c("low"), c("reviewed")).alias("low_review_rate_pct"),
        ratio(c("revenue"), c("with_items")).alias("avg_order_value"),
        ratio(c("delay"), c("delivered_orders")).alias("avg_delay_days"),
        ratio(c("score"), c("reviewed")).alias("avg_review_score"),
        pct(c("status_delivered"), c("orders")).alias("delivered_pct"),
        pct(c("status_canceled"), c("orders")).alias("canceled_pct"),
    )


