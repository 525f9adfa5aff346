"""Why it happened: delivery, category, state, first order, installments and freight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import PLACES, avg_of, pct, ratio, rows_where
from storelens.operators.kpi import uses
from storelens.operators.mart import item_categories, item_mart, order_mart
from storelens.operators.stats import corr_matrix, spearman, welch_ttest
from storelens.sources.files import Tables

CORR_COLUMNS = (
    "order_revenue",
    "total_freight",
    "n_items",
    "max_installments",
    "delivery_delay_days",
    "review_score",
)


def _reviewed_deliveries(mart: DataFrame) -> DataFrame:
    return mart.filter(F.col("is_late").isNotNull() & F.col("review_score").isNotNull())


# --- delivery and reviews -----------------------------------------------------------


@uses("is_late", "review_score", "is_low_review")
def late_vs_review(mart: DataFrame) -> DataFrame:
    """Scores of on-time and late deliveries; both rows appear even when one is empty."""
    both = mart.sparkSession.createDataFrame([(0, "On-Time"), (1, "Late")], "is_late int, delivery_status string")
    grouped = (
        _reviewed_deliveries(mart)
        .groupBy("is_late")
        .agg(
            avg_of("review_score").alias("avg_score"),
            F.count(F.lit(1)).alias("orders"),
            pct(F.sum("is_low_review"), F.count(F.lit(1))).alias("low_review_pct"),
        )
    )
    return both.join(grouped, "is_late", "left").drop("is_late")


@uses("is_late", "review_score")
def late_review_welch(mart: DataFrame) -> DataFrame:
    return welch_ttest(_reviewed_deliveries(mart), "review_score", "is_late")


@uses("order_dow_num", "review_score")
def weekend_review_welch(mart: DataFrame) -> DataFrame:
    """Review scores of orders bought at the weekend against those of other days."""
    scored = mart.filter(F.col("review_score").isNotNull())
    weekend = scored.withColumn("is_weekend", (F.col("order_dow_num") >= 5).cast("int"))
    return welch_ttest(weekend, "review_score", "is_weekend")


@uses("is_late", "review_score", "is_low_review")
def late_share_of_low(mart: DataFrame) -> DataFrame:
    """Late orders among reviewed deliveries, and among all low reviews."""
    reviewed = F.col("is_late").isNotNull() & F.col("review_score").isNotNull()
    low = F.col("is_low_review") == 1
    late = F.col("is_late") == 1
    return mart.agg(
        pct(rows_where(reviewed & late), rows_where(reviewed)).alias("late_pct_of_reviewed"),
        pct(rows_where(low & late), rows_where(low)).alias("late_pct_of_low"),
    )


@uses("order_month", "is_late", "review_score")
def monthly_late_review(mart: DataFrame) -> DataFrame:
    return (
        mart.groupBy("order_month")
        .agg(
            pct(F.sum("is_late"), F.count("is_late")).alias("late_rate_pct"),
            avg_of("review_score").alias("avg_score"),
        )
        .orderBy("order_month")
    )


@uses("order_month", "is_late", "review_score")
def monthly_late_corr(mart: DataFrame) -> DataFrame:
    return monthly_late_review(mart).agg(
        F.round(F.corr("late_rate_pct", "avg_score"), PLACES).alias("late_score_corr")
    )


# --- categories ---------------------------------------------------------------------


def category_quality(t: Tables, min_orders: int = 100) -> DataFrame:
    """Score, delay and freight per category, averaged over items.

    Items are reduced to one row per (order, category) before the order columns are
    joined; item-weighted sums keep the item-grain averages exact.
    """
    price = F.col("price").cast("double")
    items = (
        item_categories(t)
        .withColumn("share", F.try_divide(F.col("freight_value").cast("double"), price))
        .groupBy("order_id", "product_category_name_english")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("share").alias("share"), F.count("share").alias("n_share"))
    )
    orders = order_mart(t, None, ["order_id", "review_score", "delivery_delay_days"])
    score, delay, weight = F.col("review_score"), F.col("delivery_delay_days"), F.col("items")
    return (
        items.join(orders, "order_id")
        .groupBy("product_category_name_english")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            ratio(F.sum(score * weight), F.sum(F.when(score.isNotNull(), weight))).alias("avg_review_score"),
            ratio(F.sum(delay * weight), F.sum(F.when(delay.isNotNull(), weight))).alias("avg_delay"),
            pct(F.sum("share"), F.sum("n_share")).alias("avg_freight_ratio_pct"),
        )
        .filter(F.col("orders") > min_orders)
        .orderBy(F.desc("orders"), "product_category_name_english")
    )


@uses("product_category_name_english", "review_score")
def category_volume_score(mart: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` categories with most reviewed orders and their average score."""
    return (
        mart.dropna(subset=["review_score", "product_category_name_english"])
        .groupBy("product_category_name_english")
        .agg(F.count(F.lit(1)).alias("orders"), avg_of("review_score").alias("avg_score"))
        .orderBy(F.desc("orders"), "product_category_name_english")
        .limit(k)
    )


@uses("product_category_name_english", "review_score")
def worst_top_category(mart: DataFrame, k: int = 15) -> DataFrame:
    return category_volume_score(mart, k).orderBy("avg_score", "product_category_name_english").limit(1)


@uses("product_category_name_english", "review_score", "is_late")
def category_score_spread(mart: DataFrame, k: int = 10) -> DataFrame:
    """How far apart the ``k`` biggest categories score, beside the on-time / late gap.

    One pass groups by (category, lateness); both figures come from that small result.
    """
    reviewed = mart.filter(F.col("review_score").isNotNull())
    cells = reviewed.groupBy("product_category_name_english", "is_late").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("review_score").alias("score")
    )
    top = (
        cells.filter(F.col("product_category_name_english").isNotNull())
        .groupBy("product_category_name_english")
        .agg(F.sum("orders").alias("orders"), F.sum("score").alias("score"))
        .orderBy(F.desc("orders"), "product_category_name_english")
        .limit(k)
        .agg(
            F.max(F.col("score") / F.col("orders")).alias("high"),
            F.min(F.col("score") / F.col("orders")).alias("low"),
        )
    )

    def mean(code: int):
        chosen = F.col("is_late") == code
        return F.try_divide(F.sum(F.when(chosen, F.col("score"))), F.sum(F.when(chosen, F.col("orders"))))

    gap = cells.agg(F.round(mean(0) - mean(1), PLACES).alias("gap"))
    return top.select(
        F.round(F.col("high") - F.col("low"), PLACES).alias("category_spread"),
        gap.scalar().alias("on_time_late_gap"),
    )


# --- states ---------------------------------------------------------------------------


def _state_scores(mart: DataFrame) -> DataFrame:
    return (
        mart.dropna(subset=["review_score", "delivery_delay_days"])
        .groupBy("customer_state")
        .agg(
            avg_of("delivery_delay_days").alias("avg_delay"),
            avg_of("review_score").alias("avg_score"),
            F.count(F.lit(1)).alias("orders"),
        )
    )


@uses("customer_state", "review_score", "delivery_delay_days")
def state_satisfaction(mart: DataFrame, min_orders: int = 200, k: int = 10) -> DataFrame:
    """The ``k`` lowest-scoring states with more than ``min_orders`` reviewed deliveries."""
    return (
        _state_scores(mart)
        .filter(F.col("orders") > min_orders)
        .orderBy("avg_score", "customer_state")
        .limit(k)
    )


@uses("customer_state", "review_score", "delivery_delay_days")
def state_residual(mart: DataFrame, min_orders: int = 200) -> DataFrame:
    """Average score minus what a straight line over states predicts from the delay."""
    states = _state_scores(mart).filter(F.col("orders") > min_orders)
    line = states.agg(
        F.struct(
            F.regr_slope("avg_score", "avg_delay").alias("slope"),
            F.regr_intercept("avg_score", "avg_delay").alias("intercept"),
        ).alias("line")
    )
    fitted = states.withColumn("line", line.scalar())
    predicted = F.col("line.intercept") + F.col("line.slope") * F.col("avg_delay")
    return fitted.select(
        "customer_state",
        "avg_delay",
        "avg_score",
        F.round(predicted, PLACES).alias("predicted_score"),
        F.round(F.col("avg_score") - predicted, PLACES).alias("residual"),
    ).orderBy("residual", "customer_state")


# --- customers, installments, freight ---------------------------------------------------


@uses("customer_unique_id", "order_id", "order_purchase_timestamp", "review_score", "delivery_delay_days")
def first_order_compare(mart: DataFrame) -> DataFrame:
    """First orders of one-time and repeat customers; equal times go to the lowest order id."""
    first = F.min(F.struct("order_purchase_timestamp", "order_id", "review_score", "delivery_delay_days"))
    people = (
        mart.filter(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("orders"))
    )
    return (
        people.groupBy(F.when(F.col("orders") > 1, "Repeat").otherwise("One-Time").alias("customer_type"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            avg_of("first.review_score").alias("avg_first_review"),
            avg_of("first.delivery_delay_days").alias("avg_first_delay"),
        )
        .orderBy("customer_type")
    )


@uses("max_installments", "order_revenue", "order_status")
def installments_effect(mart: DataFrame, min_orders: int = 50) -> DataFrame:
    return (
        mart.dropna(subset=["max_installments"])
        .groupBy("max_installments")
        .agg(
            avg_of("order_revenue").alias("avg_order_value"),
            pct(rows_where(F.col("order_status") == "canceled"), F.count(F.lit(1))).alias("cancel_rate_pct"),
            F.count(F.lit(1)).alias("orders"),
        )
        .filter(F.col("orders") > min_orders)
        .orderBy("max_installments")
    )


def installments_items(t: Tables) -> DataFrame:
    """The same at payment x item grain, without building the pairs.

    Each payment row meets every item row of its order, so an order weighs
    (payment rows) x (item rows); sums and counts per side are enough.
    """
    items = (
        t["order_items"]
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum(F.col("price") + F.col("freight_value")).alias("amount"),
            F.count(F.col("price") + F.col("freight_value")).alias("valued"),
        )
    )
    paid = t["payments"].groupBy("order_id", "payment_installments").agg(F.count(F.lit(1)).alias("paid"))
    joined = paid.join(t["orders"].select("order_id", "order_status"), "order_id").join(items, "order_id")
    pairs = F.col("paid") * F.col("items")
    return (
        joined.groupBy("payment_installments")
        .agg(
            ratio(F.sum(F.col("paid") * F.col("amount")), F.sum(F.col("paid") * F.col("valued"))).alias(
                "avg_order_value"
            ),
            pct(F.sum(F.when(F.col("order_status") == "canceled", pairs).otherwise(0)), F.sum(pairs)).alias(
                "cancel_rate_pct"
            ),
        )
        .orderBy("payment_installments")
    )


def category_freight(t: Tables, cutoff: str | None = None) -> DataFrame:
    """Orders and average freight share of the item price, per category."""
    price = F.col("price").cast("double")
    per_order = (
        item_mart(t, cutoff)
        .withColumn("share", F.try_divide(F.col("freight_value").cast("double"), price))
        .groupBy("category", "order_id")
        .agg(F.sum("share").alias("share"), F.count("share").alias("n_share"))
    )
    return per_order.groupBy("category").agg(
        F.count(F.lit(1)).alias("orders"),
        pct(F.sum("share"), F.sum("n_share")).alias("avg_freight_pct"),
    )


def freight_ratio(t: Tables, cutoff: str | None = None, k: int = 10) -> DataFrame:
    return (
        category_freight(t, cutoff)
        .orderBy(F.col("avg_freight_pct").desc_nulls_last(), "category")
        .limit(k)
    )


def freight_volume_spearman(t: Tables, cutoff: str | None = None) -> DataFrame:
    categories = category_freight(t, cutoff)
    rho = spearman(categories, "avg_freight_pct", "orders")
    return categories.sparkSession.createDataFrame([(round(rho, PLACES),)], "spearman double")


@uses(*CORR_COLUMNS)
def order_corr_matrix(mart: DataFrame) -> DataFrame:
    return corr_matrix(mart, CORR_COLUMNS)
