"""Order-level and item-level marts.

Child tables are reduced to one row per order before any join, so each is shuffled once
and no join multiplies rows. Reductions use aggregates with a map-side part; none needs
all rows of one order in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import delay_days, month_label
from storelens.sources.files import Tables

# Label of a product without a translated category, and the first instant
# after the analysis window of the published data set.
DEFAULT_CATEGORY = "uncategorized"
DEFAULT_CUTOFF = "2018-09-01"

ORDER_COLUMNS = (
    "order_id",
    "customer_id",
    "order_status",
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
CUSTOMER_COLUMNS = ("customer_unique_id", "customer_city", "customer_state")
ITEM_COLUMNS = ("total_price", "total_freight", "n_items", "order_revenue", "price_per_item", "freight_ratio")
CATEGORY_COLUMNS = ("product_category_name_english",)
PAYMENT_COLUMNS = ("total_payment", "max_installments", "payment_type")
REVIEW_COLUMNS = ("review_score", "is_low_review")
DELIVERY_COLUMNS = ("is_delivered", "delivery_delay_days", "is_late")
CALENDAR_COLUMNS = ("order_month", "order_month_num", "order_dow_num", "order_dow")
MART_COLUMNS = (
    ORDER_COLUMNS
    + CUSTOMER_COLUMNS
    + ITEM_COLUMNS[:4]
    + CATEGORY_COLUMNS
    + PAYMENT_COLUMNS
    + REVIEW_COLUMNS
    + DELIVERY_COLUMNS
    + CALENDAR_COLUMNS
)


# --- one row per order ------------------------------------------------------------


def items_agg(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.sum("price").alias("total_price"),
        F.sum("freight_value").alias("total_freight"),
        F.count("order_item_id").alias("n_items"),
    )


def _first_item(columns: Iterable[str]) -> Column:
    return F.min(F.struct("order_item_id", *columns))


def first_item(items: DataFrame) -> DataFrame:
    """The row with the lowest item number; equal numbers go to the lowest product, then seller."""
    columns = ("product_id", "seller_id", "price", "freight_value")
    return (
        items.groupBy("order_id")
        .agg(_first_item(columns).alias("f"))
        .select("order_id", "f.order_item_id", *[f"f.{c}" for c in columns])
    )


def pay_agg(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("total_payment"),
        F.max("payment_installments").alias("max_installments"),
    )


def first_payment(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.min(F.struct("payment_sequential", "payment_type"))["payment_type"].alias("payment_type")
    )


def primary_payment(payments: DataFrame) -> DataFrame:
    """Type of the highest payment; equal values go to the lowest sequence number."""
    order = F.struct("payment_value", (-F.col("payment_sequential")).alias("s"), "payment_type")
    return payments.groupBy("order_id").agg(
        F.max(order)["payment_type"].alias("primary_payment_type")
    )


def payment_types(payments: DataFrame) -> DataFrame:
    """Distinct payment types in alphabetical order; the set holds a handful of domain values."""
    return payments.groupBy("order_id").agg(
        F.array_join(F.array_sort(F.collect_set("payment_type")), ", ").alias("payment_types"),
        F.sum("payment_value").alias("total_payment_value"),
    )


def review_agg(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(F.max("review_score").alias("review_score"))


# --- products ---------------------------------------------------------------------


def _categories(t: Tables) -> DataFrame:
    """product_id with its category label."""
    return products_enriched(t).select("product_id", "product_category_name_english")


def products_enriched(t: Tables) -> DataFrame:
    return (
        t["products"]
        .join(t["category_translation"], "product_category_name", "left")
        .select(
            "product_id",
            "product_category_name",
            F.coalesce("product_category_name_english", F.lit(DEFAULT_CATEGORY)).alias(
                "product_category_name_english"
            ),
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        )
    )


# --- marts ------------------------------------------------------------------------


def before_cutoff(df: DataFrame, cutoff: str | None) -> DataFrame:
    if cutoff is None:
        return df
    return df.filter(F.col("order_purchase_timestamp") < F.lit(cutoff).cast("timestamp_ntz"))


def order_ratio_columns() -> dict[str, Column]:
    price = F.col("total_price").cast("double")
    return {
        "price_per_item": F.try_divide(price, F.col("n_items").cast("double")),
        "freight_ratio": F.try_divide(F.col("total_freight").cast("double"), price),
    }


def _with_category(mart: DataFrame, t: Tables) -> DataFrame:
    """The category of each order's first product.

    Orders without items have a key of their own each, so they do not meet in one task. An order
    with items has a category even when its product is not listed.
    """
    key = lambda product, other: F.coalesce(F.concat(F.lit("p"), product.cast("string")), other)
    listed = _categories(t).select(key(F.col("product_id"), F.lit(None)).alias("_key"), "product_category_name_english")
    label = F.coalesce("product_category_name_english", F.lit(DEFAULT_CATEGORY))
    keyed = mart.withColumn("_key", key(F.col("product_id"), F.concat(F.lit("o"), F.col("order_id").cast("string"))))
    return keyed.join(listed, "_key", "left").withColumn(
        "product_category_name_english", F.when(F.col("product_id").isNotNull(), label)
    )


def order_mart(
    t: Tables,
    cutoff: str | None = None,
    columns: Iterable[str] | None = None,
    delay: str = "boundary",
) -> DataFrame:
    """One row per order bought before ``cutoff``.

    Every join is a left join to at most one row, so a join none of whose columns is in
    ``columns`` is not made at all.
    """
    wanted = tuple(columns) if columns is not None else MART_COLUMNS
    need = set(wanted)

    def needs(group: Iterable[str]) -> bool:
        return not need.isdisjoint(group)

    # All joins on the order come first and share one partitioning; products and customers follow.
    mart = before_cutoff(t["orders"].select(*ORDER_COLUMNS), cutoff)
    if needs(ITEM_COLUMNS) or needs(CATEGORY_COLUMNS):
        aggregates = [
            F.sum("price").alias("total_price"),
            F.sum("freight_value").alias("total_freight"),
            F.count("order_item_id").alias("n_items"),
        ]
        if needs(CATEGORY_COLUMNS):
            aggregates.append(_first_item(["product_id"])["product_id"].alias("product_id"))
        mart = mart.join(t["order_items"].groupBy("order_id").agg(*aggregates), "order_id", "left")
        mart = mart.withColumn("order_revenue", F.col("total_price") + F.col("total_freight"))
        mart = mart.withColumns(order_ratio_columns())

    if needs(PAYMENT_COLUMNS):
        aggregates = [
            F.sum("payment_value").alias("total_payment"),
            F.max("payment_installments").alias("max_installments"),
        ]
        if "payment_type" in need:
            first = F.min(F.struct("payment_sequential", "payment_type"))
            aggregates.append(first["payment_type"].alias("payment_type"))
        mart = mart.join(t["payments"].groupBy("order_id").agg(*aggregates), "order_id", "left")

    if needs(REVIEW_COLUMNS):
        mart = mart.join(review_agg(t["reviews"]), "order_id", "left")
        low = F.when(F.col("review_score").isNotNull(), (F.col("review_score") <= 2).cast("int"))
        mart = mart.withColumn("is_low_review", low)

    if needs(CATEGORY_COLUMNS):
        mart = _with_category(mart, t)
    if needs(CUSTOMER_COLUMNS):
        mart = mart.join(t["customers"].select("customer_id", *CUSTOMER_COLUMNS), "customer_id", "left")

    delivered = F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    bought = F.col("order_purchase_timestamp")
    mart = mart.withColumns(
        {
            "is_delivered": delivered.isNotNull().cast("int"),
            "delivery_delay_days": delay_days(delivered, estimated, delay),
            "is_late": F.when(delivered.isNotNull(), (delivered > estimated).cast("int")),
            "order_month": month_label(bought),
            "order_month_num": F.month(bought),
            "order_dow_num": F.weekday(bought),
            "order_dow": F.date_format(bought, "EEEE"),
        }
    )
    return mart.select(*wanted)


def is_timestamp_anomaly() -> Column:
    carrier = F.col("order_delivered_carrier_date")
    return (
        F.when(carrier < F.col("order_approved_at"), 1)
        .when(F.col("order_delivered_customer_date") < carrier, 1)
        .otherwise(0)
    )


def quality_flagged(orders: DataFrame) -> DataFrame:
    return orders.withColumn("is_timestamp_anomaly", is_timestamp_anomaly())


def orders_enriched(t: Tables) -> DataFrame:
    """The warehouse order view: all orders, every payment type, anomaly flag; an
    unreviewed order counts as not low."""
    items = t["order_items"].groupBy("order_id").agg(
        F.sum("price").alias("total_price"), F.sum("freight_value").alias("total_freight")
    )
    delivered = F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    return (
        t["orders"]
        .join(items, "order_id", "left")
        .join(review_agg(t["reviews"]), "order_id", "left")
        .join(payment_types(t["payments"]), "order_id", "left")
        .join(t["customers"].select("customer_id", *CUSTOMER_COLUMNS), "customer_id", "left")
        .select(
            "order_id",
            "customer_id",
            *CUSTOMER_COLUMNS,
            "order_status",
            "order_purchase_timestamp",
            delivered,
            estimated,
            delay_days(delivered, estimated).alias("delivery_delay_days"),
            F.when(delivered.isNotNull(), (delivered > estimated).cast("int")).alias("is_late"),
            "total_price",
            "total_freight",
            (F.col("total_price") + F.col("total_freight")).alias("order_revenue"),
            "review_score",
            F.when(F.col("review_score") <= 2, 1).otherwise(0).alias("is_low_review"),
            "payment_types",
            "total_payment_value",
            is_timestamp_anomaly().alias("is_timestamp_anomaly"),
        )
    )


def review_monthly(t: Tables) -> DataFrame:
    """Every review of a known order with its month label and the order's score."""
    created = F.col("review_creation_date")
    scores = review_agg(t["reviews"]).join(t["orders"].select("order_id"), "order_id", "left_semi")
    return (
        t["reviews"]
        .select("order_id", "review_creation_date")
        .join(scores, "order_id")
        .select(
            "order_id",
            "review_creation_date",
            F.upper(F.date_format(created, "MMM ''yy")).alias("month_year"),
            "review_score",
        )
    )


def item_mart(t: Tables, cutoff: str | None = None) -> DataFrame:
    orders = before_cutoff(t["orders"].select("order_id", "order_purchase_timestamp"), cutoff)
    return (
        t["order_items"]
        .select("order_id", "product_id", "price", "freight_value")
        .join(orders.select("order_id"), "order_id")
        .join(_categories(t), "product_id", "left")
        .select(
            "order_id",
            "price",
            "freight_value",
            F.coalesce("product_category_name_english", F.lit(DEFAULT_CATEGORY)).alias("category"),
        )
    )


def item_categories(t: Tables) -> DataFrame:
    """Items of known products with their category."""
    return t["order_items"].join(_categories(t), "product_id")


def top_groups(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values of a column."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), column)
        .limit(k)
    )


def group_tail(
    df: DataFrame, column: str, k: int = 10, name: str = "category_grouped", other: str = "other"
) -> DataFrame:
    """Keep the ``k`` most frequent values and put all others, nulls too, under ``other``."""
    kept = top_groups(df, column, k).select(F.col(column).alias("_kept"))
    return (
        df.join(F.broadcast(kept), F.col(column) == F.col("_kept"), "left")
        .withColumn(name, F.coalesce("_kept", F.lit(other)))
        .drop("_kept")
    )
