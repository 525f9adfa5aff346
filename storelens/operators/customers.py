"""Customer value, retention, concentration and seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import (
    PLACES,
    avg_of,
    bin_fixed,
    exact_avg,
    flag,
    floor_days,
    index_label,
    month_index,
    pct,
    total,
)
from storelens.operators.kpi import uses
from storelens.operators.ranking import centred_mean, cumulative_values, ntiles, qcuts, quantile
from storelens.operators.stats import describe, histogram

PERSON = "customer_unique_id"

# Frequency bins and their scores; the last bin is open.
FREQUENCY_EDGES = (0, 1, 2, float("inf"))
FREQUENCY_SCORES = (1, 3, 5)


# --- recency, frequency, monetary -----------------------------------------------------


@uses(PERSON, "order_purchase_timestamp", "order_revenue")
def rfm_base(mart: DataFrame, recency: str = "boundary") -> DataFrame:
    """Days since the last order, orders, revenue and average order value, per customer.

    Customers without any revenue are left out. Recency counts from the newest order.
    """
    people = (
        mart.filter(F.col(PERSON).isNotNull())
        .groupBy(PERSON)
        .agg(
            F.max("order_purchase_timestamp").alias("last_order"),
            F.count(F.lit(1)).alias("frequency"),
            F.sum("order_revenue").alias("revenue"),
            exact_avg("order_revenue").alias("monetary"),
        )
        .filter(F.col("monetary").isNotNull())
    )
    snapshot = mart.agg(F.max("order_purchase_timestamp")).scalar()
    days = F.datediff if recency == "boundary" else floor_days
    recent = days(snapshot, F.col("last_order")).alias("recency_days")
    return people.select(PERSON, recent, "frequency", "monetary", "revenue")


def rfm_ntile(rfm: DataFrame, k: int = 5, buckets: int | None = None) -> DataFrame:
    """Scores by equal-sized tiles; ties are split in order of the customer id."""
    orders = {"r_score": ("recency_days", True), "f_score": ("frequency", False), "m_score": ("monetary", False)}
    return ntiles(rfm, orders, PERSON, k, buckets)


def rfm_quantile(rfm: DataFrame, k: int = 5) -> DataFrame:
    """Scores by quantile bins for recency and value, by fixed bins for frequency."""
    scored = qcuts(rfm, {"r_score": ("recency_days", True), "m_score": ("monetary", False)}, k)
    return scored.withColumn("f_score", bin_fixed(F.col("frequency"), FREQUENCY_EDGES, FREQUENCY_SCORES))


def rfm_segment(r: Column, f: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4), "Champions")
        .when((r >= 4) & (f < 4), "New/Promising")
        .when((r < 3) & (f >= 4), "At-Risk Loyal")
        .when((r < 3) & (f < 3), "Lost/Churned")
        .otherwise("Regular")
    )


def rfm_segments(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rfm_segment", rfm_segment(F.col("r_score"), F.col("f_score")))


def rfm_summary(segments: DataFrame) -> DataFrame:
    grouped = segments.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.avg("monetary"), PLACES).alias("avg_monetary"),
        F.sum("revenue").alias("revenue"),
    )
    share = pct(F.col("revenue"), F.sum("revenue").over(Window.partitionBy()))
    return grouped.withColumn("revenue_pct", share).drop("revenue").orderBy(F.desc("customers"), "rfm_segment")


# --- lifetime value -------------------------------------------------------------------


@uses(PERSON, "order_revenue")
def clv(mart: DataFrame) -> DataFrame:
    """Orders, lifetime revenue (decimal) and average order value per customer."""
    return (
        mart.filter(F.col(PERSON).isNotNull())
        .groupBy(PERSON)
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("order_revenue").alias("lifetime_revenue"),
            exact_avg("order_revenue").alias("avg_order_value"),
        )
    )


def clv_top_decile(values: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` rows of the top revenue decile.

    The decile is a prefix of the descending order, so a top-k and a count are enough.
    """
    earning = values.filter(F.col("lifetime_revenue").isNotNull())
    order = [F.col("lifetime_revenue").desc(), F.col(PERSON)]
    decile_size = earning.agg(F.ceil(F.count(F.lit(1)) / 10)).scalar()
    return (
        earning.orderBy(*order)
        .limit(k)
        .withColumn("place", F.row_number().over(Window.orderBy(*order)))
        .filter(F.col("place") <= decile_size)
        .select(F.lit(1).alias("decile"), PERSON, F.col("lifetime_revenue").cast("double").alias("lifetime_revenue"))
    )


def clv_summary(values: DataFrame) -> DataFrame:
    return describe(values, "lifetime_revenue")


def clv_histogram(values: DataFrame, bins: int = 60) -> DataFrame:
    """Customers by the decimal logarithm of their lifetime revenue."""
    positive = values.filter(F.col("lifetime_revenue") > 0)
    logs = positive.select(F.log10(F.col("lifetime_revenue").cast("double")).alias("log_revenue"))
    return histogram(logs, "log_revenue", None, None, bins)


def top_share(values: DataFrame, q: float, column: str = "lifetime_revenue") -> DataFrame:
    """Share of the total held by rows at or above the ``q`` quantile."""
    cutoff = quantile(values, column, q)
    value = F.col(column)
    return values.agg(
        F.lit(None if cutoff is None else round(cutoff, PLACES)).cast("double").alias("cutoff"),
        F.count(F.when(value.cast("double") >= F.lit(cutoff), 1)).alias("customers"),
        pct(F.sum(F.when(value.cast("double") >= F.lit(cutoff), value)), F.sum(value)).alias("revenue_pct"),
    )


def clv_by_type(values: DataFrame) -> DataFrame:
    return (
        values.groupBy(F.when(F.col("total_orders") > 1, "Repeat").otherwise("One-Time").alias("customer_type"))
        .agg(F.count(F.lit(1)).alias("customers"), avg_of("lifetime_revenue").alias("avg_lifetime_revenue"))
        .orderBy("customer_type")
    )


# --- cohorts --------------------------------------------------------------------------


@uses(PERSON, "order_purchase_timestamp")
def cohort_counts(mart: DataFrame) -> DataFrame:
    """Active customers by first-order month and months since.

    One shuffle per customer collects the distinct order months (at most one per
    calendar month, however many orders there are); no join back, no distinct count.
    """
    month = month_index(F.col("order_purchase_timestamp"))
    people = (
        mart.filter(F.col(PERSON).isNotNull())
        .groupBy(PERSON)
        .agg(F.collect_set(month).alias("months"))
        .select(F.array_min("months").alias("cohort"), F.explode("months").alias("month"))
    )
    return (
        people.groupBy("cohort", (F.col("month") - F.col("cohort")).alias("month_number"))
        .agg(F.count(F.lit(1)).alias("active_customers"))
        .select(index_label(F.col("cohort")).alias("cohort_month"), "month_number", "active_customers")
        .orderBy("cohort_month", "month_number")
    )


@uses(PERSON, "order_purchase_timestamp")
def cohort_retention(mart: DataFrame) -> DataFrame:
    first = F.first("active_customers").over(Window.partitionBy("cohort_month").orderBy("month_number"))
    return cohort_counts(mart).withColumn("retention_pct", pct(F.col("active_customers"), first))


@uses(PERSON, "order_purchase_timestamp")
def cohort_matrix(mart: DataFrame, months: int = 6) -> DataFrame:
    """Retention by cohort (rows) and months since the first order (columns m0, m1, ...)."""
    numbers = list(range(months))
    wide = cohort_retention(mart).groupBy("cohort_month").pivot("month_number", numbers).agg(F.first("retention_pct"))
    return wide.select("cohort_month", *[F.col(str(n)).alias(f"m{n}") for n in numbers]).orderBy("cohort_month")


@uses(PERSON, "order_purchase_timestamp")
def retention_curve(mart: DataFrame, months: int = 6) -> DataFrame:
    """Share of all customers active again in month 1..``months``."""
    counts = cohort_counts(mart).groupBy("month_number").agg(F.sum("active_customers").alias("active"))
    everyone = F.max(F.when(F.col("month_number") == 0, F.col("active"))).over(Window.partitionBy())
    return (
        counts.withColumn("customers", everyone)
        .filter(F.col("month_number").between(1, months))
        .select("month_number", "active", pct(F.col("active"), F.col("customers")).alias("retention_pct"))
        .orderBy("month_number")
    )


# --- concentration ----------------------------------------------------------------------


def pareto(df: DataFrame, key: str, value: str) -> DataFrame:
    """Revenue per group with its cumulative share; for keys with few values, such as states."""
    groups = df.groupBy(key).agg(F.sum(value).alias("revenue")).filter(F.col("revenue").isNotNull())
    running = F.sum("revenue").over(Window.orderBy(F.col("revenue").desc()))
    return groups.select(
        key,
        F.col("revenue").cast("double").alias("revenue"),
        pct(running, F.sum("revenue").over(Window.partitionBy())).alias("cumulative_pct"),
    ).orderBy(F.col("revenue").desc(), key)


@uses("customer_state", "order_revenue")
def pareto_state(mart: DataFrame) -> DataFrame:
    return pareto(mart, "customer_state", "order_revenue")


@uses("customer_state", "order_revenue")
def pareto_state_cover80(mart: DataFrame, target: float = 80.0) -> DataFrame:
    """The fewest states that together reach ``target`` percent of revenue."""
    place = F.row_number().over(Window.orderBy(F.desc("revenue"), "customer_state"))
    ranked = pareto_state(mart).select("customer_state", "cumulative_pct", place.alias("place"))
    reached = F.col("cumulative_pct") >= target
    return ranked.agg(
        F.min(F.when(reached, F.col("place"))).cast("long").alias("states_needed"),
        F.count(F.lit(1)).alias("states"),
        F.min(F.when(reached, F.col("cumulative_pct"))).alias("cumulative_pct"),
    )


def pareto_cutoff(df: DataFrame, value: str, percent: float, buckets: int | None = None) -> DataFrame:
    """Cumulative share at the last row within the top ``percent`` of rows by value.

    The cumulative sum counts all rows tied with that one.
    """
    curve = cumulative_values(df, value, descending=True, buckets=buckets)
    position = F.floor(F.col("n") * percent / 100)
    holds = (position > F.col("cum_rows") - F.col("rows")) & (position <= F.col("cum_rows"))
    return curve.filter(holds).select(
        pct(F.col("cum_sum"), F.col("total")).alias("cumulative_pct"),
        pct(position, F.col("n")).alias("cumulative_customer_pct"),
    )


def pareto_customer_top20(values: DataFrame) -> DataFrame:
    return pareto_cutoff(values, "lifetime_revenue", 20)


# --- seasonality and vouchers --------------------------------------------------------------


@uses("order_month", "order_revenue")
def seasonality(mart: DataFrame) -> DataFrame:
    """Monthly orders with the five-month centred average; edges average what is there."""
    monthly = mart.groupBy("order_month").agg(
        F.count(F.lit(1)).alias("orders"), total("order_revenue").alias("revenue")
    )
    mean = centred_mean(F.col("orders"), F.col("order_month"), 2, 2)
    return monthly.withColumn("rolling_5mo_avg_orders", F.round(mean, PLACES)).orderBy("order_month")


@uses("order_month")
def spike_check(mart: DataFrame, k: int = 5) -> DataFrame:
    """Months furthest above their three-month centred average, which needs all three months."""
    monthly = mart.groupBy("order_month").agg(F.count(F.lit(1)).alias("orders"))
    mean = centred_mean(F.col("orders"), F.col("order_month"), 1, 1, full_frames_only=True)
    above = F.round((F.col("orders") / F.col("mean") - 1) * 100, PLACES)
    return (
        monthly.withColumn("mean", mean)
        .filter(F.col("mean").isNotNull())
        .select("order_month", "orders", F.round("mean", PLACES).alias("rolling_3mo_avg"), above.alias("pct_above_avg"))
        .orderBy(F.desc("pct_above_avg"), "order_month")
        .limit(k)
    )


@uses(PERSON, "payment_type")
def voucher_effect(mart: DataFrame) -> DataFrame:
    people = (
        mart.filter(F.col(PERSON).isNotNull())
        .groupBy(PERSON)
        .agg(F.max(flag(F.col("payment_type") == "voucher")).alias("used_voucher"), F.count(F.lit(1)).alias("orders"))
    )
    return (
        people.groupBy("used_voucher")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            pct(F.sum(flag(F.col("orders") > 1)), F.count(F.lit(1))).alias("repeat_rate_pct"),
        )
        .orderBy("used_voucher")
    )
