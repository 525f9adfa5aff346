"""Temporary views of the published analyses, and the combined audit report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators import audit, customers, kpi, mart
from storelens.operators.customers import rfm_ntile, rfm_segments
from storelens.operators.key_checks import key_checks
from storelens.sources.files import Tables


def published_views(t: Tables) -> dict[str, DataFrame]:
    """The views by name; all cover every order, without a cutoff."""

    def over(function):
        return function(mart.order_mart(t, None, function.columns))

    return {
        "orders_quality_flagged": mart.quality_flagged(t["orders"]),
        "orders_enriched": mart.orders_enriched(t),
        "products_enriched": mart.products_enriched(t),
        "order_primary_payment": mart.primary_payment(t["payments"]),
        "review_monthly": mart.review_monthly(t),
        "kpi_repeat_rate": over(kpi.kpi_repeat_rate),
        "kpi_on_time_delivery": over(kpi.kpi_on_time),
        "kri_low_review_rate": over(kpi.kri_low_review),
        "kpi_aov": kpi.kpi_aov(mart.order_mart(t, None, kpi.kpi_aov.columns), all_orders=True),
        "rfm_segmentation": rfm_segments(rfm_ntile(over(customers.rfm_base))),
        "customer_clv": over(customers.clv),
        "cohort_retention": over(customers.cohort_counts),
    }


def register_views(t: Tables) -> list[str]:
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    views = published_views(t)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return [*t, *views]


def audit_report(t: Tables) -> DataFrame:
    """All counting checks as (check, subject, violations), in two passes over each table.

    Checks on keys share one reduction; null, range and chronology checks share one pass per table.
    """
    keys = key_checks(t).filter(F.col("check") != "several children").select("check", "subject", "violations")
    return audit.stack([keys, *[audit.table_profile(t[name], name) for name in audit.NULL_PROFILES]])
