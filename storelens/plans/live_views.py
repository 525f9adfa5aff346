"""The published analyses as persisted catalog views: SQL text over catalog tables.

A view holds no rows and no stored snapshot, so rows that are appended to a table show up in every view the
next time it is read, in any session, and nothing has to be released or refreshed.

The segment ranks are a query as well. A global NTILE window would sort all customers in one task; here
(value, id) is cut into parts at approximate percentiles, a value that is a cut itself is a part of its own and
is split further by id, and a position is the row number inside its part plus the sizes of earlier
parts. Parts only decide where rows are counted, so the ranks are exact.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql.types import StringType

from storelens.operators.mart import DEFAULT_CATEGORY
from storelens.sources.schemas import SCHEMAS

TILES = 5
#: Percentiles at which a rank's parts begin.
PARTS = 100

_ITEMS = "SELECT order_id, SUM(price) AS total_price, SUM(freight_value) AS total_freight FROM {order_items} GROUP BY order_id"
_SCORES = "SELECT order_id, MAX(review_score) AS review_score FROM {reviews} GROUP BY order_id"
_REVENUE = f"""SELECT c.customer_unique_id, o.order_id, o.order_purchase_timestamp, i.total_price + i.total_freight AS order_revenue
FROM {{orders}} o LEFT JOIN ({_ITEMS}) i ON o.order_id = i.order_id LEFT JOIN {{customers}} c ON o.customer_id = c.customer_id"""
_ANOMALY = """CASE WHEN order_delivered_carrier_date < order_approved_at
  OR order_delivered_customer_date < order_delivered_carrier_date THEN 1 ELSE 0 END AS is_timestamp_anomaly"""


def _share(part: str, whole: str) -> str:
    return f"ROUND(try_divide(CAST({part} AS DOUBLE) * 100.0D, CAST({whole} AS DOUBLE)), 4)"


def _segments(id_number: str) -> str:
    percentiles = ", ".join(f"{i / PARTS}D" for i in range(1, PARTS))
    at_cut = "array_contains(cuts, v)"
    return f"""
WITH rfm AS (
  SELECT customer_unique_id, COUNT(*) AS frequency, SUM(order_revenue) AS revenue,
    try_divide(CAST(SUM(order_revenue) AS DOUBLE), CAST(COUNT(order_revenue) AS DOUBLE)) AS monetary,
    datediff((SELECT MAX(order_purchase_timestamp) FROM {{orders}}), MAX(order_purchase_timestamp)) AS recency_days
  FROM ({_REVENUE}) WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id HAVING monetary IS NOT NULL
), long AS (
  SELECT customer_unique_id, recency_days, frequency, monetary, revenue, {id_number} AS id_number, c, v FROM rfm
  LATERAL VIEW posexplode(array(-CAST(recency_days AS DOUBLE), CAST(frequency AS DOUBLE), monetary)) AS c, v
), cuts AS (
  SELECT c, array_distinct(percentile_approx(v, array({percentiles}))) AS cuts, array_distinct(percentile_approx(id_number, array({percentiles}))) AS ids
  FROM long GROUP BY c
), placed AS (
  SELECT l.*, 2 * size(filter(cuts, x -> x < v)) + IF({at_cut}, 1, 0) AS p, IF({at_cut}, size(filter(ids, x -> x < id_number)), 0) AS q
  FROM long l JOIN cuts USING (c)
), sizes AS (
  SELECT c, p, q, SUM(n) OVER (PARTITION BY c ORDER BY p, q) - n AS before, SUM(n) OVER (PARTITION BY c) AS total
  FROM (SELECT c, p, q, COUNT(*) AS n FROM placed GROUP BY c, p, q)
), ranked AS (
  SELECT placed.*, before + ROW_NUMBER() OVER (PARTITION BY c, p, q ORDER BY v, customer_unique_id) AS rn, total
  FROM placed JOIN sizes USING (c, p, q)
), tiled AS (
  SELECT *, total % {TILES} AS large, total DIV {TILES} AS small FROM ranked
), scored AS (
  SELECT customer_unique_id, recency_days, frequency, monetary, revenue, c,
    CAST(CASE WHEN rn <= large * (small + 1) THEN (rn - 1) DIV (small + 1) + 1
         ELSE large + (rn - 1 - large * (small + 1)) DIV small + 1 END AS INT) AS tile
  FROM tiled
), wide AS (
  SELECT customer_unique_id, recency_days, frequency, monetary, revenue,
    MAX(IF(c = 0, tile, NULL)) AS r_score, MAX(IF(c = 1, tile, NULL)) AS f_score, MAX(IF(c = 2, tile, NULL)) AS m_score
  FROM scored GROUP BY ALL
)
SELECT *, CASE WHEN r_score >= 4 THEN IF(f_score >= 4, 'Champions', 'New/Promising')
  WHEN r_score < 3 AND f_score >= 4 THEN 'At-Risk Loyal' WHEN r_score < 3 AND f_score < 3 THEN 'Lost/Churned' ELSE 'Regular' END AS rfm_segment
FROM wide"""


def view_texts(id_number: str) -> dict[str, str]:
    """The views' SQL by name; table names are left as ``{table}``.

    ``id_number`` turns a customer id into a number that keeps the order of ids.
    """
    late = "CAST(order_delivered_customer_date > order_estimated_delivery_date AS INT)"
    created = "review_creation_date"
    return {
        "orders_quality_flagged": f"SELECT *, {_ANOMALY} FROM {{orders}}",
        "orders_enriched": f"""
SELECT o.order_id, o.customer_id, c.customer_unique_id, c.customer_city, c.customer_state, order_status, order_purchase_timestamp,
  order_delivered_customer_date, order_estimated_delivery_date,
  datediff(order_delivered_customer_date, order_estimated_delivery_date) AS delivery_delay_days, {late} AS is_late,
  total_price, total_freight, total_price + total_freight AS order_revenue, review_score,
  IF(review_score <= 2, 1, 0) AS is_low_review, payment_types, total_payment_value, {_ANOMALY}
FROM {{orders}} o LEFT JOIN ({_ITEMS}) i ON o.order_id = i.order_id LEFT JOIN ({_SCORES}) r ON o.order_id = r.order_id
LEFT JOIN (SELECT order_id, array_join(array_sort(collect_set(payment_type)), ', ') AS payment_types, SUM(payment_value) AS total_payment_value
           FROM {{payments}} GROUP BY order_id) p ON o.order_id = p.order_id
LEFT JOIN {{customers}} c ON o.customer_id = c.customer_id""",
        "products_enriched": f"""
SELECT product_id, p.product_category_name, COALESCE(product_category_name_english, '{DEFAULT_CATEGORY}') AS product_category_name_english,
  product_weight_g, product_length_cm, product_height_cm, product_width_cm
FROM {{products}} p LEFT JOIN {{category_translation}} t ON p.product_category_name = t.product_category_name""",
        "order_primary_payment": """
SELECT order_id, MAX(struct(payment_value, -payment_sequential AS s, payment_type)).payment_type AS primary_payment_type
FROM {payments} GROUP BY order_id""",
        "review_monthly": f"""
SELECT r.order_id, {created}, upper(date_format({created}, "MMM ''yy")) AS month_year, s.review_score
FROM {{reviews}} r JOIN ({_SCORES}) s ON r.order_id = s.order_id WHERE r.order_id IN (SELECT order_id FROM {{orders}})""",
        "kpi_repeat_rate": f"""
SELECT COUNT(*) AS total_customers, COUNT_IF(n > 1) AS repeat_customers, {_share('COUNT_IF(n > 1)', 'COUNT(*)')} AS repeat_rate_pct
FROM (SELECT customer_unique_id, COUNT(*) AS n FROM {{orders}} JOIN {{customers}} USING (customer_id)
      WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id)""",
        "kpi_on_time_delivery": f"SELECT {_share('COUNT_IF(late = 0)', 'COUNT(late)')} AS on_time_rate_pct FROM (SELECT {late} AS late FROM {{orders}})",
        "kri_low_review_rate": f"""
SELECT {_share('COUNT_IF(review_score <= 2)', 'COUNT(review_score)')} AS low_review_rate_pct
FROM ({_SCORES}) WHERE order_id IN (SELECT order_id FROM {{orders}})""",
        "kpi_aov": f"SELECT ROUND(try_divide(CAST(SUM(order_revenue) AS DOUBLE), CAST(COUNT(*) AS DOUBLE)), 4) AS avg_order_value FROM ({_REVENUE})",
        "rfm_segmentation": _segments(id_number),
        "customer_clv": f"""
SELECT customer_unique_id, COUNT(*) AS total_orders, SUM(order_revenue) AS lifetime_revenue,
  try_divide(CAST(SUM(order_revenue) AS DOUBLE), CAST(COUNT(order_revenue) AS DOUBLE)) AS avg_order_value
FROM ({_REVENUE}) WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id""",
        "cohort_retention": f"""
SELECT date_format(first, 'yyyy-MM') AS cohort_month, month_number, COUNT(*) AS active_customers FROM (
  SELECT array_min(months) AS first, explode(transform(months, m -> CAST(months_between(m, array_min(months)) AS INT))) AS month_number FROM (
    SELECT collect_set(CAST(trunc(order_purchase_timestamp, 'MM') AS DATE)) AS months
    FROM {{orders}} JOIN {{customers}} USING (customer_id) WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id))
GROUP BY first, month_number""",
    }


def publish_views(spark: SparkSession, database: str, names: Mapping[str, str] | None = None) -> list[str]:
    """Create or replace the twelve views in ``database``; ``names`` maps tables to catalog names, by default their own there."""
    found = {t: f"{database}.{t}" for t in SCHEMAS} | dict(names or {})
    text = isinstance(spark.table(found["customers"]).schema["customer_unique_id"].dataType, StringType)
    # The first seven bytes of a text, as a number.
    number = "CAST(conv(rpad(substr(hex(customer_unique_id), 1, 14), 14, '0'), 16, 10) AS DOUBLE)" if text else "CAST(customer_unique_id AS DOUBLE)"
    views = view_texts(number)
    for name, sql in views.items():
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {sql.format(**found)}")
    return list(views)
