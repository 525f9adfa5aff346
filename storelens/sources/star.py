"""The seven commerce tables derived from the supplied star schema.

Key arithmetic only, so the derivation is a plain projection of the scanned tables and
every audit rule has something to find. ``l_linenumber`` repeats within an order in the
supplied data; it is kept as it is, and the composite-key audit reports it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources.schemas import TABLES

STAR_CUTOFF = "2001-08-01"
STAR_TRANSLATION_FIXES = (("promo_brand#1", "PROMO_BRAND#1"), ("small_brand#2", "SMALL_BRAND#2"))


def _days(n) -> F.Column:
    return F.make_dt_interval(days=n)


def _hours(n) -> F.Column:
    return F.make_dt_interval(hours=n)


def _int(expr) -> F.Column:
    return expr.cast("int")


class DerivedTables(Mapping):
    """The seven tables, each derived when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        self._scans: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    def _scan(self, name: str) -> DataFrame:
        if name not in self._scans:
            self._scans[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._scans[name]

    def _build(self, name: str) -> DataFrame:
        scan = self._scan
        if name == "customers":
            return _customers(scan("orders"), scan("customer"), scan("nation"))
        if name == "orders":
            return _orders(scan("orders")).drop("o_custkey")
        if name == "order_items":
            return _order_items(scan("lineitem"))
        if name == "payments":
            return _payments(scan("orders"), self["order_items"])
        if name == "reviews":
            return _reviews(self["orders"])
        if name == "products":
            return _products(scan("part"))
        return _translation(self["products"])

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def commerce_tables(spark: SparkSession, sf_dir: str) -> DerivedTables:
    return DerivedTables(spark, sf_dir)


def _customers(orders, customer, nation) -> DataFrame:
    key = F.col("o_orderkey")
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("customer_id"),
        F.when(key % 8 == 0, F.col("o_custkey")).otherwise(key + 1_000_000_000).alias("customer_unique_id"),
        F.lpad((key % 100_000).cast("string"), 5, "0").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.when(key % 400 == 0, "NATION_0").otherwise(F.col("n_name")).alias("customer_state"),
    )


def _orders(orders) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = (
        F.when(key % 100 == 1, "canceled")
        .when(key % 100 == 2, "unavailable")
        .when(key % 100 == 3, "shipped")
        .otherwise("delivered")
    )
    bought = F.col("order_purchase_timestamp")
    carrier = (
        F.when(F.col("order_status").isin("canceled", "unavailable"), None)
        .when(key % 73 == 0, bought - _days(F.lit(1)))
        .otherwise(bought + _days(_int(1 + key % 3)))
    )
    delivered = F.when(
        F.col("order_status") == "delivered", bought + _days(_int(3 + (key * 13 + cust) % 25))
    )
    estimated = bought.cast("date").cast("timestamp_ntz") + _days(_int(18 + (key * 7 + cust * 3) % 14))
    return orders.select(
        key.alias("order_id"),
        key.alias("customer_id"),
        status.alias("order_status"),
        (F.col("o_orderdate").cast("timestamp_ntz") + _hours(_int(key % 24))).alias("order_purchase_timestamp"),
        cust,
        key,
    ).select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        F.when(key % 600 == 0, None).otherwise(bought + _hours(_int(key % 5))).alias("order_approved_at"),
        carrier.alias("order_delivered_carrier_date"),
        delivered.alias("order_delivered_customer_date"),
        estimated.alias("order_estimated_delivery_date"),
        "o_custkey",
    )


def _order_items(lineitem) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
        (F.col("l_quantity") * (1 + F.col("l_partkey") % 20)).cast("decimal(10,2)").alias("freight_value"),
    )


def _payments(orders, items) -> DataFrame:
    """One payment per order, a second of ten for some, and a third of zero for a few."""
    key = F.col("o_orderkey")
    totals = items.groupBy(F.col("order_id").alias("o_orderkey")).agg(
        (F.sum("price") + F.sum("freight_value")).cast("decimal(18,2)").alias("tot")
    )
    first_type = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "credit_card")
        .when(F.col("o_orderpriority") == "2-HIGH", "boleto")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "voucher")
        .when(F.col("o_orderpriority") == "5-LOW", "debit_card")
        .otherwise("not_defined")
    )
    installments = F.when(key % 700 == 0, 0).otherwise(_int(1 + (F.col("o_custkey") * 7 + key) % 10))
    amount = (
        F.coalesce(F.col("tot"), F.col("o_totalprice").cast("decimal(18,2)"))
        - F.when(key % 20 == 0, 10).otherwise(0)
        + F.when(key % 380 == 0, 1).otherwise(0)
    )

    def rows(df, sequential, kind, count, value):
        return df.select(
            key.alias("order_id"),
            F.lit(sequential).alias("payment_sequential"),
            kind.alias("payment_type"),
            count.alias("payment_installments"),
            value.cast("decimal(18,2)").alias("payment_value"),
        )

    voucher, once = F.lit("voucher"), F.lit(1)
    first = rows(orders.join(totals, "o_orderkey", "left"), 1, first_type, installments, amount)
    second = rows(orders.filter(key % 20 == 0), 2, voucher, once, F.lit(10))
    third = rows(orders.filter(key % 900 == 0), 3, voucher, once, F.lit(0))
    return first.unionByName(second).unionByName(third)


def _reviews(orders) -> DataFrame:
    """One review for most orders and a second five-star one for a few."""
    key = F.col("order_id")
    late = F.coalesce(
        F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"), F.lit(False)
    )
    pick = (key * 17) % 20
    on_time_score = F.when(pick < 1, 1).when(pick < 2, 2).when(pick < 4, 3).when(pick < 8, 4).otherwise(5)

    def rows(df, review_id, score, days):
        created = F.col("order_purchase_timestamp") + _days(F.lit(days))
        return df.select(
            review_id.alias("review_id"),
            "order_id",
            score.cast("int").alias("review_score"),
            F.when(key % 8 == 0, F.concat(F.lit("title "), key.cast("string"))).alias("review_comment_title"),
            F.when(key % 5 < 2, F.concat(F.lit("message "), key.cast("string"))).alias("review_comment_message"),
            created.alias("review_creation_date"),
            (created + _days(F.lit(2))).alias("review_answer_timestamp"),
        )

    reviewed = orders.filter(key % 130 != 0)
    first_id = F.when(key % 250 == 1, key - 1).otherwise(key)
    first = rows(reviewed, first_id, F.when(late, 1 + (key * 11) % 4).otherwise(on_time_score), 30)
    second = rows(reviewed.filter(key % 180 == 0), -key, F.lit(5), 31)
    return first.unionByName(second)


def _products(part) -> DataFrame:
    key = F.col("p_partkey")
    weight = F.when(key % 997 == 0, None).when(key % 331 == 0, 0).otherwise(F.col("p_size") * 100)
    return part.select(
        key.alias("product_id"),
        F.when(key % 54 == 0, None)
        .otherwise(F.lower(F.concat_ws("_", "p_type", "p_brand")))
        .alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        _int(20 + key % 400).alias("product_description_lenght"),
        F.when(key % 54 == 0, None).otherwise(_int(1 + key % 6)).alias("product_photos_qty"),
        weight.cast("int").alias("product_weight_g"),
        _int(10 + key % 50).alias("product_length_cm"),
        _int(5 + key % 30).alias("product_height_cm"),
        _int(8 + key % 40).alias("product_width_cm"),
    )


def _translation(products) -> DataFrame:
    name = F.col("product_category_name")
    missing = [source for source, _ in STAR_TRANSLATION_FIXES]
    return (
        products.filter(name.isNotNull() & ~name.isin(missing))
        .select(name)
        .distinct()
        .select(name, F.upper(name).alias("product_category_name_english"))
    )
