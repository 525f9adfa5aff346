"""Data-quality checks: table in, table out.

Key checks group before they join, so a key held by many rows crosses the network once
per map task and never fills one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from storelens.functions.exprs import rows_where
from storelens.sources.files import Tables, overwrite_table
from storelens.sources.schemas import COMPOSITE_KEYS, REFERENCES, SINGLE_KEYS, TABLES


# Columns whose completeness is reported, and the largest accepted gap
# between an order's items and its payments.
NULL_PROFILES = {
    "orders": ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"),
    "reviews": ("review_comment_title", "review_comment_message", "review_score"),
    "products": ("product_category_name", "product_weight_g", "product_photos_qty"),
    "order_items": ("price", "freight_value"),
    "payments": ("payment_type", "payment_value"),
}
RECONCILE_TOLERANCE = "0.10"

CHRONOLOGY_PAIRS = (
    ("order_approved_at", "order_purchase_timestamp"),
    ("order_delivered_carrier_date", "order_approved_at"),
    ("order_delivered_customer_date", "order_delivered_carrier_date"),
    ("order_delivered_customer_date", "order_purchase_timestamp"),
)


def range_rules() -> dict[str, dict[str, Column]]:
    return {
        "reviews": {"review_score_outside_1_5": ~F.col("review_score").between(1, 5)},
        "order_items": {
            "price_not_positive": F.col("price") <= 0,
            "freight_negative": F.col("freight_value") < 0,
        },
        "payments": {
            "payment_negative": F.col("payment_value") < 0,
            "payment_zero": F.col("payment_value") == 0,
            "installments_not_positive": F.col("payment_installments") <= 0,
        },
        "products": {"weight_zero": F.col("product_weight_g") == 0},
    }


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: Tables) -> DataFrame:
    return stack(
        [
            tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("tbl"), "row_count")
            for name in TABLES
        ]
    )


# --- keys -------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)


def duplicate_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return duplicate_keys(df, keys).agg(
        F.count(F.lit(1)).alias("dup_groups"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows_involved"),
    )


def audit_dup_key(tables: Tables) -> DataFrame:
    return stack(
        [
            duplicate_keys(tables[name], [key]).select(
                F.lit(name).alias("tbl"), F.col(key).cast("string").alias("key_value"), "cnt"
            )
            for name, key in SINGLE_KEYS
        ]
    )


def audit_dup_composite_key(tables: Tables) -> DataFrame:
    return stack(
        [
            duplicate_keys(tables[name], keys).select(
                F.lit(name).alias("tbl"),
                F.col(keys[0]).cast("string").alias("key_1"),
                F.col(keys[1]).cast("string").alias("key_2"),
                "cnt",
            )
            for name, keys in COMPOSITE_KEYS
        ]
    )


def audit_dup_summary(tables: Tables) -> DataFrame:
    checks = [(name, (key,)) for name, key in SINGLE_KEYS] + list(COMPOSITE_KEYS)
    return stack(
        [
            duplicate_summary(tables[name], keys).select(
                F.lit(name).alias("tbl"), F.lit(", ".join(keys)).alias("key"), "dup_groups", "rows_involved"
            )
            for name, keys in checks
        ]
    )


# --- references -------------------------------------------------------------------


def _orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Key values of ``child`` missing from ``parent``, with their row counts.

    A null key has no parent, so it is an orphan too.
    """
    keys = child.groupBy(on).agg(F.count(F.lit(1)).alias("rows"))
    return keys.join(parent.select(on).distinct(), on, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    return _orphans(child, parent, on).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_count"))


def orphan_values(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    known = child.filter(F.col(column).isNotNull())
    return _orphans(known, parent, column).withColumnRenamed("rows", "row_count")


def audit_orphans(tables: Tables) -> DataFrame:
    return stack(
        [
            orphan_count(tables[child], tables[parent], on).select(
                F.lit(f"{child}.{on}").alias("reference"), F.lit(parent).alias("parent"), "orphan_count"
            )
            for child, on, parent in REFERENCES
        ]
    )


def audit_orphan_values(tables: Tables) -> DataFrame:
    return orphan_values(tables["products"], tables["category_translation"], "product_category_name")


def childless(parent: DataFrame, child: DataFrame, on: str, by: str) -> DataFrame:
    """Parents without child rows, counted by an attribute."""
    return (
        parent.select(on, by)
        .join(child.select(on).distinct(), on, "left_anti")
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("childless"))
    )


def multi_child(child: DataFrame, key: str) -> DataFrame:
    return duplicate_keys(child, [key]).agg(F.count(F.lit(1)).alias("parents_with_many"))


def audit_multi_child(tables: Tables) -> DataFrame:
    return stack(
        [
            multi_child(tables[name], "order_id").select(F.lit(name).alias("tbl"), "parents_with_many")
            for name in ("payments", "reviews")
        ]
    )


# --- completeness, ranges, domains, chronology --------------------------------------


def null_count(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull()).agg(F.count(F.lit(1)).alias("null_count"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null counts of the chosen columns in one pass: (column, total_rows, nulls)."""
    rows = F.count(F.lit(1))
    wide = df.agg(
        rows.cast("long").alias("total_rows"), *[(rows - F.count(c)).cast("long").alias(c) for c in columns]
    )
    return wide.unpivot(["total_rows"], list(columns), "column", "nulls")


def audit_null_profile(tables: Tables) -> DataFrame:
    return stack(
        [
            null_profile(tables[name], columns).select(F.lit(name).alias("tbl"), "column", "total_rows", "nulls")
            for name, columns in NULL_PROFILES.items()
        ]
    )


def range_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules in one pass; a null breaks none."""
    wide = df.agg(*[rows_where(broken).alias(name) for name, broken in rules.items()])
    return wide.unpivot([], list(rules), "rule", "violations")


def audit_ranges(tables: Tables) -> DataFrame:
    return stack([range_violations(tables[name], rules) for name, rules in range_rules().items()])


def domain(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def audit_domain(tables: Tables) -> DataFrame:
    return stack(
        [
            domain(tables[name], column).select(F.lit(column).alias("column"), F.col(column).alias("value"))
            for name, column in (("orders", "order_status"), ("payments", "payment_type"))
        ]
    )


def chronology(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose first timestamp lies before the second; a missing one is no violation."""
    rules = {f"{late} < {early}": F.col(late) < F.col(early) for late, early in pairs}
    return range_violations(df, rules)


def audit_chronology(tables: Tables) -> DataFrame:
    return chronology(tables["orders"], CHRONOLOGY_PAIRS)


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))


def _profile_rules(name: str) -> dict[tuple[str, str], Column]:
    """The null, range and chronology rules of a table by (check, subject)."""
    rules = {("nulls", f"{name}.{c}"): F.col(c).isNull() for c in NULL_PROFILES.get(name, ())}
    rules |= {("ranges", rule): broken for rule, broken in range_rules().get(name, {}).items()}
    if name == "orders":
        rules |= {("chronology", f"{a} < {b}"): F.col(a) < F.col(b) for a, b in CHRONOLOGY_PAIRS}
    return rules


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """Null, range and chronology violations of one table in a single pass over it."""
    rules = _profile_rules(name)
    counted = df.agg(*[rows_where(broken).alias(f"r{i}") for i, broken in enumerate(rules.values())])
    labelled = F.array(
        *[
            F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"), F.col(f"r{i}").alias("violations"))
            for i, (check, subject) in enumerate(rules)
        ]
    )
    return counted.select(F.inline(labelled))


def write_profiled(tables: Tables, folder: str) -> DataFrame:
    """Write the tables as ``write_tables`` does, and count on the way what ``table_profile`` counts.

    (check, subject, violations), with a check ``rows`` per table. The counters ride on the write
    itself, right before it, so no table is read a second time.
    """
    found = []
    for name, df in tables.items():
        rules = _profile_rules(name)
        seen = Observation(f"profile of {name}")
        counters = [rows_where(broken).alias(f"r{i}") for i, broken in enumerate(rules.values())]
        overwrite_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counters), f"{folder}/{name}")
        counts = seen.get
        found.append(("rows", name, counts["rows"]))
        found += [(*rule, counts[f"r{i}"]) for i, rule in enumerate(rules)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(found, "check string, subject string, violations long")


# --- across tables ------------------------------------------------------------------


def reconcile(a: DataFrame, b: DataFrame, key: str, tolerance: str = RECONCILE_TOLERANCE) -> DataFrame:
    """Compare two (key, amount) tables on the keys they share."""
    gap = F.abs(F.col("amount_a") - F.col("amount_b"))
    both = (
        a.groupBy(key)
        .agg(F.sum("amount").alias("amount_a"))
        .join(b.groupBy(key).agg(F.sum("amount").alias("amount_b")), key)
    )
    return both.agg(
        F.count(F.lit(1)).alias("compared"),
        rows_where(gap > F.lit(tolerance).cast("decimal(10,2)")).alias("mismatched"),
    )


def audit_reconcile(tables: Tables) -> DataFrame:
    items = tables["order_items"].select("order_id", (F.col("price") + F.col("freight_value")).alias("amount"))
    paid = tables["payments"].select("order_id", F.col("payment_value").alias("amount"))
    return reconcile(items, paid, "order_id")


def conflicting(df: DataFrame, entity: str, attribute: str) -> DataFrame:
    """Entities seen with more than one non-null value of an attribute."""
    return (
        df.groupBy(entity)
        .agg(F.min(attribute).alias("low"), F.max(attribute).alias("high"))
        .filter(F.col("low") != F.col("high"))
        .agg(F.count(F.lit(1)).alias("conflicting"))
    )


def rowcount_parity(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")) for df in (a, b)]
    return stack([c.select(F.lit(n).alias("subject"), "row_count") for c, n in zip(counts, names, strict=True)])
