"""Feature table, stratified split and class weights for the low-review model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import pct
from storelens.operators.descriptive import every_row
from storelens.operators.kpi import uses
from storelens.operators.mart import top_groups
from storelens.session import materialize

LABEL = "is_low_review"
#: Levels of an encoded column; each becomes a feature.
MAX_LEVELS = 200
CATEGORY = "product_category_name_english"
# The numeric features of the two versions.
NUMERIC_V1 = (
    "total_price",
    "total_freight",
    "n_items",
    "max_installments",
    "delivery_delay_days",
    "order_month_num",
    "order_dow_num",
)
NUMERIC_V2 = NUMERIC_V1 + ("price_per_item", "freight_ratio")
FEATURE_COLUMNS = ("order_id", *NUMERIC_V2, CATEGORY, "payment_type", LABEL)


@uses(LABEL)
def class_balance(mart: DataFrame, unreviewed: str = "drop") -> DataFrame:
    labelled = mart.withColumn(LABEL, label_column(unreviewed)).dropna(subset=[LABEL])
    rows = labelled.groupBy(LABEL).agg(F.count(F.lit(1)).alias("orders"))
    return rows.withColumn("orders_pct", pct(F.col("orders"), F.sum("orders").over(every_row()))).orderBy(LABEL)


def label_column(unreviewed: str) -> Column:
    """An order without a review has no label, or counts as negative."""
    if unreviewed == "drop":
        return F.col(LABEL)
    if unreviewed == "negative":
        return F.coalesce(F.col(LABEL), F.lit(0))
    raise ValueError(f"unknown treatment of unreviewed orders {unreviewed!r}")


@uses(*FEATURE_COLUMNS)
def features(mart: DataFrame, version: int = 2, unreviewed: str = "drop") -> DataFrame:
    """Complete cases: id, numeric features as doubles, the two categories (version 2), label."""
    numeric = NUMERIC_V1 if version == 1 else NUMERIC_V2
    categorical = () if version == 1 else (CATEGORY, "payment_type")
    return mart.select(
        "order_id",
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *categorical,
        label_column(unreviewed).alias(LABEL),
    ).dropna(subset=[*numeric, LABEL])


def top_categories(df: DataFrame, k: int = 10) -> list[str]:
    """Names of the ``k`` most frequent categories; the driver sees only these."""
    return [r[CATEGORY] for r in top_groups(df, CATEGORY, k).collect()]


def grouped_category(top: Sequence[str], other: str = "other") -> Column:
    return F.when(F.col(CATEGORY).isin(list(top)), F.col(CATEGORY)).otherwise(other)


def levels(df: DataFrame, column: Column, most: int = MAX_LEVELS) -> list[str]:
    """Distinct values of a column in alphabetical order; more than ``most`` are an error, since the driver sees them."""
    found = df.select(column.alias("level")).dropna().distinct().orderBy("level").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} levels; group the rare ones first")
    return [r[0] for r in found]


def stratified_split(
    df: DataFrame,
    label: str = LABEL,
    frac: float = 0.8,
    seed: int = 42,
    key: str = "order_id",
    folds: int = 3,
    buckets: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """``df`` with ``is_train`` and ``fold``.

    Rows of each label are put in the order of a seeded hash of the id; the first ``frac``
    of them train, and positions are dealt round-robin to the folds. The leading bits of
    the hash give even buckets, so a window per (label, bucket) and the sizes of earlier
    buckets give exact positions. ``stored``: ``df`` reads a stored table, which two passes may read.
    """
    wanted = buckets or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (wanted - 1).bit_length())
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    rows = (hashed if stored else materialize(hashed)).withColumn("_bucket", F.shiftright("_hash", 64 - bits).cast("int"))
    in_label = Window.partitionBy(label)
    earlier = in_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    prefix = sizes.select(
        label,
        "_bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(in_label).alias("_size"),
    )
    local = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_hash", key))
    place = F.col("_before") + F.col("_local")
    return (
        rows.withColumn("_local", local)
        .join(F.broadcast(prefix), [label, "_bucket"])
        .select(
            *df.columns,
            (place <= F.floor(F.col("_size") * frac)).cast("int").alias("is_train"),
            (place % folds).cast("int").alias("fold"),
        )
    )


def split_counts(split: DataFrame, label: str = LABEL) -> DataFrame:
    return split.groupBy(label, "is_train").agg(F.count(F.lit(1)).alias("orders")).orderBy(label, "is_train")


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weights: all rows / (classes x rows of the class)."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("orders"))
    every = F.sum("orders").over(every_row())
    classes = F.count(F.lit(1)).over(every_row())
    return rows.withColumn("weight", every / (classes * F.col("orders")))


def with_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Attach the balanced weight, two numbers known to the driver."""
    weight = F.lit(None).cast("double")
    for row in class_weights(df, label).collect():
        weight = F.when(F.col(label) == row[label], row["weight"]).otherwise(weight)
    return df.withColumn("weight", weight)
