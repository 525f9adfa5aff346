"""Threshold sweeps and the area under the ROC curve, from running counts over all scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import ratio
from storelens.operators.ranking import running_sums


def _counted(df: DataFrame, label: str, score: str, buckets: int | None) -> DataFrame:
    """Rows of either label per distinct score, with running counts from the highest score down."""
    known = df.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("score")).dropna()
    counts = known.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    return running_sums(counts, F.col("score").desc(), ["pos", "neg"], buckets)


def threshold_sweep(df: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """A row per distinct score: what calling every row of at least this score positive would give.

    Rows without a label or score are left out. Scores are range-partitioned, so no task sees all.
    """
    hits, said = F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum")
    return _counted(df, label, score, buckets).select(
        F.col("score").alias("threshold"),
        said.alias("predicted"),
        hits.alias("hits"),
        ratio(hits, said).alias("precision"),
        ratio(hits, F.col("pos_total")).alias("recall"),
        ratio(F.col("neg_cum"), F.col("neg_total")).alias("false_positive_rate"),
        ratio(2 * hits, said + F.col("pos_total")).alias("f1"),
    )


def roc_auc(df: DataFrame, label: str, score: str, buckets: int | None = None) -> float | None:
    """The share of (positive, negative) pairs in which the positive scores higher, ties counting half.

    Equals the rank sum with average ranks for ties. Pairs are counted in decimals, so the sum is exact; null
    without one of the labels.
    """
    wide = "decimal(38,0)"
    pos, below = F.col("pos").cast("long"), F.col("neg_total") - F.col("neg_cum")
    twice = pos.cast(wide) * (2 * below + F.col("neg")).cast("decimal(19,0)")
    row = _counted(df, label, score, buckets).agg(
        F.sum(twice.cast(wide)).alias("twice"), F.max("pos_total").alias("p"), F.max("neg_total").alias("n")
    ).head()
    return int(row["twice"]) / (2 * row["p"] * row["n"]) if row["p"] and row["n"] else None
