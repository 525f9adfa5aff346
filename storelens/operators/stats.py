"""Statistics over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import PLACES, pct
from storelens.operators.ranking import quantiles


def share_of_total(df: DataFrame, key: str, name: str = "pct_of_total") -> DataFrame:
    """Rows and share per value of a low-cardinality column, nulls left out."""
    rows = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn(name, pct(F.col("rows"), F.sum("rows").over(Window.partitionBy())))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, in one row."""
    q25, q50, q75 = quantiles(df, column, [0.25, 0.5, 0.75])
    value = F.col(column).cast("double")
    return df.agg(
        F.count(column).alias("count"),
        F.round(F.sum(column).cast("double") / F.count(column), PLACES).alias("mean"),
        F.round(F.stddev_samp(value), PLACES).alias("std"),
        F.min(value).alias("min"),
        F.lit(q25).cast("double").alias("p25"),
        F.lit(q50).cast("double").alias("p50"),
        F.lit(q75).cast("double").alias("p75"),
        F.max(value).alias("max"),
    )


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations of complete rows in one pass, in long form (a, b, r)."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = list(combinations(columns, 2))
    wide = values.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    a, b = F.split_part("pair", F.lit("|"), F.lit(1)), F.split_part("pair", F.lit("|"), F.lit(2))
    off = long.select(a.alias("a"), b.alias("b"), F.round("r", PLACES).alias("r"))
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], off.schema)
    mirrored = off.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return off.unionByName(mirrored).unionByName(diagonal)


def spearman(df: DataFrame, a: str, b: str) -> float:
    """Rank correlation with tied values at their average rank, over complete rows."""
    pairs = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(pairs).select("v")
    return float(Correlation.corr(vectors, "v", "spearman").head()[0].toArray()[0, 1])


def welch_ttest(df: DataFrame, value: str, group: str) -> DataFrame:
    """Two-sample t-test with unequal variances of group 1 against group 0, in one row."""

    def of(code: int) -> tuple[Column, Column, Column]:
        chosen = F.when(F.col(group) == code, F.col(value).cast("double"))
        return F.count(chosen), F.avg(chosen), F.var_samp(chosen)

    names = [f"{stat}{code}" for code in (1, 0) for stat in ("n", "mean", "var")]
    parts = df.agg(*[c.alias(n) for n, c in zip(names, [*of(1), *of(0)], strict=True)])
    c = F.col
    se1, se0 = F.try_divide(c("var1"), c("n1")), F.try_divide(c("var0"), c("n0"))
    t = F.try_divide(c("mean1") - c("mean0"), F.sqrt(se1 + se0))
    dof = F.try_divide(
        F.pow(se1 + se0, F.lit(2)),
        F.try_divide(se1 * se1, c("n1") - 1) + F.try_divide(se0 * se0, c("n0") - 1),
    )
    # Three selects: inside a lambda a name means the alias of the same select, here a rounded value.
    tested = parts.select(*names, t.alias("t"), dof.alias("dof"))
    tested = tested.withColumn("p_value", t_two_sided_p(c("t"), c("dof")))
    return tested.select(*[c(n) if n.startswith("n") else F.round(n, PLACES).alias(n) for n in tested.columns])


def t_two_sided_p(t: Column, dof: Column, steps: int = 4000) -> Column:
    """Two-sided p-value of Student's t; null where ``t`` or ``dof`` is.

    The share of the density's area beyond |t|, by Simpson's rule. x = start + s / (1 - s) maps
    the half line to s in [0, 1); the constant in front of the density cancels.
    """

    def area(start: Column) -> Column:
        def height(i: Column) -> Column:
            s = i / steps
            x = start + s / (1 - s)
            weight = F.when(i == 0, 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return weight * F.exp(-(dof + 1) / 2 * F.log1p(x * x / dof)) / ((1 - s) * (1 - s))

        # At s = 1 the density is zero for more than one degree of freedom.
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda a, i: a + height(i))

    return F.when(t.isNotNull() & dof.isNotNull(), F.try_divide(area(F.abs(t)), area(F.lit(0.0))))


def histogram(df: DataFrame, column: str, low: float | None, high: float | None, bins: int) -> DataFrame:
    """Fixed-width counts; bin 0 is below ``low``, bin ``bins + 1`` above ``high``.

    Without bounds the column's own minimum and maximum are used.
    """
    value = F.col(column).cast("double")
    values = df.select(value.alias("x")).filter(F.col("x").isNotNull())
    if low is None or high is None:
        edges = values.agg(F.min("x").alias("low"), F.max("x").alias("high")).head()
        low = edges["low"] if low is None else low
        high = edges["high"] if high is None else high
    if low is None or not low < high:
        return values.groupBy(F.lit(1).alias("bin")).agg(F.count(F.lit(1)).alias("rows")).select(
            "bin", F.lit(low).cast("double").alias("bin_from"), F.lit(high).cast("double").alias("bin_to"), "rows"
        )
    width = (high - low) / bins
    inside = F.floor((F.col("x") - F.lit(low)) / F.lit(width)).cast("int") + 1
    number = (
        F.when(F.col("x") < low, 0)
        .when(F.col("x") > high, bins + 1)
        .otherwise(F.least(inside, F.lit(bins)))
    )
    counted = values.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    start = F.when(F.col("bin") > 0, F.lit(low) + (F.col("bin") - 1) * F.lit(width))
    end = F.when(F.col("bin") <= bins, F.lit(low) + F.col("bin") * F.lit(width))
    return counted.select(
        "bin", F.round(start, PLACES).alias("bin_from"), F.round(end, PLACES).alias("bin_to"), "rows"
    )
