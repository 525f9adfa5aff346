"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 4


def pct(numerator: Column, denominator: Column) -> Column:
    """Percentage as a double; null on an empty denominator."""
    return F.round(F.try_divide(numerator.cast("double") * 100.0, denominator.cast("double")), PLACES)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), PLACES)


def exact_avg(column: str | Column) -> Column:
    """Unrounded average of a decimal or integer column, exact up to the final division."""
    col = F.col(column) if isinstance(column, str) else column
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def avg_of(column: str | Column) -> Column:
    return F.round(exact_avg(column), PLACES)


def total(column: str | Column) -> Column:
    """Sum kept in decimal, converted to double only at the end."""
    return F.sum(column).cast("double")


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def rows_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def delay_days(delivered: Column, estimated: Column, method: str = "boundary") -> Column:
    """Days from ``estimated`` to ``delivered``; negative means early.

    ``boundary`` counts calendar-day boundaries; ``floor`` counts whole elapsed days,
    rounded down.
    """
    if method == "boundary":
        return F.datediff(delivered, estimated)
    if method == "floor":
        return floor_days(delivered, estimated)
    raise ValueError(f"unknown delay method {method!r}")


def floor_days(end: Column, start: Column) -> Column:
    seconds = F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000.0)
    return F.floor(seconds).cast("int")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_index(ts: Column) -> Column:
    """Months since year 0, so that a difference counts calendar-month boundaries."""
    return F.year(ts) * 12 + F.month(ts) - 1


def index_label(index: Column) -> Column:
    """The ``yyyy-MM`` label of a ``month_index``."""
    year = F.floor(index / 12).cast("int").cast("string")
    month = (index % 12 + 1).cast("string")
    return F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"))


def bin_fixed(column: Column, edges: Sequence[float], labels: Sequence[int]) -> Column:
    """Label of the right-closed interval holding the value; null outside all of them."""
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (column > low) & (column <= high)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def bin_by_cuts(column: Column, cuts: Sequence[float], descending: bool = False) -> Column:
    """1 + the number of distinct interior cuts below the value (reversed if ``descending``)."""
    distinct = sorted(set(cuts))
    score = F.lit(1)
    for cut in distinct:
        score = score + flag(column > F.lit(cut))
    score = (len(distinct) + 2 - score) if descending else score
    return F.when(column.isNotNull(), score)
