"""All checks on keys in one reduction: duplicates, orphans, several children, amounts, conflicting attributes.

Every table is read once. A row gives one narrow entry to each key domain it takes part in, a domain
being a key column of the table that owns it. Entries are counted per (domain, key, side, part), which
finds repeated composite keys, then per (domain, key), where a parent meets all its children. Both
groupings combine before they shuffle, so a key with a third of all rows leaves each map task as one row
per part. The report is one row of counters.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.operators.audit import RECONCILE_TOLERANCE, stack
from storelens.sources.files import Tables
from storelens.sources.schemas import COMPOSITE_KEYS, REFERENCES, SINGLE_KEYS

#: Amounts are counted in hundredths, as longs: sums of wide decimals leave the fast aggregation path.
CENTS = 100


@dataclass(frozen=True)
class Side:
    """A table's rows under a key; ``part`` is the second column of a composite key, or the compared attribute."""

    table: str
    part: str | None = None
    amount: tuple[str, ...] = ()


@dataclass(frozen=True)
class Domain:
    """Values of a key column: the rows of the table that owns it, and those of tables that refer to it."""

    key: str
    owner: Side
    children: tuple[Side, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.owner.table}.{self.key}"

    @property
    def sides(self) -> tuple[Side, ...]:
        return (self.owner, *self.children)


#: Columns whose sum is an order's amount, by table.
AMOUNTS = {"order_items": ("price", "freight_value"), "payments": ("payment_value",)}
#: Attributes that should not change within an entity: (table, entity, attribute).
ATTRIBUTES = (("customers", "customer_unique_id", "customer_state"),)


def domains() -> tuple[Domain, ...]:
    """The domains of the declared keys, references and attributes."""
    parts = {(name, keys[0]): keys[1] for name, keys in COMPOSITE_KEYS}
    of_keys = []
    for owner, key in SINGLE_KEYS:
        children = tuple(Side(child, parts.get((child, key)), AMOUNTS.get(child, ()) if key == "order_id" else ()) for child, on, parent in REFERENCES if (on, parent) == (key, owner))
        of_keys.append(Domain(key, Side(owner, parts.get((owner, key))), children))
    return (*of_keys, *(Domain(entity, Side(name, attribute)) for name, entity, attribute in ATTRIBUTES))


def entries(tables: Tables) -> DataFrame:
    """domain (its number), key, side (0 is the owner), part, amount: of all rows, each table read once."""
    by_table: dict[str, list[Column]] = {}
    for k, d in enumerate(domains()):
        for i, side in enumerate(d.sides):
            amount = sum((F.col(c) for c in side.amount[1:]), F.col(side.amount[0])) if side.amount else F.lit(None)
            entry = F.struct(
                F.lit(k).alias("domain"),
                F.col(d.key).cast("string").alias("key"),
                F.lit(i).alias("side"),
                (F.col(side.part) if side.part else F.lit(None)).cast("string").alias("part"),
                (amount * CENTS).cast("long").alias("amount"),
            )
            by_table.setdefault(side.table, []).append(entry)
    return stack([tables[name].select(F.inline(F.array(*given))) for name, given in by_table.items()])


def key_counts(tables: Tables) -> DataFrame:
    """A row per domain and key; for each side its rows, its repeated parts with their rows, and its amount."""
    rows = entries(tables).groupBy("domain", "key", "side", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    most = max(len(d.sides) for d in domains())
    counters = []
    for i in range(most):
        own, again = F.col("side") == i, (F.col("side") == i) & (F.col("n") > 1)
        counters += [
            F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias(f"rows_{i}"),
            F.count_if(again).alias(f"repeated_{i}"),
            F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias(f"repeated_rows_{i}"),
            F.sum(F.when(own, F.col("amount"))).alias(f"amount_{i}"),
        ]
    parts = F.count_if((F.col("side") == 0) & F.col("part").isNotNull()).alias("parts")
    return rows.groupBy("domain", "key").agg(*counters, parts)


def _checks() -> Mapping[tuple[str, str], tuple[Column, Column, Column]]:
    """By (check, subject): which keys break it, their number's weight, and the rows they hold."""
    one, composite = F.lit(1), {(name, keys[0]): ", ".join(keys) for name, keys in COMPOSITE_KEYS}
    attributes = {(name, entity): attribute for name, entity, attribute in ATTRIBUTES}
    checks: dict[tuple[str, str], tuple[Column, Column, Column]] = {}
    for k, d in enumerate(domains()):
        here = F.col("domain") == k
        # Attributes are compared within an entity that may well repeat.
        if (d.owner.table, d.key) in attributes:
            checks["conflicting attributes", attributes[d.owner.table, d.key]] = (here & (F.col("parts") > 1), one, F.col("rows_0"))
            continue
        checks["duplicate keys", d.name] = (here & (F.col("rows_0") > 1), one, F.col("rows_0"))
        for i, side in enumerate(d.sides):
            if keys := composite.get((side.table, d.key)):
                checks["duplicate keys", f"{side.table}.{keys}"] = (here & (F.col(f"repeated_{i}") > 0), F.col(f"repeated_{i}"), F.col(f"repeated_rows_{i}"))
        for i, side in enumerate(d.children, 1):
            n = F.col(f"rows_{i}")
            # A null key has no parent.
            checks["orphans", f"{side.table}.{d.key}"] = (here & ((F.col("rows_0") == 0) | F.col("key").isNull()) & (n > 0), n, n)
            checks["several children", f"{side.table}.{d.key}"] = (here & (n > 1), one, n)
        paid = [i for i, side in enumerate(d.sides) if side.amount]
        if paid:
            a, b = paid
            both = here & F.col("key").isNotNull() & (F.col(f"rows_{a}") > 0) & (F.col(f"rows_{b}") > 0)
            gap = F.abs(F.col(f"amount_{a}") - F.col(f"amount_{b}"))
            checks["reconciliation", "order amounts"] = (both & (gap > int(Decimal(RECONCILE_TOLERANCE) * CENTS)), one, F.col(f"rows_{a}") + F.col(f"rows_{b}"))
    return checks


def key_checks(tables: Tables) -> DataFrame:
    """(check, subject, violations, rows_involved) of all checks on keys, zeros included.

    Violations are keys, but for orphans, which are rows. Null keys form one group of their own: they count
    as a duplicate where there are several, are orphans, and have no amounts to reconcile. Empty tables give zeros.
    """
    checks = _checks()
    sums = []
    for i, (broken, weight, rows) in enumerate(checks.values()):
        sums += [F.coalesce(F.sum(F.when(broken, x)), F.lit(0)).cast("long").alias(f"{c}{i}") for c, x in (("v", weight), ("r", rows))]
    labelled = F.array(
        *[
            F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"), F.col(f"v{i}").alias("violations"), F.col(f"r{i}").alias("rows_involved"))
            for i, (check, subject) in enumerate(checks)
        ]
    )
    return key_counts(tables).agg(*sums).select(F.inline(labelled))
