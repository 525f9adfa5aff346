"""One reduction for all key checks, against the checks one by one; counters observed while writing."""

import random
import re

import pytest
from builders import rows_of, tables

from storelens.operators import audit
from storelens.operators.key_checks import key_checks
from storelens.plans.views import audit_report
from storelens.sources.files import read_parquet_tables, write_tables
from storelens.sources.schemas import TABLES


def found(df):
    return {(r["check"], r["subject"]): (r["violations"], r["rows_involved"]) for r in df.collect()}


def one_by_one(t):
    want = {("duplicate keys", f"{r['tbl']}.{r['key']}"): (r["dup_groups"], r["rows_involved"]) for r in audit.audit_dup_summary(t).collect()}
    want |= {("orphans", r["reference"]): (r["orphan_count"],) * 2 for r in audit.audit_orphans(t).collect()}
    return want


def check(t):
    got, want = found(key_checks(t)), one_by_one(t)
    assert {k: got[k] for k in want} == want
    for name, many in rows_of(audit.audit_multi_child(t)):
        assert got["several children", f"{name}.order_id"][0] == many
    assert got["reconciliation", "order amounts"][0] == audit.audit_reconcile(t).first()["mismatched"]
    conflicts = audit.conflicting(t["customers"], "customer_unique_id", "customer_state").first()["conflicting"]
    assert got["conflicting attributes", "customer_state"][0] == conflicts
    return got


def untidy(spark, seed, rows=60):
    """Tables whose keys repeat, miss their parents and are null at times."""
    rng = random.Random(seed)
    pick = lambda stem, n: rng.choice([None, *(f"{stem}{k}" for k in range(n))])
    some = lambda make: [make() for _ in range(rows)]
    return tables(
        spark,
        customers=some(lambda: dict(customer_id=pick("c", 50), customer_unique_id=pick("p", 20), customer_state=rng.choice([None, "SP", "RJ"]))),
        orders=some(lambda: dict(order_id=pick("o", 40), customer_id=pick("c", 70))),
        order_items=some(lambda: dict(order_id=pick("o", 50), order_item_id=rng.choice([None, 1, 2]), product_id=pick("x", 30), price=rng.choice([None, 1, "1.05"]), freight_value=rng.choice([0, "0.05"]))),
        payments=some(lambda: dict(order_id=pick("o", 50), payment_sequential=rng.choice([1, 2]), payment_value=rng.choice([None, 1, "1.10", 2]))),
        reviews=some(lambda: dict(review_id=pick("r", 6), order_id=pick("o", 50))),
        products=some(lambda: dict(product_id=pick("x", 25))),
        category_translation=some(lambda: dict(product_category_name=pick("k", 90))),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_the_checks_one_by_one(spark, seed):
    got = check(untidy(spark, seed))
    assert all(violations > 0 for violations, _ in got.values())


def test_empty_tables_give_zeros(spark):
    assert set(check(tables(spark)).values()) == {(0, 0)}


def test_a_null_key_is_an_orphan_and_has_no_amount(spark):
    t = tables(
        spark,
        orders=[dict(order_id=None), dict(order_id="a")],
        order_items=[dict(order_id=None, order_item_id=1, price=5, freight_value=0), dict(order_id="a", order_item_id=1, price=5, freight_value=0)],
        payments=[dict(order_id=None, payment_sequential=1, payment_value=9), dict(order_id="a", payment_sequential=1, payment_value="5.10")],
    )
    got = check(t)
    assert got["orphans", "order_items.order_id"] == (1, 1)
    assert got["reconciliation", "order amounts"] == (0, 0)


def test_derived_tables(star):
    check(star)


def test_report_scans_stored_tables_twice(spark, star, tmp_path):
    write_tables(star, str(tmp_path))
    plan = audit_report(read_parquet_tables(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    scans = {name: len(re.findall(rf"{column}#\d+(?:,[^\n]*)?\] parquet|Relation [^\n]*\b{column}#", plan)) for name, column in MARKS.items()}
    assert all(1 <= n <= 2 for n in scans.values()), scans
    assert len(re.findall(r"Relation ", plan)) <= 2 * len(TABLES)


#: A column that only the table itself has.
MARKS = {
    "customers": "customer_unique_id",
    "orders": "order_purchase_timestamp",
    "order_items": "freight_value",
    "payments": "payment_sequential",
    "reviews": "review_score",
    "products": "product_weight_g",
    "category_translation": "product_category_name_english",
}


def test_counters_ride_on_the_write(spark, star, tmp_path):
    got = rows_of(audit.write_profiled(star, str(tmp_path / "a")))
    written = read_parquet_tables(spark, str(tmp_path / "a"))
    want = [("rows", name, n) for name, n in rows_of(audit.row_counts(star))]
    for name in audit.NULL_PROFILES:
        want += rows_of(audit.table_profile(star[name], name))
    assert sorted(got) == sorted(want)
    assert sorted(rows_of(audit.row_counts(written))) == sorted(rows_of(audit.row_counts(star)))


def test_counters_of_an_empty_load_are_zero(spark, tmp_path):
    assert {n for _, _, n in rows_of(audit.write_profiled(tables(spark), str(tmp_path / "b")))} == {0}
