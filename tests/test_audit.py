from builders import one, order, rows_of, table, tables

from storelens.operators import audit
from storelens.operators.mart import quality_flagged
from storelens.plans.views import audit_report
from storelens.sources.files import append_rows


def test_duplicate_and_composite_keys(spark):
    reviews = table(
        spark,
        "reviews",
        dict(review_id="r", order_id="a"),
        dict(review_id="r", order_id="b"),
        dict(review_id="s", order_id="b"),
    )
    assert rows_of(audit.duplicate_keys(reviews, ["review_id"])) == [("r", 2)]
    assert rows_of(audit.duplicate_keys(reviews, ["review_id", "order_id"])) == []
    assert one(audit.duplicate_summary(reviews, ["review_id"])) == {"dup_groups": 1, "rows_involved": 2}
    assert one(audit.multi_child(reviews, "order_id")) == {"parents_with_many": 1}


def test_orphans_count_missing_and_null_parents(spark):
    child = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "k string")
    parent = spark.createDataFrame([("a",), ("b",)], "k string")
    assert one(audit.orphan_count(child, parent, "k")) == {"orphan_count": 3}
    assert rows_of(audit.orphan_values(child, parent, "k")) == [("x", 2)]
    assert one(audit.orphan_count(parent, parent, "k")) == {"orphan_count": 0}


def test_translation_fix_removes_orphans(spark):
    t = tables(spark, products=[dict(product_id="1", product_category_name="pc_gamer"), dict(product_id="2")])
    assert rows_of(audit.audit_orphan_values(t)) == [("pc_gamer", 1)]
    t["category_translation"] = append_rows(t["category_translation"], [("pc_gamer", "gaming_computers")])
    assert rows_of(audit.audit_orphan_values(t)) == []


def test_ranges_count_each_rule_and_ignore_nulls(spark):
    payments = table(
        spark,
        "payments",
        dict(order_id="a", payment_value=0, payment_installments=1),
        dict(order_id="b", payment_value=5, payment_installments=0),
        dict(order_id="c"),
    )
    found = dict(rows_of(audit.range_violations(payments, audit.range_rules()["payments"])))
    assert found == {"payment_negative": 0, "payment_zero": 1, "installments_not_positive": 1}


def test_anomaly_flag(spark):
    orders = table(
        spark,
        "orders",
        order("a", order_approved_at="2017-01-02 00:00:00", order_delivered_carrier_date="2017-01-01 00:00:00")[0],
        order("b", order_delivered_carrier_date="2017-01-01 00:00:00")[0],
        order("c", delivered="2017-01-01 00:00:00", order_delivered_carrier_date="2017-01-03 00:00:00")[0],
    )
    flags = dict(rows_of(quality_flagged(orders), "order_id", "is_timestamp_anomaly"))
    assert flags == {"a": 1, "b": 0, "c": 1}


def test_reconciliation_tolerance_is_exact(spark):
    def amounts(*pairs):
        return spark.createDataFrame(pairs, "k string, v string").selectExpr("k", "cast(v as decimal(10,2)) amount")

    found = one(
        audit.reconcile(
            amounts(("a", "10.00"), ("b", "10.00"), ("c", "1.00")), amounts(("a", "10.10"), ("b", "10.11")), "k"
        )
    )
    assert found == {"compared": 2, "mismatched": 1}


def test_conflicting_attribute(spark):
    people = spark.createDataFrame([("p", "SP"), ("p", "RJ"), ("q", "SP"), ("q", "SP"), ("r", None)], "id string, s string")
    assert one(audit.conflicting(people, "id", "s")) == {"conflicting": 1}


def test_seeded_defects_are_found(star):
    found = {(r["check"], r["subject"]): r["violations"] for r in audit_report(star).collect()}
    for subject in ("reviews.review_id", "order_items.order_id, order_item_id"):
        assert found["duplicate keys", subject] > 0
    assert found["ranges", "payment_zero"] > 0
    assert found["ranges", "installments_not_positive"] > 0
    assert found["chronology", "order_delivered_carrier_date < order_approved_at"] > 0
    assert found["reconciliation", "order amounts"] > 0
    assert found["conflicting attributes", "customer_state"] > 0
    assert found["duplicate keys", "orders.order_id"] == 0
