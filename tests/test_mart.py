from builders import one, order, rows_of, table, tables

from storelens.operators import kpi
from storelens.operators import mart as m


def build(spark, orders, **rows):
    return tables(spark, orders=[o for o, _ in orders], customers=[c for _, c in orders], **rows)


def test_delay_by_boundary_and_by_elapsed_days(spark):
    t = build(
        spark,
        [
            order("late", delivered="2017-11-25 01:00:00", estimated="2017-11-24 23:00:00"),
            order("early", delivered="2017-11-23 22:00:00", estimated="2017-11-24 00:00:00"),
            order("none"),
        ],
    )
    columns = ["order_id", "delivery_delay_days", "is_late", "is_delivered"]
    boundary = {r[0]: r[1:] for r in rows_of(m.order_mart(t, columns=columns))}
    assert boundary == {"late": (1, 1, 1), "early": (-1, 0, 1), "none": (None, None, 0)}
    floor = {r[0]: r[1] for r in rows_of(m.order_mart(t, columns=columns, delay="floor"))}
    assert floor == {"late": 0, "early": -1, "none": None}


def test_undelivered_unreviewed_and_itemless_orders_stay_out_of_rates(spark):
    t = build(
        spark,
        [
            order("a", "p1", delivered="2017-12-02 00:00:00"),
            order("b", "p2", delivered="2017-11-30 00:00:00"),
            order("c", "p3", status="canceled"),
        ],
        order_items=[
            dict(order_id="a", order_item_id=1, product_id="x", price=8, freight_value=2),
            dict(order_id="b", order_item_id=1, product_id="x", price=15, freight_value=5),
        ],
        reviews=[dict(review_id="r1", order_id="a", review_score=1)],
    )
    mart = m.order_mart(t)
    rows = {r["order_id"]: r for r in mart.collect()}
    assert rows["c"]["order_revenue"] is None and rows["c"]["product_category_name_english"] is None
    assert rows["a"]["product_category_name_english"] == "uncategorized"
    assert rows["b"]["is_low_review"] is None and rows["a"]["is_low_review"] == 1
    head = one(kpi.kpi_headline(mart))
    assert head["late_rate_pct"] == 50.0 and head["on_time_rate_pct"] == 50.0
    assert head["low_review_rate_pct"] == 100.0
    assert head["avg_order_value"] == 15.0 and head["total_orders"] == 3
    assert head["canceled_pct"] == 33.3333
    assert one(kpi.kpi_aov(mart, all_orders=True))["avg_order_value"] == 10.0


def test_highest_review_counts(spark):
    reviews = table(
        spark,
        "reviews",
        dict(review_id="r1", order_id="a", review_score=1),
        dict(review_id="r2", order_id="a", review_score=5),
    )
    assert rows_of(m.review_agg(reviews)) == [("a", 5)]


def test_first_primary_and_listed_payment_types(spark):
    payments = table(
        spark,
        "payments",
        dict(order_id="a", payment_sequential=2, payment_type="credit_card", payment_value=90, payment_installments=3),
        dict(order_id="a", payment_sequential=1, payment_type="voucher", payment_value=5, payment_installments=1),
        dict(order_id="b", payment_sequential=2, payment_type="boleto", payment_value=7, payment_installments=1),
        dict(order_id="b", payment_sequential=1, payment_type="voucher", payment_value=7, payment_installments=1),
    )
    assert dict(rows_of(m.first_payment(payments))) == {"a": "voucher", "b": "voucher"}
    assert dict(rows_of(m.primary_payment(payments))) == {"a": "credit_card", "b": "voucher"}
    listed = dict(rows_of(m.payment_types(payments), "order_id", "payment_types"))
    assert listed == {"a": "credit_card, voucher", "b": "boleto, voucher"}


def test_zero_price_gives_no_ratio_but_keeps_the_row(spark):
    t = build(
        spark,
        [order("a")],
        order_items=[dict(order_id="a", order_item_id=1, product_id="x", price=0, freight_value=2)],
    )
    row = one(m.order_mart(t, columns=["order_id", "freight_ratio", "price_per_item"]))
    assert row == {"order_id": "a", "freight_ratio": None, "price_per_item": 0.0}


def test_untranslated_and_missing_categories(spark):
    t = tables(
        spark,
        products=[
            dict(product_id="1", product_category_name="bebes"),
            dict(product_id="2", product_category_name="sem_nome"),
            dict(product_id="3"),
        ],
        category_translation=[dict(product_category_name="bebes", product_category_name_english="baby")],
    )
    found = dict(rows_of(m.products_enriched(t), "product_id", "product_category_name_english"))
    assert found == {"1": "baby", "2": "uncategorized", "3": "uncategorized"}


def test_cutoff_is_exclusive(spark):
    t = build(
        spark, [order("a", bought="2018-08-31 23:59:59"), order("b", bought="2018-09-01 00:00:00")]
    )
    assert rows_of(m.order_mart(t, m.DEFAULT_CUTOFF, ["order_id"])) == [("a",)]


def test_first_item_ties_go_to_the_lowest_product(spark):
    items = table(
        spark,
        "order_items",
        dict(order_id="a", order_item_id=1, product_id="z", price=1, freight_value=0),
        dict(order_id="a", order_item_id=1, product_id="b", price=2, freight_value=0),
        dict(order_id="a", order_item_id=2, product_id="a", price=3, freight_value=0),
    )
    assert rows_of(m.first_item(items), "product_id") == [("b",)]


def test_group_tail_breaks_ties_by_name_and_sends_nulls_to_other(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "cat string")
    grouped = m.group_tail(df, "cat", 2)
    assert sorted(rows_of(grouped, "category_grouped")) == [("a",), ("c",), ("c",), ("other",), ("other",)]


def test_month_label_of_reviews(spark):
    t = build(
        spark,
        [order("a")],
        reviews=[dict(review_id="r", order_id="a", review_score=4, review_creation_date="2017-11-25 00:00:00")],
    )
    assert rows_of(m.review_monthly(t), "month_year", "review_score") == [("NOV '17", 4)]


def test_mart_has_one_row_per_order_and_the_cutoff_drops_only_later_ones(star):
    every = star["orders"].count()
    assert m.order_mart(star).count() == every
    kept = m.before_cutoff(star["orders"], "2001-08-01").count()
    assert m.order_mart(star, "2001-08-01").count() == kept < every
