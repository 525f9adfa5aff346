import math
from datetime import datetime

import numpy as np
import pytest
from builders import one, order, rows_of, tables
from pyspark.sql import functions as F

from storelens.operators import customers, descriptive, diagnostic, kpi, stats
from storelens.operators import mart as m


def test_first_order_is_a_real_row_and_ties_go_to_the_lower_id(spark):
    rows = [
        ("p1", "b", datetime(2017, 1, 1), 1, -5),
        ("p1", "a", datetime(2017, 1, 1), None, -3),
        ("p1", "c", datetime(2017, 2, 1), 4, 0),
        ("p2", "d", datetime(2017, 1, 5), 5, 2),
    ]
    mart = spark.createDataFrame(
        rows,
        "customer_unique_id string, order_id string, order_purchase_timestamp timestamp_ntz, "
        "review_score int, delivery_delay_days int",
    )
    found = {x["customer_type"]: x.asDict() for x in diagnostic.first_order_compare(mart).collect()}
    assert found["Repeat"]["avg_first_review"] is None and found["Repeat"]["avg_first_delay"] == -3.0
    assert found["One-Time"]["avg_first_review"] == 5.0 and found["One-Time"]["customers"] == 1


def test_segment_rules(spark):
    pairs = [(5, 5), (4, 3), (2, 5), (2, 1), (3, 5), (2, 3)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r_score int, f_score int")
    found = [x["rfm_segment"] for x in customers.rfm_segments(df).orderBy("i").collect()]
    # Segments need a score below 3 on both sides to be lost; 3 is neither loyal nor lost.
    assert found == ["Champions", "New/Promising", "At-Risk Loyal", "Lost/Churned", "Regular", "Regular"]


def test_cohort_month_counts_calendar_boundaries(spark):
    rows = [("p", datetime(2017, 11, 30)), ("p", datetime(2017, 12, 1)), ("p", datetime(2017, 12, 9)), ("q", datetime(2017, 11, 2))]
    mart = spark.createDataFrame(rows, "customer_unique_id string, order_purchase_timestamp timestamp_ntz")
    assert rows_of(customers.cohort_counts(mart)) == [("2017-11", 0, 2), ("2017-11", 1, 1)]
    assert [x["retention_pct"] for x in customers.cohort_retention(mart).collect()] == [100.0, 50.0]
    assert rows_of(customers.retention_curve(mart)) == [(1, 1, 50.0)]
    assert rows_of(customers.cohort_matrix(mart, 3)) == [("2017-11", 100.0, 50.0, None)]


def test_spearman_uses_average_ranks(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 5), (4, 2)], "a int, b int")
    assert stats.spearman(df, "a", "b") == pytest.approx(0.737865, abs=1e-6)


def test_welch(spark):
    late, on_time = [1, 2, 2, 3, 1], [4, 5, 5, 3, 4, 5, 4]
    df = spark.createDataFrame([(1, v) for v in late] + [(0, v) for v in on_time], "g int, v int")
    row = one(stats.welch_ttest(df, "v", "g"))

    def parts(values):
        mean = sum(values) / len(values)
        return len(values), mean, sum((v - mean) ** 2 for v in values) / (len(values) - 1)

    (n1, m1, v1), (n0, m0, v0) = parts(late), parts(on_time)
    se = v1 / n1 + v0 / n0
    assert row["t"] == pytest.approx((m1 - m0) / math.sqrt(se), abs=1e-4)
    assert row["dof"] == pytest.approx(se**2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), abs=1e-4)


def test_welch_p_value_comes_from_unrounded_statistics(spark):
    """Where rounding mean and variance to four places moves p: against a plain integral of the density."""
    rng = np.random.default_rng(5)
    rows = [(1, float(x)) for x in rng.integers(1, 6, 413)] + [(0, float(x)) for x in rng.integers(1, 6, 1074)]
    row = one(stats.welch_ttest(spark.createDataFrame(rows, "g int, v double"), "v", "g"))
    a, b = (np.array([v for g, v in rows if g == code]) for code in (1, 0))
    sa, sb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    t = (a.mean() - b.mean()) / math.sqrt(sa + sb)
    dof = (sa + sb) ** 2 / (sa**2 / (len(a) - 1) + sb**2 / (len(b) - 1))
    x = np.linspace(0.0, 60.0, 2_000_001)
    density = np.exp(-(dof + 1) / 2 * np.log1p(x * x / dof))
    assert row["t"] == round(t, 4) and row["dof"] == round(dof, 4)
    assert row["p_value"] == round(density[x >= abs(t)].sum() / density.sum(), 4)


@pytest.mark.parametrize(
    ("t", "dof", "p"), [(0.0, 5, 1.0), (2.571, 5, 0.05), (12.706, 1, 0.05), (1.96, 1e7, 0.05), (3.169, 10, 0.01)]
)
def test_t_distribution_tail(spark, t, dof, p):
    rows = spark.createDataFrame([(t, float(dof)), (-t, float(dof)), (None, float(dof)), (t, None)], "t double, dof double")
    found = [r["p"] for r in rows.select(stats.t_two_sided_p(F.col("t"), F.col("dof")).alias("p")).collect()]
    assert found[:2] == pytest.approx([p, p], abs=2e-4) and found[2:] == [None, None]


def test_histogram_keeps_what_lies_outside(spark):
    df = spark.createDataFrame([(float(v),) for v in (-61, -60, 0, 39.9, 40, 41)], "x double")
    counts = dict(rows_of(stats.histogram(df, "x", -60, 40, 10), "bin", "rows"))
    assert counts == {0: 1, 1: 1, 7: 1, 10: 2, 11: 1}


def test_correlation_matrix_is_symmetric(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 1.0), (3.0, 6.0, 2.0), (None, 1.0, 1.0)], "a double, b double, c double")
    r = {(x["a"], x["b"]): x["r"] for x in stats.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(r) == 9 and r["a", "b"] == 1.0 and r["a", "c"] == r["c", "a"] == -0.5 and r["c", "c"] == 1.0


def test_installments_by_pairs_match_the_joined_rows(star):
    joined = (
        star["payments"]
        .join(star["orders"], "order_id")
        .join(star["order_items"], "order_id")
        .groupBy("payment_installments")
        .agg(
            F.round(F.sum(F.col("price") + F.col("freight_value")).cast("double") / F.count("*"), 4).alias("v"),
            F.round(F.avg((F.col("order_status") == "canceled").cast("int")) * 100, 4).alias("c"),
        )
    )
    found = {x[0]: x[1:] for x in rows_of(diagnostic.installments_items(star))}
    assert found == {x[0]: x[1:] for x in rows_of(joined)}


def test_late_and_on_time_rows_exist_without_data(spark):
    mart = spark.createDataFrame([], "is_late int, review_score int, is_low_review int")
    assert sorted(rows_of(diagnostic.late_vs_review(mart), "delivery_status", "orders")) == [("Late", None), ("On-Time", None)]


def test_voucher_flag_needs_one_voucher_order(spark):
    rows = [("p", "voucher"), ("p", "boleto"), ("q", None), ("r", "boleto")]
    mart = spark.createDataFrame(rows, "customer_unique_id string, payment_type string")
    assert rows_of(customers.voucher_effect(mart)) == [(0, 2, 0.0), (1, 1, 100.0)]


def test_invariants(star):
    mart = m.order_mart(star, "2001-08-01").cache()
    head = one(kpi.kpi_headline(mart))
    assert head["on_time_rate_pct"] + head["late_rate_pct"] == pytest.approx(100, abs=1e-3)
    assert head["total_orders"] == mart.count()
    shares = [x["pct_of_total"] for x in descriptive.score_distribution(mart).collect()]
    assert sum(shares) == pytest.approx(100, abs=1e-2)
    assert customers.pareto_state(mart).collect()[-1]["cumulative_pct"] == 100.0
    assert {x["retention_pct"] for x in customers.cohort_retention(mart).filter("month_number = 0").collect()} == {100.0}
    rfm = customers.rfm_base(mart)
    summary = customers.rfm_summary(customers.rfm_segments(customers.rfm_quantile(rfm)))
    assert sum(x["customers"] for x in summary.collect()) == rfm.count()
    week = descriptive.by_weekday(mart).collect()
    assert len(week) == 7 and sum(x["orders"] for x in week) == head["total_orders"]
    mart.unpersist()


def test_recency_by_elapsed_days(spark):
    rows = [("p", datetime(2017, 1, 1, 23), 1), ("q", datetime(2017, 1, 3, 1), 1)]
    mart = spark.createDataFrame(rows, "customer_unique_id string, order_purchase_timestamp timestamp_ntz, order_revenue int")
    boundary = dict(rows_of(customers.rfm_base(mart), "customer_unique_id", "recency_days"))
    floor = dict(rows_of(customers.rfm_base(mart, "floor"), "customer_unique_id", "recency_days"))
    assert boundary == {"p": 2, "q": 0} and floor == {"p": 1, "q": 0}


def test_customers_without_revenue_have_no_rfm_but_have_a_value_row(spark):
    o1, c1 = order("a", "p")
    t = tables(spark, orders=[o1], customers=[c1])
    mart = m.order_mart(t)
    assert customers.rfm_base(mart).count() == 0
    assert one(customers.clv(mart))["lifetime_revenue"] is None
