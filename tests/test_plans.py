"""What the physical plans must and must not contain."""

import pytest

from storelens.operators import customers, diagnostic, kpi
from storelens.operators.mart import order_mart
from storelens.sources import files


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    files.write_tables(star, folder)
    return files.read_parquet_tables(spark, folder)


def test_cutoff_and_columns_reach_the_scan(stored):
    plan = plan_of(order_mart(stored, "2001-08-01", ["order_id", "order_status"]))
    assert "LessThan(order_purchase_timestamp,2001-08-01" in plan
    assert "order_approved_at" not in plan and plan.count("FileScan") == 1


def test_joins_without_wanted_columns_are_not_made(stored):
    def scans(function):
        return plan_of(function(order_mart(stored, None, function.columns))).count("FileScan")

    assert scans(kpi.kpi_on_time) == 1
    assert scans(diagnostic.late_vs_review) == 2
    assert scans(kpi.kpi_repeat_rate) == 2


def test_customer_analyses_have_no_single_task_window(stored):
    for function in (customers.rfm_base, customers.clv, customers.cohort_counts, diagnostic.first_order_compare):
        plan = plan_of(function(order_mart(stored, None, function.columns)))
        assert "Window" not in plan
    # Tiles compare each customer with the boundary rows: no window, and nothing joined back.
    base = customers.rfm_base(order_mart(stored, None, customers.rfm_base.columns))
    plan = plan_of(customers.rfm_ntile(base))
    assert "Window" not in plan and plan.count("Join") == plan_of(base).count("Join")


def test_headline_kpis_take_one_pass(stored):
    plan = plan_of(kpi.kpi_headline(order_mart(stored, None, kpi.kpi_headline.columns)))
    assert plan.count("FileScan") == 4
    assert "Expand" not in plan
