import random
from decimal import Decimal

import numpy as np
import pytest
from builders import one, rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from storelens.functions.exprs import bin_fixed
from storelens.operators import customers
from storelens.operators import ranking as r
from storelens.session import stored


@pytest.fixture(scope="module")
def heavy(spark):
    """5,000 rows of which most share one value, with a string tie-break."""
    rng = random.Random(7)
    data = [(f"id{i:05d}", 1 if rng.random() < 0.9 else rng.randint(2, 40)) for i in range(5000)]
    return spark.createDataFrame(data, "id string, v int").repartition(5).cache()


@pytest.mark.parametrize("buckets", [1, 2, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_rank_and_ntile_equal_the_global_window(heavy, buckets, descending):
    order = F.col("v").desc() if descending else F.col("v").asc()
    window = Window.orderBy(order, "id")
    expected = {
        x["id"]: (x["rn"], x["t5"], x["t7"])
        for x in heavy.select(
            "id",
            F.row_number().over(window).alias("rn"),
            F.ntile(5).over(window).alias("t5"),
            F.ntile(7).over(window).alias("t7"),
        ).collect()
    }
    ranked = r.global_rank(heavy, [order], "id", buckets)
    rn, n = F.col("rn"), F.col("n")
    found = {
        x["id"]: (x["rn"], x["t5"], x["t7"])
        for x in ranked.select("id", "rn", r.ntile_of(rn, n, 5).alias("t5"), r.ntile_of(rn, n, 7).alias("t7")).collect()
    }
    assert found == expected


def test_heavy_value_is_spread_over_buckets(heavy):
    stored = r._range_stored(heavy, [F.col("v"), F.col("id")], 50)
    sizes = [x["count"] for x in stored.groupBy("_bucket").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 5000 / 10


def test_ntile_sizes_and_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "id int")
    tiles = r.ntiles(df, {"t": ("id", False)}, "id", 5)
    assert [c for _, c in sorted(rows_of(tiles.groupBy("t").count()))] == [2, 2, 1, 1, 1]
    few = r.ntiles(df.filter("id < 3"), {"t": ("id", False)}, "id", 5)
    assert sorted(rows_of(few)) == [(0, 1), (1, 2), (2, 3)]
    assert r.ntiles(df.limit(0), {"t": ("id", False)}, "id", 5).collect() == []


@pytest.mark.parametrize("buckets", [1, 2, 50])
def test_ntiles_of_several_columns_equal_the_global_windows(spark, buckets):
    rng = random.Random(11)
    data = [(f"id{i:05d}", rng.randint(0, 3), rng.random() * 1e6, None if i % 9 == 0 else i % 4) for i in range(3001)]
    df = spark.createDataFrame(data, "id string, a int, b double, c int").repartition(6)
    over = lambda *order: F.ntile(5).over(Window.orderBy(*order))
    want = df.select("id", over(F.col("a").desc(), "id").alias("x"), over(F.col("b"), "id").alias("y"))
    kept = df.filter("c IS NOT NULL").select("id", over(F.col("c"), "id").alias("z"))
    expected = sorted(rows_of(want.join(kept, "id", "left"), "id", "x", "y", "z"), key=str)
    found = r.ntiles(df, {"x": ("a", True), "y": ("b", False), "z": ("c", False)}, "id", 5, buckets)
    assert sorted(rows_of(found, "id", "x", "y", "z"), key=str) == expected


def test_ntiles_store_one_narrow_table_and_join_nothing(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("a"), F.lit("wide").alias("w"))
    with stored(spark) as own:
        plan = r.ntiles(df, {"x": ("a", True), "y": ("id", False)}, "id", 4)._jdf.queryExecution().executedPlan().toString()
        assert own.tables == 1 and "Join" not in plan and "Exchange" not in plan
        assert spark.read.parquet(f"{own.folder}/0").columns == ["c", "value", "id", "rows", "_pos"]


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_quantiles_of_several_columns(spark, buckets):
    rng = random.Random(12)
    data = [(rng.randint(0, 5), rng.random(), None if i % 3 else float(i), None) for i in range(997)]
    df = spark.createDataFrame(data, "a int, b double, c double, d double")
    probabilities = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    with stored(spark) as own:
        found = r.quantiles_of(df, ["a", "b", "c", "d"], probabilities, buckets)
        assert own.tables == 1
    for i, name in enumerate("abc"):
        assert found[name] == pytest.approx(list(np.quantile([x[i] for x in data if x[i] is not None], probabilities)))
    assert found["d"] == [None] * 6


@pytest.mark.parametrize("buckets", [1, 2, 50])
def test_quantiles_equal_linear_interpolation(heavy, buckets):
    values = [x["v"] for x in heavy.collect()]
    probabilities = [0.0, 0.2, 0.25, 0.5, 0.9, 0.95, 0.999, 1.0]
    found = r.quantiles(heavy, "v", probabilities, buckets)
    assert found == pytest.approx(list(np.quantile(values, probabilities)))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert r.quantiles(empty, "v", [0.5]) == [None]


@pytest.mark.parametrize("buckets", [1, 2, 50])
def test_cumulative_values_equal_the_range_window(heavy, buckets):
    window = Window.orderBy(F.col("v").desc())
    expected = {
        (x["v"], x["c"], x["s"])
        for x in heavy.select("v", F.count("*").over(window).alias("c"), F.sum("v").over(window).alias("s")).collect()
    }
    found = set(rows_of(r.cumulative_values(heavy, "v", True, buckets), "value", "cum_rows", "cum_sum"))
    assert found == expected


def test_qcut_merges_bins_that_coincide(spark):
    same = spark.createDataFrame([(i, 3.0) for i in range(10)], "id int, v double")
    assert {x["s"] for x in r.qcut(same, "v", 5, "s").collect()} == {1}
    spread = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "id int, v double")
    up = [x["s"] for x in r.qcut(spread, "v", 5, "s").orderBy("id").collect()]
    down = [x["s"] for x in r.qcut(spread, "v", 5, "s", descending=True).orderBy("id").collect()]
    assert up == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and down == up[::-1]


def test_fixed_bins_leave_outside_values_null(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 100, 101, 5000)], "f int")
    scored = df.select(bin_fixed(F.col("f"), customers.FREQUENCY_EDGES, customers.FREQUENCY_SCORES).alias("s"))
    assert [x["s"] for x in scored.collect()] == [None, 1, 3, 5, 5, 5, 5]


def test_moving_means(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "m int, v double")
    five = r.centred_mean(F.col("v"), F.col("m"), 2, 2)
    three = r.centred_mean(F.col("v"), F.col("m"), 1, 1, full_frames_only=True)
    rows = df.select(five.alias("a"), three.alias("b")).collect()
    assert [x["a"] for x in rows] == [2.0, 2.5, 3.0, 3.5, 4.0]
    assert [x["b"] for x in rows] == [None, 2.0, 3.0, 4.0, None]


def test_pareto_counts_ties_together(spark):
    df = spark.createDataFrame(
        [("a", Decimal("10")), ("b", Decimal("10")), ("c", Decimal("5"))], "k string, v decimal(10,2)"
    )
    assert [x["cumulative_pct"] for x in customers.pareto(df, "k", "v").collect()] == [80.0, 80.0, 100.0]


def test_pareto_cutoff_includes_rows_tied_at_the_edge(spark):
    values = [Decimal(v) for v in (9, 5, 5, 5, 1, 1, 1, 1, 1, 1)]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(10,2)")
    assert one(customers.pareto_cutoff(df, "v", 20, buckets=3)) == {
        "cumulative_pct": 80.0,
        "cumulative_customer_pct": 20.0,
    }
    assert customers.pareto_cutoff(df, "v", 5).collect() == []
