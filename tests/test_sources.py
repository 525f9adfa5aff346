import re
from datetime import datetime
from decimal import Decimal

import pytest
from builders import one, order, rows_of, table, tables

from storelens.operators.mart import order_mart, orders_enriched
from storelens.plans.views import register_views
from storelens.session import CachedFrame, materialize, release, shared_folder, stored
from storelens.sources import files
from storelens.sources.schemas import SCHEMAS


def write_csv(folder, **extra):
    for name, schema in SCHEMAS.items():
        lines = [",".join(schema.names), *extra.get(name, ())]
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")


def test_csv_with_quotes_newlines_and_bad_values(spark, tmp_path):
    write_csv(
        tmp_path,
        reviews=['r1,o1,5,,"line one\nsaid ""good""",2018-01-18 00:00:00,2018-01-18 21:46:59'],
        order_items=['o1,1,p1,s1,2017-09-19 09:45:35,58.90,13.29', "o2,x,p1,s1,not a time,abc,1"],
        customers=['c1,u1,"14409",franca,SP'],
    )
    t = files.read_csv_tables(spark, str(tmp_path))
    review = one(t["reviews"])
    assert review["review_comment_message"] == 'line one\nsaid "good"'
    assert review["review_comment_title"] is None and review["review_score"] == 5
    assert review["review_creation_date"] == datetime(2018, 1, 18)
    good, bad = sorted(t["order_items"].collect(), key=lambda r: r["order_id"])
    assert good["price"] == Decimal("58.90") and good["shipping_limit_date"] == datetime(2017, 9, 19, 9, 45, 35)
    assert bad["price"] is None and bad["order_item_id"] is None and bad["freight_value"] == Decimal("1.00")
    assert t["orders"].count() == 0 and one(t["customers"])["customer_zip_code_prefix"] == "14409"


def test_coercion_turns_bad_values_into_nulls(spark):
    raw = spark.createDataFrame(
        [("a", "3", "2017-01-02 03:04:05", "1.5"), ("b", "x", "soon", "")],
        "order_id string, order_item_id string, shipping_limit_date string, price string",
    )
    good, bad = files.coerce(raw, SCHEMAS["order_items"]).collect()
    assert tuple(good) == ("a", 3, datetime(2017, 1, 2, 3, 4, 5), Decimal("1.50"))
    assert tuple(bad) == ("b", None, None, None)


def test_rejected_values_are_counted_and_kept(spark):
    schema = SCHEMAS["order_items"]
    raw = spark.createDataFrame(
        [("a", "3", "2017-01-02 03:04:05", "1.5"), ("b", "x", "soon", ""), ("c", None, "later", "2,5"), ("d", " ", None, "x")],
        "order_id string, order_item_id string, shipping_limit_date string, price string",
    )
    report = {r["col"]: (r["n_values"], r["rejected"], r["example"], r["rejected_pct"]) for r in files.coercion_report(raw, schema, "order_items").collect()}
    assert report == {
        "order_id": (4, 0, None, 0.0),
        "order_item_id": (2, 1, "x", 50.0),
        "shipping_limit_date": (3, 2, "later", 66.6667),
        "price": (3, 2, "2,5", 66.6667),
    }
    lost = {r["order_id"]: [tuple(x) for x in r["rejects"]] for r in files.rejected_rows(raw, schema).collect()}
    assert lost == {
        "b": [("order_item_id", "x"), ("shipping_limit_date", "soon")],
        "c": [("shipping_limit_date", "later"), ("price", "2,5")],
        "d": [("price", "x")],
    }
    none = files.coercion_report(raw.limit(0), schema, "t").collect()
    assert {(r["n_values"], r["rejected"], r["rejected_pct"]) for r in none} == {(0, 0, None)}


def test_bad_csv_records_are_kept_as_they_are(spark, tmp_path):
    write_csv(
        tmp_path,
        order_items=['o1,1,p1,s1,2017-09-19 09:45:35,58.90,13.29', "o2,x,p1,s1,not a time,abc,1", "o3,1,p1"],
        reviews=['r1,o1,many,,"line one\nline two",2018-01-18 00:00:00,2018-01-18 21:46:59'],
    )
    bad = files.read_csv_rejects(spark, str(tmp_path))
    assert sorted(r["record"] for r in bad["order_items"].collect()) == ["o2,x,p1,s1,not a time,abc,1", "o3,1,p1"]
    assert bad["order_items"].select("record").count() == 2  # also where no other column is asked for
    assert "line two" in one(bad["reviews"])["record"] and bad["orders"].count() == 0
    assert files.read_csv_tables(spark, str(tmp_path))["order_items"].count() == 3


def test_overwrite_replaces_and_parquet_round_trips(spark, tmp_path):
    t = tables(spark, orders=[order("a")[0]], payments=[dict(order_id="a", payment_sequential=1, payment_value=3)])
    files.write_tables(t, str(tmp_path))
    files.write_tables(t, str(tmp_path))
    back = files.read_parquet_tables(spark, str(tmp_path))
    assert back["orders"].count() == 1 and back["orders"].schema == SCHEMAS["orders"]


def test_sql_results_have_lower_case_names(spark):
    assert files.read_sql(spark, "SELECT 1 AS Order_ID, 2 AS `PRICE`").columns == ["order_id", "price"]


def test_append_rows_keeps_the_schema(spark):
    base = table(spark, "category_translation", dict(product_category_name="a", product_category_name_english="A"))
    more = files.append_rows(base, [("b", "B")])
    assert sorted(rows_of(more)) == [("a", "A"), ("b", "B")] and more.columns == base.columns


def test_bucketed_tables_join_per_order_without_a_shuffle(spark, star):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    files.save_bucketed_tables(star, "shop", 4)
    saved = files.read_catalog_tables(spark, "shop")
    columns = ["order_id", "order_status", "total_price", "review_score", "total_payment"]
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = order_mart(saved, None, columns)
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert built.exceptAll(order_mart(star, None, columns)).count() == 0
        # With all columns the mart moves twice, to its products and to its customers, never to its orders.
        for whole in (order_mart(saved, None), orders_enriched(saved)):
            moved = re.findall(r"Exchange hashpartitioning\(([^,)]*)", whole._jdf.queryExecution().executedPlan().toString())
            assert moved and not any(m.startswith("order_id") for m in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_views_are_queryable(spark, star):
    names = register_views(star)
    assert {"orders_enriched", "rfm_segmentation", "cohort_retention"} <= set(names) and len(names) == 19
    query = "SELECT COUNT(*) AS N FROM orders_enriched e JOIN order_primary_payment p ON e.order_id = p.order_id"
    assert one(files.read_sql(spark, query))["n"] == star["orders"].count()
    assert one(spark.sql("SELECT total_customers FROM kpi_repeat_rate"))["total_customers"] > 0


def test_cached_frame_is_rebuilt_after_refresh_and_expiry(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    cached = CachedFrame(build, ttl_seconds=3600)
    assert cached.get().count() == 1 and cached.get().count() == 1
    cached.refresh()
    assert cached.get().count() == 2
    expired = CachedFrame(build, ttl_seconds=-1)
    first, second = expired.get(), expired.get()
    assert first is not second
    cached.refresh(), expired.refresh()


def test_materialised_tables_keep_types_and_can_be_released(spark):
    release(spark)
    df = table(spark, "order_items", dict(order_id="a", price=1, shipping_limit_date="2017-01-01 00:00:00"))
    stored = materialize(df)
    assert stored.schema == df.schema and stored.collect() == df.collect()
    assert release(spark) == 1


def test_a_block_owns_its_tables(spark):
    release(spark)
    with stored(spark) as s:
        inside = materialize(spark.range(5))
        assert inside.count() == 5 and s.tables == 1
        assert release(spark) == 0 and inside.count() == 5
    outside = materialize(spark.range(3))
    assert outside.count() == 3 and release(spark) == 1


def test_model_rows_survive_a_release(spark):
    from storelens.plans.queries import _split

    first = _split(spark, "/root/testdata/sf0.001")
    assert _split(spark, "/root/testdata/sf0.001") is first
    rows = first[0].count()
    release(spark)
    assert _split(spark, "/root/testdata/sf0.001")[0].count() == rows
    release(spark)


def test_without_a_named_folder_a_cluster_is_refused(spark, monkeypatch):
    class Named:
        sparkContext = type("C", (), {"master": "yarn", "applicationId": "x"})()
        conf = type("F", (), {"get": staticmethod(lambda name, default=None: default)})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Named())
