"""Small canonical tables for hand-made cases."""

from datetime import datetime
from decimal import Decimal

from storelens.sources.schemas import SCHEMAS


def _value(kind, value):
    if value is None:
        return None
    if kind == "timestamp_ntz" and isinstance(value, str):
        return datetime.fromisoformat(value)
    if kind.startswith("decimal"):
        return Decimal(str(value))
    return value


def table(spark, name, *rows):
    """Rows given as dictionaries; columns left out are null."""
    schema = SCHEMAS[name]
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    data = [tuple(_value(kinds[c], row.get(c)) for c in schema.names) for row in rows]
    return spark.createDataFrame(data, schema)


def tables(spark, **rows):
    return {name: table(spark, name, *rows.get(name, ())) for name in SCHEMAS}


def order(order_id, person="p1", status="delivered", bought="2017-11-20 10:00:00", delivered=None, estimated=None, **more):
    """An order row and its customer row."""
    return (
        dict(
            order_id=order_id,
            customer_id=f"c-{order_id}",
            order_status=status,
            order_purchase_timestamp=bought,
            order_delivered_customer_date=delivered,
            order_estimated_delivery_date=estimated or "2017-12-01 00:00:00",
            **more,
        ),
        dict(customer_id=f"c-{order_id}", customer_unique_id=person, customer_state="SP", customer_city="x"),
    )


def rows_of(df, *columns):
    columns = columns or df.columns
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(df):
    (row,) = df.collect()
    return row.asDict()
