"""Declared schemas of the seven tables, with their keys and references."""

from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "str": StringType(),
    "int": IntegerType(),
    "ts": TimestampNTZType(),
    "money": DecimalType(10, 2),
}


def _schema(*columns: str) -> StructType:
    fields = []
    for column in columns:
        name, kind = column.split(":")
        fields.append(StructField(name, _TYPES[kind], True))
    return StructType(fields)


SCHEMAS = {
    "customers": _schema(
        "customer_id:str",
        "customer_unique_id:str",
        "customer_zip_code_prefix:str",
        "customer_city:str",
        "customer_state:str",
    ),
    "orders": _schema(
        "order_id:str",
        "customer_id:str",
        "order_status:str",
        "order_purchase_timestamp:ts",
        "order_approved_at:ts",
        "order_delivered_carrier_date:ts",
        "order_delivered_customer_date:ts",
        "order_estimated_delivery_date:ts",
    ),
    "order_items": _schema(
        "order_id:str",
        "order_item_id:int",
        "product_id:str",
        "seller_id:str",
        "shipping_limit_date:ts",
        "price:money",
        "freight_value:money",
    ),
    "payments": _schema(
        "order_id:str",
        "payment_sequential:int",
        "payment_type:str",
        "payment_installments:int",
        "payment_value:money",
    ),
    "reviews": _schema(
        "review_id:str",
        "order_id:str",
        "review_score:int",
        "review_comment_title:str",
        "review_comment_message:str",
        "review_creation_date:ts",
        "review_answer_timestamp:ts",
    ),
    "products": _schema(
        "product_id:str",
        "product_category_name:str",
        "product_name_lenght:int",
        "product_description_lenght:int",
        "product_photos_qty:int",
        "product_weight_g:int",
        "product_length_cm:int",
        "product_height_cm:int",
        "product_width_cm:int",
    ),
    "category_translation": _schema(
        "product_category_name:str",
        "product_category_name_english:str",
    ),
}

TABLES = tuple(SCHEMAS)

# Spark does not enforce keys, so the audit checks them.
SINGLE_KEYS = (
    ("customers", "customer_id"),
    ("orders", "order_id"),
    ("products", "product_id"),
    ("category_translation", "product_category_name"),
    ("reviews", "review_id"),
)
COMPOSITE_KEYS = (
    ("order_items", ("order_id", "order_item_id")),
    ("payments", ("order_id", "payment_sequential")),
    ("reviews", ("review_id", "order_id")),
)
REFERENCES = (
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("payments", "order_id", "orders"),
    ("reviews", "order_id", "orders"),
)

# Category translations missing from the published data set.
TRANSLATION_FIXES = (
    ("pc_gamer", "gaming_computers"),
    ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_appliances"),
)
