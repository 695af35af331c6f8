"""Declared table schemas and the column lists the model relies on."""

from __future__ import annotations

from pyspark.sql import types as T

# Table layouts and names that results must share with existing data.
ORDERS_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_status", T.StringType()),
        T.StructField("order_purchase_timestamp", T.TimestampNTZType()),
        T.StructField("order_approved_at", T.TimestampNTZType()),
        T.StructField("order_delivered_carrier_date", T.TimestampNTZType()),
        T.StructField("order_delivered_customer_date", T.TimestampNTZType()),
        T.StructField("order_estimated_delivery_date", T.TimestampNTZType()),
    ]
)

ITEMS_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("order_item_id", T.IntegerType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("seller_id", T.StringType()),
        T.StructField("shipping_limit_date", T.TimestampNTZType()),
        T.StructField("price", T.DecimalType(12, 2)),
        T.StructField("freight_value", T.DecimalType(12, 2)),
    ]
)

CUSTOMERS_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_unique_id", T.StringType()),
        T.StructField("customer_zip_code_prefix", T.StringType()),
        T.StructField("customer_city", T.StringType()),
        T.StructField("customer_state", T.StringType()),
    ]
)

CATEGORY_SCHEMA = T.StructType(
    [
        T.StructField("product_category_name", T.StringType()),
        T.StructField("product_category_name_english", T.StringType()),
    ]
)

ORDER_STATUSES = [
    "delivered",
    "shipped",
    "canceled",
    "unavailable",
    "invoiced",
    "processing",
    "created",
    "approved",
]

NUMERIC_FEATURES = [
    "promised_days",
    "item_count",
    "seller_count",
    "total_price",
    "total_freight",
]

CATEGORICAL_FEATURES = [
    "purchase_month",
    "purchase_weekday",
    "purchase_hour",
    "customer_state",
]

FEATURES = [
    "purchase_hour",
    "purchase_weekday",
    "purchase_month",
    "promised_days",
    "item_count",
    "seller_count",
    "total_price",
    "total_freight",
    "customer_state",
]

ORDER_KEY = "order_id"
TARGET = "is_late"
SCORE = "probability_positive"
