"""Validation of a dirty orders table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lagline.operators import quality
from lagline.operators.quality import ORDER_RULES

from .conftest import rows

ID = "0123456789abcdef0123456789abcde"
GOOD = ("{}", "delivered", "2018-01-01 10:00:00", "2018-01-01 11:00:00")


@pytest.fixture(scope="module")
def dirty(spark):
    entries = [
        (ID + "1", ID + "a", "delivered", "2018-01-01 10:00:00", "2018-01-01 11:00:00"),
        (ID, ID + "b", "shipped", "2018-01-01 10:00:00", None),
        (ID + "2", ID + "c", "lost", "2018-01-01 10:00:00", None),
        (ID + "3", ID + "d", "approved", "2018-01-01 10:00:00", "2018-01-01 09:00:00"),
        (ID + "4", ID + "e", "created", "yesterday", None),
        (ID + "5", ID + "f", "created", None, "2018-01-01 09:00:00"),
        (ID + "6", ID + "g", "created", "2018-01-01 10:00:00", None),
        (ID + "6", ID + "h", "created", "2018-01-01 10:00:00", None),
    ]
    columns = "order_id string, customer_id string, order_status string, order_purchase_timestamp string, order_approved_at string"
    return (
        spark.createDataFrame(entries, columns)
        .withColumn("order_delivered_carrier_date", F.lit(None).cast("string"))
        .withColumn("order_delivered_customer_date", F.lit(None).cast("string"))
        .withColumn("order_estimated_delivery_date", F.lit("2018-02-01 00:00:00"))
        .withColumn("note", F.lit("extra"))
    )


def test_every_failure_is_reported_once(dirty):
    found = {(r["check"], r["column"], r["key"]) for r in quality.failures(dirty, ORDER_RULES).collect()}
    assert found == {
        ("length", "order_id", ID),
        ("allowed_values", "order_status", ID + "2"),
        ("approval_after_purchase", None, ID + "3"),
        ("type_coerce", "order_purchase_timestamp", ID + "4"),
        ("not_null", "order_purchase_timestamp", ID + "5"),
        ("approval_after_purchase", None, ID + "5"),
        ("unique", "order_id", ID + "6"),
        ("extra_column", "note", None),
    }
    assert quality.failures(dirty, ORDER_RULES).filter("check = 'unique'").count() == 2


def test_valid_rows_come_back_typed(dirty):
    valid, _ = quality.validate(dirty, ORDER_RULES)
    assert [r["order_id"] for r in valid.collect()] == [ID + "1"]
    assert dict(valid.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert "note" not in valid.columns


def test_missing_columns_are_failures_not_errors(dirty):
    narrow = dirty.select("order_id", "order_status")
    found = quality.failures(narrow, ORDER_RULES).filter("check = 'missing_column'")
    assert found.count() == 6


def test_rejected_value_is_shown(dirty):
    row = quality.row_failures(dirty, ORDER_RULES, {"type_coerce"}).first()
    assert tuple(row) == ("type_coerce", "order_purchase_timestamp", ID + "4", "yesterday")


def test_row_checks_share_one_scan(spark, sf_dir):
    from lagline.sources import adapter

    plan = quality.row_failures(adapter.raw_orders(spark, sf_dir), ORDER_RULES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_clean_table_has_no_failures(dirty):
    clean = dirty.filter(F.col("order_id") == ID + "1").drop("note")
    valid, failures = quality.validate(clean, ORDER_RULES)
    assert valid.count() == 1 and rows(failures, "check") == []
