"""Label, roll-up, joins and features on hand-made rows."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lagline.functions.calendar import days_between, monday_first_weekday
from lagline.operators import joins, orders as ops
from lagline.schemas import FEATURES, ITEMS_SCHEMA, ORDERS_SCHEMA

from .conftest import rows

PROMISE = datetime(2018, 3, 10, 12)


def order(spark, *entries):
    """Orders from (id, status, approved, delivered, promised)."""
    data = [
        (key, f"c{key}", status, PROMISE - timedelta(days=9), approved, None, delivered, promised)
        for key, status, approved, delivered, promised in entries
    ]
    return spark.createDataFrame(data, ORDERS_SCHEMA)


def item(spark, *entries):
    data = [(o, n, None, s, None, p and Decimal(p), f and Decimal(f)) for o, n, s, p, f in entries]
    return spark.createDataFrame(data, ITEMS_SCHEMA)


def test_delivery_at_the_promised_instant_is_on_time(spark):
    data = order(
        spark,
        ("same", "delivered", PROMISE, PROMISE, PROMISE),
        ("later", "delivered", PROMISE, PROMISE + timedelta(microseconds=1), PROMISE),
    )
    labelled = ops.create_target(data).select("order_id", "is_late")
    assert rows(labelled, "order_id") == [("later", 1), ("same", 0)]


def test_orders_without_a_known_outcome_are_left_out(spark):
    data = order(
        spark,
        ("kept", "delivered", PROMISE, PROMISE, PROMISE),
        ("no_approval", "delivered", None, PROMISE, PROMISE),
        ("no_delivery", "delivered", PROMISE, None, PROMISE),
        ("no_promise", "delivered", PROMISE, PROMISE, None),
        ("not_delivered", "shipped", PROMISE, PROMISE, PROMISE),
    )
    assert [r["order_id"] for r in ops.create_target(data).collect()] == ["kept"]


def test_rollup_counts_items_sellers_and_money(spark):
    data = item(
        spark,
        ("a", 1, "s1", "10.10", "1.05"),
        ("a", 2, "s1", "20.20", "2.10"),
        ("a", 3, "s2", "0.03", "0.01"),
        ("b", 1, None, None, "4.00"),
    )
    assert rows(ops.aggregate_items(data), "order_id") == [
        ("a", 3, 2, Decimal("30.33"), Decimal("3.16")),
        ("b", 1, 0, None, Decimal("4.00")),
    ]


def test_left_joins_keep_every_order(spark):
    data = order(
        spark,
        ("with", "delivered", PROMISE, PROMISE, PROMISE),
        ("without", "delivered", PROMISE, PROMISE, PROMISE),
    )
    customers = spark.createDataFrame(
        [("cwith", "u", "1", "Recife", "PE")],
        "customer_id string, customer_unique_id string, zip string, customer_city string, customer_state string",
    )
    built = ops.create_dataset(data, item(spark, ("with", 1, "s", "5.00", "1.00")), customers)
    found = rows(built.select("order_id", "item_count", "customer_state"), "order_id")
    assert found == [("with", 1, "PE"), ("without", None, None)]
    assert "zip" not in built.columns


def test_cardinality_violations_name_side_and_key(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    right = spark.createDataFrame([("b", 1), ("b", 2), ("c", 3)], "k string, v int")
    found = rows(joins.cardinality_violations(left, right, "k", "one_to_one"), "side")
    assert found == [("left", "a", 2), ("right", "b", 2)]
    assert joins.cardinality_violations(left, right, "k", "many_to_many").count() == 0
    with pytest.raises(ValueError, match="many_to_one"):
        joins.checked_join(left, right, "k", validate="many_to_one")
    with pytest.raises(ValueError, match="validate"):
        joins.checked_join(left, right, "k", validate="sometimes")


def test_checked_join_returns_the_join(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3)], "k string, n int")
    right = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    joined = joins.checked_join(left, right, "k", "left", "many_to_one")
    assert rows(joined, "n") == [("a", 1, "x"), ("a", 2, "x"), ("z", 3, None)]


def test_weekdays_start_on_monday(spark):
    days = spark.createDataFrame(
        [(datetime(2018, 1, 1) + timedelta(days=i),) for i in range(7)], "t timestamp_ntz"
    )
    found = days.orderBy("t").select(monday_first_weekday("t")).collect()
    assert [r[0] for r in found] == [0, 1, 2, 3, 4, 5, 6]


def test_features_at_the_edges_of_day_and_year(spark):
    data = order(spark, ("x", "delivered", PROMISE, PROMISE, PROMISE)).drop(
        "order_purchase_timestamp"
    )
    moments = [datetime(2017, 12, 31, 23, 59), datetime(2018, 1, 1, 0, 0)]
    built = [
        ops.create_features(data.withColumn("order_purchase_timestamp", F.lit(m).cast("timestamp_ntz")))
        .select("purchase_month", "purchase_weekday", "purchase_hour")
        .first()
        for m in moments
    ]
    assert [tuple(r) for r in built] == [(12, 6, 23), (1, 0, 0)]


def test_promised_days_ignore_daylight_saving(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        # Midnight of 4 November 2018 did not exist there.
        frame = spark.sql(
            "SELECT timestamp_ntz'2018-11-03 12:00:00' a, timestamp_ntz'2018-11-04 00:30:00' b"
        )
        assert frame.select(days_between("a", "b")).first()[0] == 12.5 / 24
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_model_input_has_key_features_and_target(spark, sf_dir):
    from lagline.plans.catalog import QUERIES

    data = QUERIES["model_input"](spark, sf_dir)
    assert data.columns == ["order_id", *FEATURES, "is_late"]
    assert dict(data.dtypes)["total_price"] == "double"
