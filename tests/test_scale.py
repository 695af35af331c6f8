"""Plans and results under one key that holds a third of all rows."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lagline.operators import metrics, orders as ops, rates, sampling, sets
from lagline.operators.joins import repeated_keys

from .conftest import rows

ROWS = 30_000


@contextmanager
def settings(spark, **values):
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture(scope="module")
def hot(spark):
    """Orders of which a third belong to customer 0."""
    customer = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000)
    return spark.range(ROWS).select(
        F.col("id").alias("order_id"),
        customer.alias("customer_id"),
        (F.col("id") % 5 == 0).cast("int").alias("is_late"),
        F.repeat(F.lit("x"), 50).alias("payload"),
    )


@pytest.fixture(scope="module")
def customers(spark):
    return spark.range(5000).select(
        F.col("id").alias("customer_id"),
        F.lit("city").alias("customer_city"),
        (F.col("id") % 7).cast("string").alias("customer_state"),
    )


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hot_customer_is_split_over_tasks(spark, hot, customers):
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="4KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4KB",
    ):
        joined = ops.join_customers(hot.repartition(8, "order_id"), customers)
        assert "skew=true" in final_plan(joined)
        assert joined.count() == ROWS


def test_small_customers_are_broadcast_without_a_hint(hot, customers):
    assert "BroadcastHashJoin" in final_plan(ops.join_customers(hot, customers))


def test_large_customers_are_not_broadcast(spark, hot, customers):
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="1KB",
        spark__sql__adaptive__autoBroadcastJoinThreshold="1KB",
    ):
        plan = final_plan(ops.join_customers(hot, customers))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_counts_combine_before_the_shuffle(hot, customers):
    for frame in (
        rates.rate_by(ops.join_customers(hot, customers), "customer_state"),
        repeated_keys(hot, ["customer_id"]),
        sets.except_distinct(hot.select("customer_id"), hot.filter("order_id = 0").select("customer_id")),
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.index("HashAggregate") < plan.index("Exchange hashpartitioning")
        assert plan.count("HashAggregate") >= 2


def test_one_order_with_a_third_of_all_items(spark):
    order = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
    items = spark.range(ROWS).select(
        order.alias("order_id"),
        F.col("id").alias("order_item_id"),
        (F.col("id") % 101).alias("seller_id"),
        F.lit("1.50").cast("decimal(12,2)").alias("price"),
        F.lit("0.25").cast("decimal(12,2)").alias("freight_value"),
    )
    rollup = ops.aggregate_items(items)
    row = rollup.filter("order_id = -1").first()
    assert (row["item_count"], row["seller_count"]) == (ROWS // 3, 101)
    assert float(row["total_price"]) == ROWS // 3 * 1.5
    plan = rollup._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_id" in plan and ", seller_id" in plan


def test_one_score_with_a_third_of_all_rows(spark):
    score = F.when(F.col("id") % 3 == 0, 0.3).otherwise((F.col("id") * 7919 % 10007) / 10007)
    data = spark.range(ROWS).select(
        score.alias("probability_positive"), (F.col("id") % 4 == 0).cast("int").alias("is_late")
    )
    few, many = (metrics.roc_auc(data, ranges=n).first()[0] for n in (2, 64))
    assert few == many


def test_one_class_with_almost_all_rows(spark, hot):
    data = hot.withColumn("is_late", (F.col("order_id") < 3).cast("int"))
    sample, rest = sampling.stratified_parts(data, size=10_000)
    assert rows(sample.groupBy("is_late").count(), "is_late") == [(0, 9_999), (1, 1)]
    assert rest.count() == ROWS - 10_000


def test_the_main_pass_of_a_sample_does_not_shuffle(hot):
    sample, _ = sampling.stratified_parts(hot, size=1_000)
    assert "hashpartitioning" not in final_plan(sample)


def test_rollup_partitioning_serves_the_join(spark, hot):
    stored = hot.repartition(3)
    items = stored.select(
        "order_id",
        F.col("order_id").alias("order_item_id"),
        F.col("customer_id").alias("seller_id"),
        F.lit(1).cast("decimal(12,2)").alias("price"),
        F.lit(1).cast("decimal(12,2)").alias("freight_value"),
    )
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = ops.join_items(stored, ops.aggregate_items(items))
        plan = plan._jdf.queryExecution().executedPlan().toString()
    # One exchange for the orders, two for the distinct count, none for the join itself.
    assert plan.count("Exchange hashpartitioning") == 3


def test_features_read_the_orders_table_once(spark, sf_dir):
    from lagline.plans.catalog import QUERIES

    plan = QUERIES["order_features"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderstatus#") and plan.count("Relation [o_orderkey") == 1
