"""The order model derived from the driver's star-schema tables.

Those tables carry no approval or promise, so both are derived from the order
row and a hash of its key. Every expression has a counterpart in
``lagline.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagline.functions.hashing import key_hash

# Promised days per order priority, and bins wide enough for them.
PROMISE_BY_PRIORITY = {"1": 365, "2": 550, "3": 730, "4": 910, "5": 1095}
WIDE_EDGES = [0.0, 365.0, 550.0, 730.0, 910.0, float("inf")]
WIDE_LABELS = ["up to 365", "366-550", "551-730", "731-910", "over 910"]


def _scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(amount: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), amount.cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with status, purchase, approval, delivery and promise."""
    source = _scan(spark, sf_dir, "orders")
    seed = key_hash("o_orderkey")
    promise = F.create_map(
        *[F.lit(part) for pair in PROMISE_BY_PRIORITY.items() for part in pair]
    )
    days = promise[F.substring("o_orderpriority", 1, 1)]
    base = (
        source.withColumn("h", seed)
        .withColumn(
            "order_purchase_timestamp", F.col("o_orderdate") + _minutes(F.col("h") % 1440)
        )
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(F.col("o_orderstatus") == "P", "processing")
            .otherwise("delivered")
            .alias("order_status"),
            "order_purchase_timestamp",
            F.when(
                F.col("h") % 50 != 0,
                F.col("order_purchase_timestamp") + _minutes((F.col("h") % 72) * 60),
            ).alias("order_approved_at"),
            (F.col("o_orderdate") + _minutes(days * 1440)).alias(
                "order_estimated_delivery_date"
            ),
        )
    )
    # One row per order: its distinct ship days, of which there are as many as the
    # calendar has. They combine in the map tasks, so neither an order with very many
    # lines nor the join below has a hot key.
    days_shipped = (
        _scan(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(F.collect_set("l_shipdate").alias("days"))
    )
    after_purchase = F.filter("days", lambda day: day >= F.col("order_purchase_timestamp"))
    return base.join(days_shipped, "order_id", "left").select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_approved_at",
        F.array_min(after_purchase).alias("order_delivered_customer_date"),
        "order_estimated_delivery_date",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line; money is exact decimal."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    return _scan(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.alias("price"),
        (price * tax).cast("decimal(12,2)").alias("freight_value"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _scan(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        _scan(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as untyped text, with the kinds of dirt a raw feed has.

    Read straight from the orders table, so a validation run needs no join. By
    key hash: some statuses are unknown, some dates do not parse or are missing,
    some approvals come before the purchase.
    """
    h = F.col("h")
    purchase = F.col("o_orderdate") + _minutes(h % 1440)
    approved = purchase + _minutes((h % 72) * 60)
    return (
        _scan(spark, sf_dir, "orders")
        .withColumn("h", key_hash("o_orderkey"))
        .select(
            F.md5(F.col("o_orderkey").cast("string")).substr(
                F.lit(1), F.when(h % 101 == 0, 31).otherwise(32)
            ).alias("order_id"),
            F.md5(F.col("o_custkey").cast("string")).alias("customer_id"),
            F.when(h % 89 == 0, "lost")
            .when(F.col("o_orderstatus") == "P", "processing")
            .otherwise("delivered")
            .alias("order_status"),
            F.when(h % 97 != 0, purchase.cast("string")).alias("order_purchase_timestamp"),
            F.when(h % 83 == 0, "not a date")
            .when(h % 79 == 0, (purchase - _minutes(F.lit(60))).cast("string"))
            .when(h % 50 != 0, approved.cast("string"))
            .alias("order_approved_at"),
            F.when(h % 71 == 0, "soon")
            .when(h % 3 != 0, (purchase + _minutes(F.lit(4 * 1440))).cast("string"))
            .alias("order_delivered_carrier_date"),
            F.when(h % 67 == 0, "unknown")
            .when(h % 4 != 0, (purchase + _minutes(F.lit(9 * 1440))).cast("string"))
            .alias("order_delivered_customer_date"),
            F.when(h % 61 == 0, "to be set")
            .when(h % 59 != 0, (purchase + _minutes(F.lit(20 * 1440))).cast("string"))
            .alias("order_estimated_delivery_date"),
        )
    )


def closed_form_score(items_weight: int = 8, base: int = 60) -> Column:
    """A probability in whole percents, exact in any engine.

    Stands in for a fitted model where an operator downstream of one is checked
    against SQL. Integer arithmetic first, one division last.
    """
    promise = F.date_diff("order_estimated_delivery_date", "order_purchase_timestamp")
    slack = F.floor((F.lit(1095) - promise) / F.lit(20))
    percent = F.lit(base) - F.lit(items_weight) * F.col("item_count") + slack
    return F.least(F.lit(99), F.greatest(F.lit(0), percent)) / F.lit(100.0)
