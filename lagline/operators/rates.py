"""Late-rate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagline.functions.bins import PROMISE_EDGES, PROMISE_LABELS, right_closed_bin
from lagline.schemas import ORDER_KEY, TARGET


def rate_by(data: DataFrame, key: str, order_key: str = ORDER_KEY) -> DataFrame:
    """Late rate and order count per value of ``key``; rows without a key are left out.

    Both aggregates combine in the map tasks, so a key holding a third of all
    rows sends one partial row per task.
    """
    return _rates(data.filter(F.col(key).isNotNull()), key, order_key)


def _rates(data: DataFrame, key: str, order_key: str = ORDER_KEY) -> DataFrame:
    return data.groupBy(key).agg(
        F.avg(TARGET).alias("delay_rate"),
        F.count(order_key).alias("order_count"),
    )


def min_support(rates: DataFrame, at_least: int = 100) -> DataFrame:
    """Groups with enough orders for a stable rate."""
    return rates.filter(F.col("order_count") >= at_least)


def ranked(rates: DataFrame, key: str) -> DataFrame:
    """Highest rate first, key order among equals."""
    return rates.orderBy(F.desc("delay_rate"), F.asc(key))


def delay_by_promised_range(
    data: DataFrame,
    edges: Sequence[float] = PROMISE_EDGES,
    labels: Sequence[str] = PROMISE_LABELS,
) -> DataFrame:
    """Rates per promise length; promises outside the bins are left out.

    The promise is compared with the outer edges, so that what is pushed down is
    one plain comparison and not the whole chain of bins.
    """
    days = F.col("promised_days")
    inside = data.filter((days > F.lit(edges[0])) & (days <= F.lit(edges[-1])))
    label = right_closed_bin(days, edges, labels)
    return _rates(inside.withColumn("promised_days_range", label), "promised_days_range")


def delay_by_items(data: DataFrame) -> DataFrame:
    return rate_by(data, "item_count")


def delay_by_sellers(data: DataFrame) -> DataFrame:
    return rate_by(data, "seller_count")


def delay_by_state(data: DataFrame, at_least: int = 100) -> DataFrame:
    """Rates per state with enough orders, highest rate first."""
    return ranked(min_support(rate_by(data, "customer_state"), at_least), "customer_state")


def delay_by_month(data: DataFrame) -> DataFrame:
    return rate_by(data, "purchase_month").orderBy("purchase_month")


def cumulative_orders(rates: DataFrame, key: str) -> DataFrame:
    """Running order count by ascending key, and its share of all orders.

    For the item and seller counts of an order this window is small by
    arithmetic: n distinct counts need at least n(n+1)/2 items behind them, so
    even 10^12 items give fewer than 1.5 million groups of three numbers.
    """
    running = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(key).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return rates.withColumn(
        "order_count_cumsum", F.sum("order_count").over(running)
    ).withColumn(
        "order_count_cumsum_pct",
        F.col("order_count_cumsum") / F.sum("order_count").over(everything),
    )


def class_balance(data: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows per class, missing labels included, with each class's share."""
    counts = data.groupBy(label).agg(F.count(F.lit(1)).alias("order_count"))
    # One row per class, so the unpartitioned total is over a handful of rows.
    total = F.sum("order_count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("order_share", F.col("order_count") / total)


def majority_baseline(data: DataFrame, label: str = TARGET) -> DataFrame:
    """Accuracy of always answering "not late"."""
    return data.agg(F.avg((F.col(label) == 0).cast("int")).alias("accuracy"))


def nonpositive_promises(data: DataFrame) -> DataFrame:
    """How many promises end at or before the approval."""
    suspicious = F.sum((F.col("promised_days") <= 0).cast("bigint"))
    return data.agg(F.coalesce(suspicious, F.lit(0)).alias("nonpositive_count"))
