"""Faults of the third review: work per pass of the boosting and what a pass sends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagline.operators import active, boosting, encoding, orders
from lagline.operators.boosting import _Walk
from lagline.operators.sampling import assign_folds
from lagline.plans import catalog

from .conftest import rows


@pytest.fixture(scope="module")
def encoded(spark, sf_dir):
    train, _ = catalog._split(spark, sf_dir)
    folded = assign_folds(train)
    return encoding.encoder(impute=True).fit(folded).transform(folded)


def test_a_pass_sends_one_array_to_the_driver(spark):
    """F16: every partition sent its own."""
    blocks = spark.sparkContext.parallelize(range(70), 70)
    summed = boosting._summed(blocks, lambda block: [np.array([block])])
    assert summed.getNumPartitions() == 1
    assert [int(x[0][0]) for x in summed.collect()] == [sum(range(70))]


def test_batches_join_into_blocks_and_keep_their_rows():
    """a block was an Arrow batch, however short, and held keys as Python objects."""
    sizes = [3, 0, 4, 25, 1]
    values = iter(range(sum(sizes)))
    batches = [
        pa.RecordBatch.from_pydict({"x": pa.array([next(values) for _ in range(n)], pa.int64())}) for n in sizes
    ]
    found = [batch.column(0).to_pylist() for batch in boosting._regrouped(iter(batches), 10)]
    assert [len(x) for x in found] == [10, 10, 10, 3]
    assert sum(found, []) == list(range(33))


def test_keys_stay_arrow_in_a_block(encoded):
    layout = boosting.layout_of(encoded, boosting.category_sizes(encoded))
    blocks = boosting.packed_blocks(encoded, layout, "is_late", "order_id", "fold").collect()
    assert all(isinstance(block["key"], pa.Array) for block in blocks)
    keys = sorted(key for block in blocks for key in block["key"].to_pylist())
    assert keys == sorted(row["order_id"] for row in encoded.select("order_id").collect())


def test_rows_are_dealt_only_towards_wanted_nodes():
    """every row walked the whole tree in every pass."""
    walk = _Walk(
        np.array([0, -1, 1, -1, -1]), np.array([1, 0, 2, 0, 0]), np.array([False, False, True, False, False]),
        np.array([1, 0, 3, 0, 0]), np.array([2, 0, 4, 0, 0]),
    )
    bins = np.array([[0, 1, 2, 3, 2, 9], [2, 2, 2, 1, 2, 0]], dtype=np.uint8)
    rows = np.array([0, 2, 3, 4, 5])
    assert {n: r.tolist() for n, r in walk.rows_at(bins, rows, {4})} == {4: [2, 4]}
    assert {n: r.tolist() for n, r in walk.rows_at(bins, rows)} == {1: [0], 3: [3, 5], 4: [2, 4]}


def test_counts_and_hessians_share_a_double_without_loss():
    """All rows of a full block in one cell, with the largest hessian there is."""
    n = boosting.BLOCK_ROWS
    layout = boosting.Layout(("a",), ((0.0,),), (2,), (0,))
    block = {
        "bins": np.zeros((1, n), np.uint8), "label": np.zeros(n, np.float32), "fold": np.zeros(n, np.int32),
        "hash": np.zeros(n, np.uint64), "key": None,
    }

    class Blocks:
        def __init__(self, found):
            self.found = found

        def mapPartitions(self, function):
            return Blocks(list(function(iter(self.found))))

        def getNumPartitions(self):
            return 1

        def collect(self):
            return self.found

    params = boosting.BoostingParams(iterations=1, rate=1.0, max_depth=1)
    root = _Walk(*(np.array([x]) for x in (-1, 0, False, 0, 0)))
    started = boosting._started(block, [0.0])
    found = boosting.histograms(Blocks([started, started]), layout, [boosting.Run(params)], 0, [root], [[0]])
    assert found[0][:, 0].tolist() == [[n << 24, 0], [n << 23, 0], [2 * n, 0]]


def test_buckets_follow_the_rows(spark, sf_dir, monkeypatch):
    """sixteen buckets at any size, so a task grew with the input."""
    assert catalog.bucket_count(0) == catalog.BUCKETS
    assert catalog.bucket_count(216_000_000) == 216
    monkeypatch.setattr(catalog, "ROWS_PER_BUCKET", 250)
    monkeypatch.setattr(catalog, "_SHARED", {})
    orders, items = catalog._bucketed(spark, sf_dir)
    assert catalog.BUCKETS < len(items.inputFiles()) <= -(-items.count() // 250)
    found = catalog.order_dataset_bucketed(spark, sf_dir)
    plain = catalog.order_dataset(spark, sf_dir).select(*found.columns)
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_a_fit_reads_the_labelled_rows_once(spark):
    """every step of the fit picked them out of the whole table again."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    data = spark.createDataFrame([(i, float(i), i % 2) for i in range(20)], "order_id int, x double, is_late int")
    rows = data.mapInArrow(seen, data.schema)
    active.fit_labelled(rows, ["x"])
    assert read.value == 20
    assert not rows.storageLevel.useMemory
    kept = rows.persist()
    active.fit_labelled(kept, ["x"])
    assert kept.storageLevel.useMemory
    kept.unpersist()


def money_items(spark, kind):
    values = [(1, "1.25"), (1, None), (1, "-3.10"), (2, None), (None, "0.05"), (None, "9999999999.99"), (3, "0.10")]
    return spark.createDataFrame([(o, i, i % 2, v) for i, (o, v) in enumerate(values)], "o int, i int, s int, v string").select(
        F.col("o").alias("order_id"), F.col("i").alias("order_item_id"), F.col("s").alias("seller_id"),
        F.col("v").cast(kind).alias("price"), F.lit("0.50").cast(kind).alias("freight_value"),
    )


@pytest.mark.parametrize("kind", ["decimal(12,2)", "decimal(18,2)", "double"])
def test_money_totals_are_those_of_plain_sums(spark, kind):
    items = money_items(spark, kind)
    plain = items.groupBy("order_id").agg(
        F.sum("price").alias("total_price"), F.sum("freight_value").alias("total_freight")
    )
    found = orders.aggregate_items(items).select(*plain.columns)
    assert found.dtypes == plain.dtypes
    assert rows(found, "order_id") == rows(plain, "order_id")


def test_money_is_shuffled_as_bigints(spark):
    """F18 to F25: wide decimals made the partial aggregates of the roll-up spill."""
    plan = orders.aggregate_items(money_items(spark, "decimal(12,2)"))._jdf.queryExecution().executedPlan()
    partial = [line for line in plan.toString().splitlines() if "partial_sum" in line or "merge_sum" in line]
    assert partial and all("isEmpty" not in line and "decimal(22" not in line for line in partial)
