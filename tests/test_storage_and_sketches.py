"""Sketch profiles, stored layouts, checks inside the join, samples by bottom-k, increments."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lagline.operators import increments, joins, ordered, profile, sampling, selection, sketches
from lagline.operators.orders import create_dataset
from lagline.operators.sampling import split_data
from lagline.plans import catalog
from lagline.session import scratch_path
from lagline.sources import files, models
from tests.conftest import rows


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(20_000).select(
        (F.col("id") % 30).alias("day"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 10_007).cast("double")).alias("x"),
        F.concat(F.lit("t"), F.col("id") % 5).alias("t"),
    )


def test_sketches_of_days_merge_to_the_whole(numbers):
    daily = sketches.column_sketches(numbers, ["day"])
    assert daily.count() == 30 * 3
    merged = {r["column_name"]: r for r in sketches.profile_from_sketches(daily).collect()}
    exact = {r["column_name"]: r for r in profile.profile_columns(numbers.drop("day")).collect()}
    for name, e in exact.items():
        m = merged[name]
        for field in ("value_count", "null_count", "min_text", "max_text", "min_value", "max_value"):
            assert m[field] == e[field], (name, field)
        assert abs(m["distinct_count"] - e["distinct_count"]) <= 0.06 * e["distinct_count"]
        if e["mean"] is not None:
            assert m["mean"] == pytest.approx(e["mean"]) and m["std"] == pytest.approx(e["std"], rel=1e-6)
    # Rank error of the merged quantiles of x, whose values are spread evenly.
    for name, q in sketches.QUARTILES.items():
        assert abs(merged["x"][name] / 10_007 - q) < 0.035


def test_a_day_loaded_anew_replaces_its_own_sketches(numbers):
    daily = sketches.column_sketches(numbers, ["day"])
    fewer = numbers.filter("day <> 3 OR key % 2 = 0")
    replaced = daily.filter("day <> 3").unionByName(
        sketches.column_sketches(fewer.filter("day = 3"), ["day"])
    )
    by_parts = rows(sketches.profile_from_sketches(replaced).select("column_name", "value_count", "distinct_count"), "column_name")
    at_once = rows(sketches.profile_from_sketches(sketches.column_sketches(fewer.drop("day"))).select("column_name", "value_count", "distinct_count"), "column_name")
    assert by_parts == at_once


def test_sketches_of_nothing_and_of_nulls(spark):
    data = spark.createDataFrame([(None, None), (None, "a")], "x double, t string")
    found = {r["column_name"]: r for r in profile.profile_columns(data, approximate=True).collect()}
    assert (found["x"]["value_count"], found["x"]["null_count"], found["x"]["distinct_count"]) == (0, 2, 0)
    assert found["x"]["median"] is None and found["t"]["max_text"] == "a"
    empty = {r["column_name"]: r for r in profile.profile_columns(data.limit(0)).collect()}
    assert empty["t"]["value_count"] == 0 and empty["x"]["mean"] is None
    assert profile.describe(data, "x").first()["count"] == 0


def test_an_exact_profile_does_not_repeat_rows(spark, numbers, monkeypatch):
    plans = []
    keep = profile.save_dataset

    def recorded(frame, path):
        plans.append(plan_of(frame))
        return keep(frame, path)

    monkeypatch.setattr(profile, "save_dataset", recorded)
    assert profile.profile_columns(numbers).count() == 4
    assert plans and not any("Expand" in plan for plan in plans)
    assert "Range (0, 20000" in plans[0] and not any("Range (0, 20000" in plan for plan in plans[1:])


def test_quartiles_read_the_data_once(spark, numbers, monkeypatch):
    scans = []
    keep = ordered.save_dataset
    monkeypatch.setattr(ordered, "save_dataset", lambda f, p: scans.append(plan_of(f)) or keep(f, p))
    found = profile.describe(numbers, "x")
    assert "Range (0, 20000" not in plan_of(found) and len(scans) == 1
    values = sorted(r["x"] for r in numbers.filter("x IS NOT NULL").collect())
    row = found.first()
    for name, q in profile.QUARTILES.items():
        at = q * (len(values) - 1)
        low, high = values[int(at)], values[min(len(values) - 1, int(at) + 1)]
        assert row[name] == pytest.approx(low + (high - low) * (at - int(at)))


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("buckets", [4, 65_536])
def test_top_values_equal_a_full_count(spark, monkeypatch, k, buckets):
    monkeypatch.setattr(profile, "BUCKETS", buckets)
    data = spark.range(4_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).cast("string").alias("hot"),
        F.col("id").alias("unique"),
        F.when(F.col("id") < 2, F.lit("few")).alias("rare"),
    )
    found = profile.top_values(data, data.columns, k).select("column_name", "value", "occurrences", "position")
    expected = []
    for name in data.columns:
        counts = data.filter(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("v")).count().collect()
        ranked = sorted(counts, key=lambda r: (-r["count"], r["v"]))[:k]
        expected += [(name, r["v"], r["count"], i + 1) for i, r in enumerate(ranked)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_frequent_values_alone_are_counted_in_the_end(spark):
    """Where a few values stand out, the last shuffle carries few values."""
    data = spark.range(50_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(F.col("id") % 4 - 9).alias("v"))
    plan = profile.top_values(data, ["v"], 3)
    plan.collect()
    assert [r["value"] for r in plan.orderBy("position").collect()] == ["-6", "-7", "-8"]
    assert "LeftSemi" in plan_of(plan)


def test_the_check_rides_on_the_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string")
    good = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z"), (None, "z")], "k int, r string")
    bad = good.unionByName(spark.createDataFrame([(3, "w")], "k int, r string"))
    expected = rows(left.join(good, "k", "left"), "l")
    joined = joins.checked_join(left, good, "k", "left", "many_to_one", early=False)
    assert rows(joined, "l") == expected
    for how, validate, a, b in (
        ("left", "many_to_one", left, bad), ("inner", "many_to_one", left, bad),
        ("left", "one_to_one", left, good), ("left", "one_to_many", left, good),
    ):
        failing = joins.checked_join(a, b, "k", how, validate, early=False)
        with pytest.raises(PySparkException, match="join is not"):
            failing.select("l").collect()
    assert joins.checked_join(left, bad, "k", "left", "many_to_many", early=False).count() == 4


def test_the_check_adds_no_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(100).withColumnRenamed("id", "k").repartition(3)
        right = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v")).repartition(3)
        plain = plan_of(left.join(right, "k", "left"))
        checked = plan_of(joins.checked_join(left, right, "k", "left", "many_to_one", early=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert checked.count("Exchange hashpartitioning") == plain.count("Exchange hashpartitioning")


def test_tables_stored_by_order_join_without_a_shuffle(spark, sf_dir):
    orders, items = catalog._bucketed(spark, sf_dir)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        customers = catalog.adapter.customers(spark, sf_dir)
        plan = plan_of(create_dataset(orders, items, customers))
        rollup = plan_of(catalog.mart_ops.aggregate_items(items))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning(order_id" not in plan and "customer_id" in plan
    assert "Exchange" not in rollup


def test_bottom_k_and_slots_cut_at_the_same_rows(spark, monkeypatch):
    data = spark.range(5_000).select(F.col("id").alias("order_id"), (F.col("id") % 7 == 0).cast("int").alias("is_late"))
    for size in (0, 1, 9, 500, 4_999, 9_000):
        small = rows(sampling.exact_stratified_sample(data, size=size), "order_id")
        monkeypatch.setattr(sampling, "BOTTOM_K", -1)
        large = rows(sampling.exact_stratified_sample(data, size=size), "order_id")
        monkeypatch.undo()
        assert small == large and len(small) == min(size, 5_000)


def test_a_sample_reads_its_data_twice(spark, monkeypatch):
    data = spark.range(3_000).select(F.col("id").alias("order_id"), (F.col("id") % 2).cast("int").alias("is_late"))
    seen = []
    keep = sampling.save_dataset
    monkeypatch.setattr(sampling, "save_dataset", lambda f, p: seen.append(plan_of(f)) or keep(f, p))
    sample = sampling.exact_stratified_sample(data, size=100)
    assert sum("Range (0, 3000" in plan for plan in [*seen, plan_of(sample)]) == 2
    assert any("WindowGroupLimit" in plan for plan in seen)


@pytest.fixture(scope="module")
def scored_store(spark, sf_dir):
    store = scratch_path(spark, "store")
    train, _ = split_data(catalog._silver(spark, sf_dir))
    selection.train_model("deep_gbt", train, 0.2, store, max_iter=2)
    return store


def test_scoring_in_parts_equals_scoring_at_once(spark, sf_dir, scored_store):
    data = catalog._silver(spark, sf_dir).withColumn("month", F.col("purchase_month"))
    folder = scratch_path(spark, "parts")

    def run(rows, model_id="m1"):
        done = increments.score_increment(spark, scored_store, rows, f"{folder}/gold", f"{folder}/ledger", "month", model_id)
        return sorted(int(r["part"]) for r in done.collect())

    def gold():
        return rows(increments.read_gold(spark, f"{folder}/gold").select("order_id", "probability_positive", "prediction"), "order_id")

    files.save_dataset(data, f"{folder}/silver")
    at_once = scored = files.read_table(spark, f"{folder}/silver")
    from lagline.operators import scoring

    whole = scoring.score_orders(spark, scored_store, f"{folder}/silver", f"{folder}/whole")
    at_once = rows(whole.select("order_id", "probability_positive", "prediction"), "order_id")
    months = sorted(r["month"] for r in scored.select("month").distinct().collect())
    early = [m for m in months if m <= 6]
    assert run(data.filter("month <= 6")) == early
    assert run(data) == [m for m in months if m > 6]
    assert gold() == at_once
    assert run(data) == [] and gold() == at_once
    late = data.filter(F.col("month") == months[0]).limit(1).withColumn("order_id", F.lit(-5).cast("bigint"))
    assert run(data.unionByName(late)) == [months[0]]
    assert len(gold()) == len(at_once) + 1
    assert run(data) == [months[0]] and gold() == at_once
    assert run(data, "m2") == months and gold() == at_once


def test_a_ledger_that_cannot_be_read_is_not_taken_as_empty(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    (path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        increments.read_ledger(spark, str(path)).collect()
    assert increments.read_ledger(spark, str(tmp_path / "absent")).count() == 0
    assert models.MODEL_DIR
