"""The named queries: every operator applied to the driver's tables.

Operators downstream of a model appear with the closed-form score of the
adapter, so that SQL can check them; the fitted-model queries share one silver
table, one split and one trained model per input folder.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.functions.bins import right_closed_bin
from lagline.functions.calendar import days_between, micros_between, monday_first_weekday
from lagline.functions.scores import distance_from, threshold_label
from lagline.operators import (
    active,
    attribution,
    boosting,
    encoding,
    increments,
    joins,
    metrics,
    orders as mart_ops,
    profile,
    quality,
    rates,
    sampling,
    scoring,
    selection,
    sets,
    sketches,
)
from lagline.operators.boosting import BoostingParams
from lagline.operators.candidates import DEFAULT_CANDIDATES, logistic_candidate, settings_of
from lagline.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET
from lagline.session import scratch_path
from lagline.sources import adapter, files, models

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PROFILED = [*NUMERIC_FEATURES, "customer_state", "purchase_month"]
MONEY = ["total_price", "total_freight"]
# Cut points of the models that are small enough for SQL.
SMALL_CUTS = {
    "promised_days": [365.0, 450.0, 550.0, 640.0, 730.0, 820.0, 910.0, 1000.0],
    "item_count": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
    "seller_count": [1.0, 2.0, 3.0, 4.0, 5.0],
    "total_price": [50_000.0, 100_000.0, 150_000.0, 200_000.0, 300_000.0],
    "total_freight": [1_000.0, 3_000.0, 6_000.0, 10_000.0],
}
SMALL_CANDIDATES = ("deep_gbt", "leafwise")
# Fixed value: orders drawn for the attribution plots.
SHAP_SAMPLE = 2_000
WEIGHTS = {
    "item_count": -8,
    "seller_count": 3,
    "purchase_month": 2,
    "purchase_weekday": -1,
    "purchase_hour": 1,
}


def query(function: Query) -> Query:
    """Register under the function's name; a trailing ``_query`` only avoids clashes."""
    QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def _money(data: DataFrame) -> DataFrame:
    """Exact decimals as doubles, at the very end."""
    return data.withColumns(
        {f.name: F.col(f.name).cast("double") for f in data.schema.fields
         if isinstance(f.dataType, T.DecimalType)}
    )


def _mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_ops.order_features(
        adapter.orders(spark, sf_dir), adapter.items(spark, sf_dir), adapter.customers(spark, sf_dir)
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_ops.create_target(adapter.orders(spark, sf_dir))


def _labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and item roll-up, where the customer is not needed."""
    rollup = mart_ops.aggregate_items(adapter.items(spark, sf_dir))
    return mart_ops.join_items(_labelled(spark, sf_dir), rollup)


def _labelled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and customer, where the items are not needed."""
    return mart_ops.join_customers(_labelled(spark, sf_dir), adapter.customers(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _labelled_items(spark, sf_dir)
    return data.select(
        "order_id",
        TARGET,
        adapter.closed_form_score().alias("probability_positive"),
        adapter.closed_form_score(items_weight=4, base=35).alias("second_probability"),
    )


def _part(data: DataFrame, name: str) -> DataFrame:
    return data.withColumn("part", F.lit(name))


_SHARED: dict[tuple[str, str, str], object] = {}


_SHARED_LOCK = threading.RLock()


def _shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Built once per application and input folder, whose tables are taken as fixed."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _SHARED_LOCK:
        if key not in _SHARED:
            _SHARED[key] = build()
        return _SHARED[key]


# Sources and sinks


@query
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "csv")
    paths = [f"{folder}/{name}" for name in ("orders", "items", "customers")]
    for build, path in zip((adapter.orders, adapter.items, adapter.customers), paths):
        files.write_csv(build(spark, sf_dir), path)
    orders, items, customers = files.load_data(*paths, spark)
    return _money(
        mart_ops.create_dataset(orders, items, customers).select(
            "order_id", "customer_id", "item_count", "total_price", "customer_state", TARGET
        )
    )


@query
def csv_timestamp_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv-orders")
    source = adapter.orders(spark, sf_dir)
    files.write_csv(source, path)
    return files.read_csv(spark, path, source.schema)


@query
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = files.read_table(spark, f"{sf_dir}/orders.parquet")
    return orders.filter(F.col("o_orderstatus") != "P").select("o_orderkey", "o_custkey")


@query
def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(files.save_dataset(_mart(spark, sf_dir), scratch_path(spark, "silver")))


@query
def model_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stored model and the one in memory agree, per test order."""
    store = _store(spark, sf_dir)
    name, threshold = models.load_metadata(spark, store)
    _, test = _split(spark, sf_dir)

    def scored(model: PipelineModel) -> DataFrame:
        return scoring.predict(model, test, threshold).select(
            "order_id", "probability_positive", "prediction"
        )

    kept = scored(_trained(spark, sf_dir, name)).toDF("order_id", "kept", "kept_prediction")
    same = (F.col("probability_positive") == F.col("kept")) & (
        F.col("prediction") == F.col("kept_prediction")
    )
    return scored(models.load_model(store)).join(kept, "order_id").select(
        "order_id", same.alias("agrees")
    )


@query
def table_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table_shapes(
        {
            "orders": adapter.orders(spark, sf_dir),
            "items": adapter.items(spark, sf_dir),
            "customers": adapter.customers(spark, sf_dir),
        }
    )


@query
def score_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.preview(
        _scored(spark, sf_dir).withColumn("prediction", threshold_label(0.5)),
        ["order_id", "probability_positive", "prediction"],
        "order_id",
    )


# Projections, filters, predicates


@query
def delivered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_ops.delivered_orders(adapter.orders(spark, sf_dir))


@query
def label_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)


@query
def model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_ops.model_input(_mart(spark, sf_dir))


@query
def customer_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mart_ops.customer_columns(adapter.customers(spark, sf_dir))


@query
def fold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = sampling.assign_folds(_labelled(spark, sf_dir).select("order_id", TARGET))
    others, held_out = sampling.fold_parts(folded, 0)
    return sets.union_all([_part(others, "others"), _part(held_out, "held_out")])


@query
def threshold_label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "order_id", "probability_positive", threshold_label(0.16).alias("prediction")
    )


@query
def positive_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each test order's class probabilities form a distribution."""
    _, test = _split(spark, sf_dir)
    model = models.load_model(_store(spark, sf_dir))
    return selection.with_probability(model, test).select("order_id", _probability_ok())


@query
def min_support_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.min_support(rates.rate_by(_labelled_customers(spark, sf_dir), "customer_state"))


@query
def nonpositive_promise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.nonpositive_promises(mart_ops.create_features(_labelled(spark, sf_dir)))


# Joins


@query
def order_item_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = mart_ops.aggregate_items(adapter.items(spark, sf_dir))
    orders = adapter.orders(spark, sf_dir).select("order_id", "order_status")
    # Orders without items leave gaps; as doubles they read alike in every client.
    counts = {name: F.col(name).cast("double") for name in ("item_count", "seller_count")}
    return _money(mart_ops.join_items(orders, rollup)).withColumns(counts)


@query
def order_customer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapter.orders(spark, sf_dir).select("order_id", "customer_id")
    return mart_ops.join_customers(orders, adapter.customers(spark, sf_dir))


@query
def order_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(
        mart_ops.create_dataset(
            adapter.orders(spark, sf_dir),
            adapter.items(spark, sf_dir),
            adapter.customers(spark, sf_dir),
        )
    )


BUCKETS = 16
# Item rows of a bucket, which is one task: more rows make more buckets, not larger ones.
ROWS_PER_BUCKET = 1_000_000


def bucket_count(rows: int) -> int:
    return max(BUCKETS, -(-rows // ROWS_PER_BUCKET))


def _bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and items stored by order, made once."""

    def build() -> tuple[str, str]:
        names = []
        items = adapter.items(spark, sf_dir)
        buckets = bucket_count(items.count())
        for kind, data in (("orders", adapter.orders(spark, sf_dir)), ("items", items)):
            path = scratch_path(spark, f"bucketed-{kind}")
            names.append("bucketed_" + path.rsplit("-", 1)[-1])
            files.save_bucketed(data, path, "order_id", buckets, names[-1])
        return tuple(names)

    orders, items = _shared(spark, sf_dir, "bucketed", build)
    return spark.table(orders), spark.table(items)


@query
def order_dataset_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data set from tables stored by order: roll-up and item join move no rows."""
    orders, items = _bucketed(spark, sf_dir)
    return _money(mart_ops.create_dataset(orders, items, adapter.customers(spark, sf_dir)))


@query
def join_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.cardinality_violations(
        adapter.orders(spark, sf_dir).select("order_id"),
        adapter.items(spark, sf_dir),
        "order_id",
        "one_to_one",
    )


@query
def checked_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir).select("order_id", "customer_id", TARGET)
    rollup = mart_ops.aggregate_items(adapter.items(spark, sf_dir))
    joined = joins.checked_join(labelled, rollup, "order_id", "left", "one_to_one", early=False)
    customers = mart_ops.customer_columns(adapter.customers(spark, sf_dir))
    return _money(
        joins.checked_join(joined, customers, "customer_id", "left", "many_to_one", early=False)
    )


# Aggregations


@query
def aggregate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(mart_ops.aggregate_items(adapter.items(spark, sf_dir)))


@query
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    delivered, promised = (
        F.col("order_delivered_customer_date"),
        F.col("order_estimated_delivery_date"),
    )
    known = (
        (F.col("order_status") == "delivered")
        & delivered.isNotNull()
        & F.col("order_approved_at").isNotNull()
    )
    # As text, so that the group without a label reads alike in every client.
    label = F.when(known, (delivered > promised).cast("int")).cast("string")
    return rates.class_balance(adapter.orders(spark, sf_dir).select(label.alias(TARGET)))


@query
def describe_promised_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = profile.describe(mart_ops.create_features(_labelled(spark, sf_dir)), "promised_days")
    return _rounded(summary, [name for name in summary.columns if name != "count"])


def _rounded(data: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return data.withColumns({name: F.round(name, digits) for name in columns})


@query
def delay_by_promised_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = mart_ops.create_features(_labelled(spark, sf_dir))
    return rates.delay_by_promised_range(features, adapter.WIDE_EDGES, adapter.WIDE_LABELS)


@query
def delay_by_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.delay_by_items(_labelled_items(spark, sf_dir))


@query
def delay_by_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.delay_by_sellers(_labelled_items(spark, sf_dir))


def states_with_support(spark: SparkSession, sf_dir: str, at_least: int) -> DataFrame:
    return rates.delay_by_state(_labelled_customers(spark, sf_dir), at_least)


@query
def delay_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states_with_support(spark, sf_dir, 100)


@query
def delay_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.delay_by_month(mart_ops.create_features(_labelled(spark, sf_dir)))


@query
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.majority_baseline(_labelled(spark, sf_dir))


# Windows, sorting, top-k


@query
def cumulative_orders_by_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.cumulative_orders(delay_by_items(spark, sf_dir), "item_count")


@query
def cumulative_orders_by_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.cumulative_orders(delay_by_sellers(spark, sf_dir), "seller_count")


@query
def states_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All states with their position, so that the order itself can be compared."""
    by_state = rates.rate_by(_labelled_customers(spark, sf_dir), "customer_state")
    # One row per state.
    order = Window.orderBy(F.desc("delay_rate"), F.asc("customer_state"))
    return rates.ranked(
        by_state.withColumn("position", F.row_number().over(order)), "customer_state"
    )


@query
def uncertainty_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active.most_uncertain(_scored(spark, sf_dir)).select("order_id", "probability_positive")


def _candidate_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    scored = _scored(spark, sf_dir)
    return {
        "first": scored.select(TARGET, "probability_positive"),
        "second": scored.select(TARGET, F.col("second_probability").alias("probability_positive")),
    }


@query
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_candidate(metrics.candidate_results(_candidate_frames(spark, sf_dir)))


# Set operations


@query
def oof_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = sampling.assign_folds(_scored(spark, sf_dir))
    parts = [sampling.fold_parts(folded, fold)[1] for fold in range(3)]
    return sets.union_all([part.select(TARGET, "probability_positive") for part in parts])


@query
def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["item_count", "seller_count", "order_status", TARGET]
    data = _labelled_items(spark, sf_dir).select("order_id", *columns)
    train, _ = sampling.split_data(data)
    return sets.except_distinct(data.select(*columns), train.select(*columns))


@query
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _closed_form_round(spark, sf_dir)
    return parts["labelled_after"].select("order_id", TARGET)


@query
def pool_minus_queried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed_form_round(spark, sf_dir)["pool_after"].select("order_id", TARGET)


# Scalar functions


@query
def promised_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = days_between("order_approved_at", "order_estimated_delivery_date")
    return adapter.orders(spark, sf_dir).select("order_id", days.alias("promised_days"))


@query
def purchase_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month("order_purchase_timestamp")
    return adapter.orders(spark, sf_dir).select("order_id", month.alias("purchase_month"))


@query
def purchase_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekday = monday_first_weekday("order_purchase_timestamp")
    return adapter.orders(spark, sf_dir).select("order_id", weekday.alias("purchase_weekday"))


@query
def purchase_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("order_purchase_timestamp")
    return adapter.orders(spark, sf_dir).select("order_id", hour.alias("purchase_hour"))


@query
def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(_mart(spark, sf_dir))


@query
def promised_range_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = days_between("order_approved_at", "order_estimated_delivery_date")
    label = right_closed_bin(days, adapter.WIDE_EDGES, adapter.WIDE_LABELS)
    return adapter.orders(spark, sf_dir).select("order_id", label.alias("promised_days_range"))


@query
def cast_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = micros_between(epoch, "order_purchase_timestamp") / F.lit(1_000_000)
    return _labelled(spark, sf_dir).select(
        "order_id",
        F.col(TARGET).cast("tinyint").alias("late_flag"),
        seconds.alias("purchase_seconds"),
    )


@query
def abs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        "order_id", distance_from("probability_positive").alias("distance")
    )


# Data quality and profile


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untyped feed as a stored table: checks read columns, not derivations."""

    def build() -> str:
        path = scratch_path(spark, "raw-orders")
        files.save_dataset(adapter.raw_orders(spark, sf_dir), path)
        return path

    return files.read_table(spark, _shared(spark, sf_dir, "raw", build))


def _row_check(spark: SparkSession, sf_dir: str, check: str) -> DataFrame:
    return quality.row_failures(_raw(spark, sf_dir), quality.ORDER_RULES, {check})


@query
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_check(spark, sf_dir, "not_null")


@query
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique_failures(_raw(spark, sf_dir), quality.ORDER_RULES)


@query
def dq_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_check(spark, sf_dir, "length")


@query
def dq_allowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_check(spark, sf_dir, "allowed_values")


@query
def dq_type_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_check(spark, sf_dir, "type_coerce")


@query
def dq_row_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_check(spark, sf_dir, "approval_after_purchase")


def _misshapen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw feed with a column too many and one too few."""
    return _raw(spark, sf_dir).drop("order_delivered_carrier_date").withColumn("channel", F.lit("web"))


@query
def dq_strict_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _misshapen(spark, sf_dir)
    rows = data.agg(F.count(F.lit(1)).alias("n"))
    return quality.column_failures(data, quality.ORDER_RULES).select(
        "check", "column", rows.scalar().alias("affected_rows")
    )


@query
def dq_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failures(_misshapen(spark, sf_dir), quality.ORDER_RULES)


@query
def dq_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass everything; a customer may order twice here, so one key is unique."""
    rules = replace(
        quality.ORDER_RULES,
        columns=tuple(
            replace(rule, unique=rule.unique and rule.name == "order_id")
            for rule in quality.ORDER_RULES.columns
        ),
    )
    return quality.validate(_raw(spark, sf_dir), rules)[0]


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(spark, sf_dir).select(*PROFILED)


@query
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table with ids, status and times, and the numbers made from it."""
    tables = (adapter.orders(spark, sf_dir), _profiled(spark, sf_dir))
    return _rounded(
        sets.union_all([profile.profile_columns(table) for table in tables]),
        ["mean", "std", *profile.QUARTILES],
    )


@query
def profile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile out of stored daily sketches, and whether its estimates keep their error."""
    columns = ["order_id", "order_status", "total_price", "promised_days"]
    days = mart_ops.create_features(_labelled_items(spark, sf_dir)).select(
        F.to_date("order_purchase_timestamp").alias("day"), *columns
    )
    days = files.save_dataset(_money(days), scratch_path(spark, "days"))
    stored = files.save_dataset(
        sketches.column_sketches(days, ["day"]), scratch_path(spark, "day-sketches")
    )
    found = sketches.profile_from_sketches(stored)
    exact = profile.profile_columns(days.drop("day")).select(
        "column_name", F.col("distinct_count").alias("distinct"), F.col("q1").alias("low"), F.col("q3").alias("high")
    )
    close = F.abs(F.col("distinct_count") - F.col("distinct")) <= 0.08 * F.col("distinct")
    between = F.coalesce(F.col("median").between(F.col("low"), F.col("high")), F.lit(True))
    return _rounded(
        found.join(exact, "column_name").select(
            "column_name", "value_count", "null_count", "min_text", "max_text", "min_value", "max_value",
            "mean", close.alias("distinct_close"), between.alias("median_between"),
        ),
        ["mean", "min_value", "max_value"], 4,
    )


@query
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _labelled_customers(spark, sf_dir)
    return profile.top_values(data, ["customer_state", "customer_city", "customer_id"], 5)


@query
def profile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(_profiled(spark, sf_dir), NUMERIC_FEATURES, 10)


@query
def profile_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = profile.correlations(_profiled(spark, sf_dir), NUMERIC_FEATURES)
    return _rounded(pairs, ["correlation"])


# Sampling and splits


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = sampling.split_data(_labelled(spark, sf_dir).select("order_id", TARGET))
    return sets.union_all([_part(train, "train"), _part(test, "test")])


@query
def fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.assign_folds(_labelled(spark, sf_dir).select("order_id", TARGET))


@query
def exact_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _labelled(spark, sf_dir).select("order_id", TARGET)
    return sampling.exact_stratified_sample(data, fraction=0.25)


@query
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped_sample(_labelled(spark, sf_dir).select("order_id", TARGET))


@query
def disjointness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _labelled(spark, sf_dir).select("order_id", TARGET)
    return sampling.disjointness(data, *sampling.split_data(data))


# Encoding and models


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model input as a written table, which every fitted-model query reads."""

    def build() -> str:
        path = scratch_path(spark, "model-input")
        files.save_dataset(mart_ops.model_input(_mart(spark, sf_dir)), path)
        return path

    return files.read_table(spark, _shared(spark, sf_dir, "silver", build))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sampling.split_data(_silver(spark, sf_dir))


def _fold_scores(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Out-of-fold scores of the competing candidates at their full settings, made once."""

    def build() -> dict[str, DataFrame]:
        train, _ = _split(spark, sf_dir)
        return selection.fit_candidates(sampling.assign_folds(train), DEFAULT_CANDIDATES, final=False)[0]

    return _shared(spark, sf_dir, "fold scores", build)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.candidate_results(_fold_scores(spark, sf_dir))


def _winner(spark: SparkSession, sf_dir: str) -> tuple[str, float]:
    best = metrics.best_candidate(_results(spark, sf_dir)).first()
    return best["model_name"], best["threshold"]


def _trained(spark: SparkSession, sf_dir: str, name: str) -> PipelineModel:
    """A candidate fitted on all training rows at its full settings, once.

    The winner is fitted after the selection, as in the training job. A candidate that does
    not compete gets its out-of-fold scores here, in the same passes.
    """

    def build() -> PipelineModel:
        train, _ = _split(spark, sf_dir)
        folds = 0 if name in DEFAULT_CANDIDATES else 3
        return selection.fit_candidates(sampling.assign_folds(train), (name,), folds)[1][name]

    return _shared(spark, sf_dir, f"trained {name}", build)


def _store(spark: SparkSession, sf_dir: str) -> str:
    """The model store: the winning candidate and its threshold."""

    def build() -> str:
        store = scratch_path(spark, "models")
        name, threshold = _winner(spark, sf_dir)
        models.save_model(_trained(spark, sf_dir, name), store)
        models.save_metadata(spark, store, name, threshold)
        return store

    return _shared(spark, sf_dir, "store", build)


def _probability_ok() -> Column:
    """Both probabilities within 0 and 1 and adding up to 1."""
    pair = vector_to_array("probability")
    return (
        pair[0].between(0.0, 1.0)
        & pair[1].between(0.0, 1.0)
        & (F.abs(pair[0] + pair[1] - 1) < 1e-9)
        & (pair[1] == F.col("probability_positive"))
    ).alias("probability_ok")


@query
def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.category_order(_silver(spark, sf_dir))


def _hot(column: str) -> Column:
    """Where the one of a one-hot vector stands, counted from 0."""
    return (F.array_position(vector_to_array(F.col(column)), F.lit(1.0)) - 1).cast("int")


@query
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _silver(spark, sf_dir)
    encoded = encoding.encoder().fit(data).transform(data)
    return encoded.select(
        "order_id",
        *[_hot(f"{name}_ohe").alias(f"{name}_slot") for name in CATEGORICAL_FEATURES],
        F.size(vector_to_array(F.col("customer_state_ohe"))).alias("state_width"),
    )


def _vector_summary(data: DataFrame) -> DataFrame:
    """Width, numbers and the positions of the ones of each feature vector."""
    slots = vector_to_array(F.col("features"))
    first = len(NUMERIC_FEATURES)
    hot = F.filter(
        F.transform(
            slots, lambda x, i: F.when((i >= first) & (x == 1.0), i.cast("string"))
        ),
        lambda x: x.isNotNull(),
    )
    return data.select(
        "order_id",
        F.size(slots).alias("width"),
        *[slots[i].alias(f"slot_{name}") for i, name in enumerate(NUMERIC_FEATURES)],
        F.array_join(hot, ",").alias("hot_slots"),
    )


@query
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _silver(spark, sf_dir)
    return _vector_summary(encoding.encoder().fit(data).transform(data))


@query
def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _silver(spark, sf_dir)
    return encoding.feature_names(encoding.encoder().fit(data).transform(data))


@query
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = encoding.scale_standard(_silver(spark, sf_dir), NUMERIC_FEATURES)
    return scaled.select(
        "order_id",
        *[F.round(F.col("scaled")[i], 6).alias(f"scaled_{n}") for i, n in enumerate(NUMERIC_FEATURES)],
    )


def _fitted_scores(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Test orders with the size of the fitted model and whether its output is sound."""
    _, test = _split(spark, sf_dir)
    model = _trained(spark, sf_dir, name)
    trees = model.stages[-1]
    allowed = trees.getMaxDepth()
    return selection.with_probability(model, test).select(
        "order_id",
        TARGET,
        F.lit(trees.getNumTrees).alias("trees"),
        F.lit(all(tree.depth <= allowed for tree in trees.trees)).alias("depth_ok"),
        _probability_ok(),
    )


@query
def gbt_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted_scores(spark, sf_dir, "gbt")


@query
def deep_gbt_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted_scores(spark, sf_dir, "deep_gbt")


@query
def leafwise_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted_scores(spark, sf_dir, "leafwise")


@query
def logistic_candidate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test orders, and whether the fit's gradient on the training rows is near zero."""
    train, test = _split(spark, sf_dir)
    rows = train.count()
    model = logistic_candidate(NUMERIC_FEATURES, rows).fit(train)
    weights = model.stages[-1].coefficients.toArray().tolist()
    fitted = selection.with_probability(model, train).withColumn("x", vector_to_array("features"))
    error = F.col("probability_positive") - F.col(TARGET)
    slopes = fitted.agg(*[F.avg(error * F.col("x")[i]) for i in range(len(weights))]).first()
    flat = all(abs(slope + weight / rows) < 1e-4 for slope, weight in zip(slopes, weights))
    return selection.with_probability(model, test).select(
        "order_id", TARGET, F.lit(flat).alias("gradient_ok"), _probability_ok()
    )


@query
def train_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the store holds the winner and its threshold, and scores every test order."""
    store = _store(spark, sf_dir)
    name, threshold = models.load_metadata(spark, store)
    _, test = _split(spark, sf_dir)
    winner, best = _winner(spark, sf_dir)
    scored = scoring.predict(models.load_model(store), test, threshold)
    return scored.agg(F.count("prediction").alias("order_count")).select(
        F.lit(name == winner).alias("is_winner"),
        F.lit(threshold == best).alias("has_threshold"),
        "order_count",
    )


# Selection and evaluation


@query
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(metrics.threshold_curve(_scored(spark, sf_dir)))


@query
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_curve(_scored(spark, sf_dir))


@query
def cross_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per candidate: threshold on the grid, F1 as recomputed from its out-of-fold scores."""
    frames = []
    for row in _results(spark, sf_dir).collect():
        scores = _fold_scores(spark, sf_dir)[row["model_name"]]
        again = metrics.confusion_metrics(scores, row["threshold"]).select("f1")
        frames.append(
            again.select(
                F.lit(row["candidate_order"]).alias("candidate_order"),
                F.lit(row["model_name"]).alias("model_name"),
                F.lit(row["threshold"] in metrics.THRESHOLDS).alias("on_grid"),
                (F.abs(F.col("f1") - F.lit(row["f1"])) < 1e-9).alias("f1_ok"),
            )
        )
    return sets.union_all(frames)


@query
def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold held out by the model that scored each training row, and how often."""
    scored = sets.union_all(list(_fold_scores(spark, sf_dir).values()))
    return scored.groupBy("order_id", TARGET, "fold").agg(
        F.count("probability_positive").alias("times_scored")
    )


@query
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_metrics(_scored(spark, sf_dir), 0.16)


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_scored(spark, sf_dir)), ["roc_auc"], 9)


@query
def evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether F1 follows from precision and recall and the area from all thresholds."""
    store = _store(spark, sf_dir)
    name, threshold = models.load_metadata(spark, store)
    model = models.load_model(store)
    _, test = _split(spark, sf_dir)
    found = selection.evaluate_model(model, name, test, threshold)
    both = found["precision"] + found["recall"]
    f1 = 2 * found["precision"] * found["recall"] / both if both else 0.0
    area = BinaryClassificationEvaluator(labelCol=TARGET, numBins=0).evaluate(model.transform(test))
    return test.agg(F.count("order_id").alias("order_count")).select(
        "order_count",
        F.lit(abs(found["f1"] - f1) < 1e-9).alias("f1_ok"),
        F.lit(abs(found["roc_auc"] - area) < 1e-9).alias("area_ok"),
    )


# Models small enough for SQL: one tree, fixed cuts, every row and column


def _small_settings(depth: int, leaves: int | None) -> dict[str, BoostingParams]:
    """Both histogram candidates with one tree of all rows and columns."""
    return {
        name: replace(
            settings_of(name, 1), max_depth=depth, row_share=1.0, column_share=1.0,
            max_leaves=leaves if name == "leafwise" else None,
        )
        for name in SMALL_CANDIDATES
    }


def _stumps(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, PipelineModel]]:
    """Out-of-fold scores and final models of the one-split candidates."""

    def build() -> tuple[dict[str, DataFrame], dict[str, PipelineModel]]:
        train, _ = _split(spark, sf_dir)
        folded = sampling.assign_folds(train)
        return selection.fit_boosted(folded, _small_settings(1, 2), cuts=SMALL_CUTS)

    return _shared(spark, sf_dir, "stumps", build)


def _stump_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.candidate_results(_stumps(spark, sf_dir)[0])


def _stump_winner(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, str, float]:
    best = metrics.best_candidate(_stump_results(spark, sf_dir)).first()
    return _stumps(spark, sf_dir)[1][best["model_name"]], best["model_name"], best["threshold"]


@query
def boosting_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient, hessian and count per feature bin, for the first tree of each fold's run."""
    train, _ = _split(spark, sf_dir)
    folded = sampling.assign_folds(train)
    encoded = encoding.encoder(impute=True).fit(folded).transform(folded)
    layout = boosting.layout_of(encoded, boosting.category_sizes(encoded), SMALL_CUTS)
    runs = [boosting.Run(_small_settings(1, 2)["deep_gbt"], fold) for fold in (0, 1, 2)]
    return boosting.first_histograms(encoded, layout, runs, fold="fold")


@query
def boosted_first_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the first tree of both candidates: two levels by depth, three leaves by gain."""
    train, _ = _split(spark, sf_dir)
    encoded = encoding.encoder(impute=True).fit(train).transform(train)
    layout = boosting.layout_of(encoded, boosting.category_sizes(encoded), SMALL_CUTS)
    settings = _small_settings(2, 3)
    grown = boosting.boost(encoded, layout, [boosting.Run(p) for p in settings.values()])
    names = encoding.vector_names(encoded)
    nodes = [
        (name, *row) for name, trees in zip(settings, grown.trees)
        for row in boosting.tree_rows(layout, trees[0], names)
    ]
    grown.blocks.unpersist()
    table = spark.createDataFrame(
        nodes,
        "model_name string, path string, feature string, threshold double, gain double, "
        "order_count bigint, value double",
    )
    return _rounded(table, ["gain", "value"], 6)


@query
def cross_validate_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold and out-of-fold F1 of the one-split candidates."""
    return _rounded(_stump_results(spark, sf_dir), ["f1"], 9)


@query
def out_of_fold_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training order's score by the model that did not see it, per candidate."""
    scores, _ = _stumps(spark, sf_dir)
    frames = [frame.withColumn("model_name", F.lit(name)) for name, frame in scores.items()]
    return _rounded(sets.union_all(frames), ["probability_positive"], 9)


@query
def evaluate_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and ROC area of the winning one-split model on the test part."""
    model, name, threshold = _stump_winner(spark, sf_dir)
    _, test = _split(spark, sf_dir)
    found = selection.evaluate_model(model, name, test, threshold)
    return _rounded(selection.evaluation_frame(spark, found), ["precision", "recall", "f1", "roc_auc"], 9)


@query
def predict_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and label of every test order by the winning one-split model."""
    model, _, threshold = _stump_winner(spark, sf_dir)
    _, test = _split(spark, sf_dir)
    scored = scoring.predict(model, test, threshold)
    return _rounded(
        scored.select("order_id", TARGET, "probability_positive", "prediction"), ["probability_positive"], 9
    )


@query
def shap_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contribution of every source column to the log-odds of the winning one-split model."""
    model, _, _ = _stump_winner(spark, sf_dir)
    path = scratch_path(spark, "stump")
    model.write().save(path)
    vectors = attribution.shap_input(model, _silver(spark, sf_dir))
    arrays = attribution.shap_arrays(vectors, attribution.read_trees(spark, path))
    return _rounded(attribution.by_source(arrays, encoding.vector_names(vectors)), ["contribution"], 9)


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _scored(spark, sf_dir).withColumn("prediction", threshold_label(0.5))
    return metrics.accuracy(labelled)


# Scoring


@query
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each test order's label follows from its probability and the threshold."""
    store = _store(spark, sf_dir)
    _, threshold = models.load_metadata(spark, store)
    _, test = _split(spark, sf_dir)
    follows = (F.col("probability_positive") >= F.lit(threshold)).cast("int") == F.col("prediction")
    return scoring.predict(models.load_model(store), test, threshold).select(
        "order_id", TARGET, follows.alias("follows"), _probability_ok()
    )


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    _silver(spark, sf_dir)
    silver = _shared(spark, sf_dir, "silver", lambda: None)
    return scoring.score_orders(spark, _store(spark, sf_dir), silver, scratch_path(spark, "gold"))


@query
def score_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written gold rows: inputs as they were, scores within their range."""
    sound = F.col("probability_positive").between(0.0, 1.0) & F.col("prediction").isin(0, 1)
    return _gold(spark, sf_dir).select(
        "order_id", "purchase_hour", "customer_state", TARGET, sound.alias("sound")
    )


@query
def score_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows after three runs: half of the months, all of them, and once more."""
    model, _, threshold = _stump_winner(spark, sf_dir)
    store, folder = scratch_path(spark, "increment-store"), scratch_path(spark, "increments")
    models.save_model(model, store)
    models.save_metadata(spark, store, "stump", threshold)
    data = _silver(spark, sf_dir).withColumn("month", F.col("purchase_month"))
    scored = []
    for rows in (data.filter("month <= 6"), data, data):
        done = increments.score_increment(
            spark, store, rows, f"{folder}/gold", f"{folder}/ledger", "month", "stump"
        )
        scored.append(done.count())
    gold = increments.read_gold(spark, f"{folder}/gold")
    return _rounded(
        gold.select(
            "order_id", "month", "probability_positive", "prediction",
            *[F.lit(n).cast("int").alias(f"run_{i + 1}_parts") for i, n in enumerate(scored)],
        ),
        ["probability_positive"], 9,
    )


@query
def score_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each scored order's label follows from its probability and the threshold."""
    _, threshold = models.load_metadata(spark, _store(spark, sf_dir))
    score = F.col("probability_positive")
    agrees = (score >= F.lit(threshold)).cast("int") == F.col("prediction")
    return _gold(spark, sf_dir).select(
        "order_id", TARGET, (score.between(0.0, 1.0) & agrees).alias("consistent")
    )


# Attribution


@query
def shap_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 2,000 orders as the model sees them."""
    model = models.load_model(_store(spark, sf_dir))
    return _vector_summary(attribution.shap_input(model, _silver(spark, sf_dir), SHAP_SAMPLE))


@query
def shap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: a value and a finite contribution for every slot of the model's vector."""
    path = models.model_path(_store(spark, sf_dir))
    vectors = attribution.shap_input(models.load_model(_store(spark, sf_dir)), _silver(spark, sf_dir))
    arrays = attribution.shap_arrays(vectors, attribution.read_trees(spark, path))
    slots = len(encoding.vector_names(vectors))
    return arrays.select(
        "order_id",
        (F.size("value") == slots).alias("values_ok"),
        (
            (F.size("contribution") == slots)
            & F.forall("contribution", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        ).alias("contributions_ok"),
    )


@query
def shap_additivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base value plus contributions minus the model's own log-odds, per order."""
    path = models.model_path(_store(spark, sf_dir))
    model = models.load_model(_store(spark, sf_dir))
    trees = attribution.read_trees(spark, path)
    data = _silver(spark, sf_dir)
    arrays = attribution.shap_arrays(attribution.shap_input(model, data, None), trees)
    total = F.aggregate("contribution", F.lit(0.0), lambda a, b: a + b)
    base = attribution.LOG_ODDS_PER_MARGIN * attribution.base_margin(trees)
    margin = vector_to_array(F.col("rawPrediction"))[1] * attribution.LOG_ODDS_PER_MARGIN
    explained = arrays.select("order_id", (F.lit(base) + total).alias("explained"))
    return (
        model.transform(data)
        .select("order_id", margin.alias("log_odds"))
        .join(explained, "order_id")
        .select("order_id", F.round(F.abs(F.col("explained") - F.col("log_odds")), 6).alias("gap"))
    )


@query
def shap_model_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source columns that importance is given for, and whether it is sound."""
    path = models.model_path(_store(spark, sf_dir))
    model = models.load_model(_store(spark, sf_dir))
    vectors = attribution.shap_input(model, _silver(spark, sf_dir), None)
    arrays = attribution.shap_arrays(vectors, attribution.read_trees(spark, path))
    found = attribution.importance(attribution.by_source(arrays, encoding.vector_names(vectors)))
    return found.select("feature", (F.col("importance") >= 0).alias("importance_ok"))


def _linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact attribution of a linear score: weight times distance from the mean."""
    data = mart_ops.create_features(_labelled_items(spark, sf_dir))
    means = data.agg(F.struct(*[F.avg(name).alias(name) for name in WEIGHTS]).alias("means"))
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(name).cast("double").alias("value"),
            (F.lit(weight) * (F.col(name) - F.col(f"means.{name}"))).alias("contribution"),
        )
        for name, weight in WEIGHTS.items()
    ]
    return data.withColumn("means", means.scalar()).select("order_id", F.inline(F.array(*entries)))


@query
def shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        attribution.importance(_linear_contributions(spark, sf_dir)), ["importance"]
    )


@query
def shap_beeswarm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    contributions = _linear_contributions(spark, sf_dir)
    table = attribution.beeswarm(contributions, attribution.importance(contributions), 3)
    return _rounded(table, ["contribution", "scaled_value"])


@query
def shap_top_with_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = attribution.importance(_linear_contributions(spark, sf_dir))
    return _rounded(attribution.top_with_other(table, 3), ["importance"])


# Active learning


def _partition(spark: SparkSession, sf_dir: str) -> active.Pools:
    return active.partition(_silver(spark, sf_dir).select("order_id", TARGET))


def _closed_form_round(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    start = _partition(spark, sf_dir)
    scores = _scored(spark, sf_dir).select("order_id", "probability_positive")
    queried = active.most_uncertain(start.pool.join(scores, "order_id"))
    labelled, pool = active.move_queried(start.labelled, start.pool, queried, start.pool)
    return {"queried": queried, "labelled_after": labelled, "pool_after": pool}


@query
def al_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = _partition(spark, sf_dir)
    return sets.union_all(
        [_part(pools.labelled, "labelled"), _part(pools.pool, "pool"), _part(pools.test, "test")]
    )


@query
def al_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool orders scored by the model of the labelled ones."""
    pools = active.partition(_silver(spark, sf_dir))
    model = active.fit_labelled(pools.labelled, NUMERIC_FEATURES)
    return selection.with_probability(model, pools.pool).select("order_id", _probability_ok())


@query
def al_query_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    queried = _closed_form_round(spark, sf_dir)["queried"]
    return queried.select("order_id", "probability_positive")


@query
def al_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _closed_form_round(spark, sf_dir)
    return sets.union_all(
        [
            _part(parts["labelled_after"].select("order_id", TARGET), "labelled"),
            _part(parts["pool_after"].select("order_id", TARGET), "pool"),
        ]
    )


@query
def al_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes before and after a round."""
    report = active.run_round(_silver(spark, sf_dir), NUMERIC_FEATURES).report
    return report.select(
        "stage", "labelled", "pool", "test", F.col("accuracy").between(0.0, 1.0).alias("accuracy_ok")
    )
