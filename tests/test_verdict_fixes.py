"""Inputs that once gave silently wrong or missing answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lagline.operators import active, encoding, quality
from lagline.schemas import CUSTOMERS_SCHEMA, NUMERIC_FEATURES
from lagline.sources import files
from tests.conftest import rows


def test_csv_files_with_another_column_order_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("customer_id,customer_city,customer_state\n1,Rome,RM\n")
    (tmp_path / "b.csv").write_text("customer_id,customer_state,customer_city\n2,RM,Rome\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path), CUSTOMERS_SCHEMA).collect()
    alone = files.read_csv(spark, str(tmp_path / "b.csv"), CUSTOMERS_SCHEMA)
    assert alone.select("customer_city", "customer_state").first() == ("Rome", "RM")


def _order(spark, **values):
    base = {
        "order_id": "a" * 32,
        "order_purchase_timestamp": "2020-01-02 00:00:00",
        "order_approved_at": "2020-01-01 00:00:00",
    }
    row = base | values
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in row))


def test_a_row_rule_runs_although_other_columns_are_missing(spark):
    found = quality.row_failures(_order(spark), quality.ORDER_RULES, {"approval_after_purchase"})
    assert found.count() == 1


def test_a_row_rule_without_its_column_is_reported(spark):
    data = _order(spark).drop("order_approved_at")
    found = quality.failures(data, quality.ORDER_RULES).filter("check = 'unchecked_rule'")
    assert [r["column"] for r in found.collect()] == ["approval_after_purchase"]


def test_uniqueness_is_of_the_declared_type(spark):
    rules = quality.TableRule((quality.ColumnRule("t", "timestamp_ntz", unique=True),), key="t")
    data = spark.createDataFrame([("2020-01-01",), ("2020-01-01 00:00:00",)], "t string")
    valid, failed = quality.validate(data, rules)
    assert valid.count() == 0
    assert rows(failed.select("check", "value"), "value") == [
        ("unique", "2020-01-01"),
        ("unique", "2020-01-01 00:00:00"),
    ]


def test_a_missing_number_is_scaled_to_the_mean(spark):
    data = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "order_id int, x double")
    scaled = encoding.scale_standard(data, ["x"]).orderBy("order_id")
    assert [r["scaled"][0] for r in scaled.collect()][2] == 0.0
    assert scaled.columns == ["order_id", "x", "scaled"]


def test_a_query_of_any_size_moves_its_rows(spark):
    data = spark.range(250_000).select(
        F.col("id").alias("order_id"),
        (F.col("id") % 2).cast("int").alias("is_late"),
        (F.col("id") / 250_000).alias("probability_positive"),
    )
    queried = active.most_uncertain(data, 200_000)
    labelled = data.limit(0).select("order_id", "is_late")
    after, pool = active.move_queried(
        labelled, data.select("order_id", "is_late"), queried, data.select("order_id", "is_late")
    )
    assert after.count() == 200_000 and pool.count() == 50_000


def test_the_labelled_set_needs_every_class(spark):
    data = spark.range(300).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") < 2, 2).otherwise(F.col("id") % 2).cast("int").alias("is_late"),
        *[F.lit(1.0).alias(n) for n in NUMERIC_FEATURES],
    )
    with pytest.raises(ValueError, match="classes"):
        active.partition(data)
