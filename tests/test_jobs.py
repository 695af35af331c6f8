"""Files, the end-to-end jobs, active learning and the catalogue against SQL."""

from __future__ import annotations

from datetime import datetime

import pytest

import __spark_entry__ as spark_entry
from check_oracle import compare, open_tables
from lagline import session
from lagline.operators import active
from lagline.plans import catalog, explain, training
from lagline.schemas import CATEGORY_SCHEMA, NUMERIC_FEATURES, ORDERS_SCHEMA
from lagline.session import scratch_path
from lagline.sources import adapter, files

from .conftest import rows


def test_csv_with_byte_order_mark_and_no_last_newline(spark, tmp_path):
    path = tmp_path / "category.csv"
    path.write_bytes(
        "﻿product_category_name,product_category_name_english\nbeleza_saude,health_beauty\nbebes,baby".encode()
    )
    data = files.read_csv(spark, path, CATEGORY_SCHEMA)
    assert rows(data, "product_category_name") == [("bebes", "baby"), ("beleza_saude", "health_beauty")]


def test_declared_types_follow_names_not_positions(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(
        "customer_id,extra,order_id,order_purchase_timestamp\n"
        "c1,7,o1,2017-10-02 10:56:33\n"
        "c2,8,o2,never\n"
    )
    data = files.read_csv(spark, path, ORDERS_SCHEMA, keep_corrupt=True)
    assert dict(data.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    first, second = data.orderBy("order_id").collect()
    assert first["order_purchase_timestamp"] == datetime(2017, 10, 2, 10, 56, 33)
    assert second["order_purchase_timestamp"] is None
    assert first[files.CORRUPT_COLUMN] is None and "never" in second[files.CORRUPT_COLUMN]
    inferred = files.read_csv(spark, path)
    assert dict(inferred.dtypes)["extra"] == "int"


def test_parquet_overwrite_and_shapes(spark):
    path = scratch_path(spark, "table")
    files.save_dataset(spark.range(5), path)
    again = files.save_dataset(spark.range(3), path)
    assert rows(files.table_shapes({"t": again}), "table_name") == [("t", 3, 1)]
    assert [r["id"] for r in files.preview(again, ["id"], "id", 2).collect()] == [0, 1]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["parquet_scan"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,P))]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan


def test_rate_tables_read_only_what_they_need(spark, sf_dir):
    query = catalog.QUERIES["delay_by_state"](spark, sf_dir)._jdf.queryExecution()
    plan = query.executedPlan().toString()
    assert "l_shipdate" in plan and "l_extendedprice" not in plan and "l_suppkey" not in plan


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    with pytest.raises(RuntimeError):
        session.scratch_path(Session(spark_master="spark://head:7077"), "x")
    cluster = Session(spark_master="spark://head:7077", spark_checkpoint_dir="hdfs:///shared/")
    assert session.scratch_path(cluster, "x").startswith("hdfs:///shared/lagline/x-")
    assert session.scratch_path(Session(spark_master="local[2]"), "x").startswith("/")


def test_training_scoring_and_explaining_from_csv(spark, sf_dir, tmp_path):
    paths = {}
    for name in ("orders", "items", "customers"):
        paths[name] = str(tmp_path / name)
        files.write_csv(getattr(adapter, name)(spark, sf_dir), paths[name])
    silver, store = str(tmp_path / "silver"), str(tmp_path / "models")
    result = training.run(
        spark, paths["orders"], paths["items"], paths["customers"], silver, store,
        candidates=("gbt",), max_iter=2,
    )
    assert result["model"] == "gbt" and result["roc_auc"] > 0.5
    tables = explain.run(spark, silver, store, str(tmp_path / "shap"), 100, top=3)
    assert tables["contributions"].select("order_id").distinct().count() == 100
    assert tables["bar"].count() == 3
    assert tables["beeswarm"].count() == 300


def test_active_round_moves_ten_rows_and_keeps_the_test_set(spark, sf_dir):
    data = catalog._silver(spark, sf_dir)
    done = active.run_round(data, NUMERIC_FEATURES)
    before, after = done.report.orderBy("labelled").collect()
    assert (before["labelled"], after["labelled"]) == (20, 30)
    assert before["pool"] - after["pool"] == 10 and before["test"] == after["test"]
    assert before["labelled"] + before["pool"] + before["test"] == data.count()
    assert 0 <= before["accuracy"] <= 1 and 0 <= after["accuracy"] <= 1
    labelled_keys = {r["order_id"] for r in done.after.labelled.select("order_id").collect()}
    assert {r["order_id"] for r in done.queried.collect()} <= labelled_keys


def test_entry_returns_rows(spark):
    result = spark_entry.entry(spark)
    assert result.columns == ["customer_state", "delay_rate", "order_count"]
    assert result.count() == 25


def test_every_sql_belongs_to_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


CHECKED = sorted(set(spark_entry.oracle_sql()))


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, name, open_tables(sf_dir)) == ""
