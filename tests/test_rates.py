"""Rate tables, bins, cumulative shares and summaries."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lagline.functions.bins import PROMISE_EDGES, PROMISE_LABELS, right_closed_bin
from lagline.operators import profile, rates
from lagline.operators.ordered import exact_quantiles, ordered_counts
from pyspark.sql import functions as F

from .conftest import rows


def test_promise_bins_close_on_the_right(spark):
    values = [-1.0, 0.0, 0.5, 1.0, 1.01, 3.0, 5.0, 10.0, 10.01, None, math.nan]
    data = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    labels = right_closed_bin("v", PROMISE_EDGES, PROMISE_LABELS)
    found = [r[1] for r in rows(data.select("i", labels), "i")]
    one, three, five, ten, more = PROMISE_LABELS
    assert found == [None, None, one, one, three, three, five, ten, more, None, None]


def test_bins_reject_bad_definitions():
    with pytest.raises(ValueError):
        right_closed_bin("v", [0.0, 1.0], ["a", "b"])
    with pytest.raises(ValueError):
        right_closed_bin("v", [1.0, 0.0], ["a"])


def test_promised_range_rates_leave_out_unbinned_rows(spark):
    data = spark.createDataFrame(
        [("a", 0.5, 1), ("b", 1.0, 0), ("c", 20.0, 0), ("d", -2.0, 1), ("e", None, 1)],
        "order_id string, promised_days double, is_late int",
    )
    found = rows(rates.delay_by_promised_range(data), "order_count")
    assert found == [(PROMISE_LABELS[-1], 0.0, 1), (PROMISE_LABELS[0], 0.5, 2)]
    assert rates.nonpositive_promises(data).first()[0] == 1


def test_missing_keys_form_no_group(spark):
    data = spark.createDataFrame(
        [("a", 1, 1), ("b", 1, 0), ("c", None, 1), ("d", 3, 0)],
        "order_id string, item_count int, is_late int",
    )
    by_items = rates.delay_by_items(data)
    assert rows(by_items, "item_count") == [(1, 0.5, 2), (3, 0.0, 1)]
    running = rates.cumulative_orders(by_items, "item_count")
    assert rows(running, "item_count") == [(1, 0.5, 2, 2, 2 / 3), (3, 0.0, 1, 3, 1.0)]


def test_support_is_inclusive_and_equal_rates_sort_by_key(spark):
    entries = [(f"{s}{i}", s, 0) for s, n in (("C", 99), ("B", 100), ("A", 101)) for i in range(n)]
    data = spark.createDataFrame(entries, "order_id string, customer_state string, is_late int")
    found = [tuple(r) for r in rates.delay_by_state(data).collect()]
    assert found == [("A", 0.0, 101), ("B", 0.0, 100)]


def test_class_balance_counts_missing_labels(spark):
    data = spark.createDataFrame([(1,), (0,), (0,), (None,)], "is_late int")
    assert rows(rates.class_balance(data), F.col("is_late").asc_nulls_first()) == [
        (None, 1, 0.25),
        (0, 2, 0.5),
        (1, 1, 0.25),
    ]
    assert rates.majority_baseline(data.na.drop()).first()[0] == pytest.approx(2 / 3)


@pytest.mark.parametrize("ranges", [2, 3, 50])
def test_quantiles_do_not_depend_on_the_ranges(spark, ranges):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=301), np.full(150, 0.25)])
    data = spark.createDataFrame([(float(v), 1) for v in values] + [(None, 2)], "v double, w int")
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 0.999}
    found = {
        row["column"]: row for row in exact_quantiles(data, ["v", "w"], wanted, ranges).collect()
    }
    for name, q in wanted.items():
        assert found["v"][name] == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert found["w"]["median"] == 1.0
    assert found["v"]["values"] == len(set(values))


def test_running_totals_match_a_plain_sort(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 40, size=500)
    data = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    found = ordered_counts(data, ["v"], {"n": F.lit(1)}, 7).orderBy("value").collect()
    expected = 0
    for row in found:
        assert row["n_before"] == expected
        expected += row["n"]
        assert row["n_total"] == len(values)
    assert expected == len(values)


def test_describe_handles_constant_and_single_rows(spark):
    one = spark.createDataFrame([(3.0,)], "v double")
    row = profile.describe(one, "v").first()
    assert (row["count"], row["min"], row["median"], row["max"]) == (1, 3.0, 3.0, 3.0)
    approximate = profile.describe(one, "v", approximate=True).first()
    assert approximate["median"] == 3.0


def test_profile_modes_agree_where_both_are_exact(spark):
    data = spark.createDataFrame(
        [(1, "x", 2.5), (2, "y", None), (2, "y", 4.5), (None, "x", 4.5)], "i int, s string, d double"
    )
    exact = {r["column_name"]: r for r in profile.profile_columns(data).collect()}
    rough = {r["column_name"]: r for r in profile.profile_columns(data, approximate=True).collect()}
    for name in data.columns:
        for field in ("value_count", "null_count", "distinct_count", "min_value", "max_text"):
            assert exact[name][field] == rough[name][field]
    assert exact["i"]["distinct_count"] == 2 and exact["d"]["null_count"] == 1
    assert exact["s"]["min_text"] == "x" and exact["d"]["median"] == 4.5


def test_wide_integers_keep_their_distinct_count(spark):
    base = 2**60
    data = spark.createDataFrame([(base,), (base + 1,), (base + 1,)], "k bigint")
    assert profile.profile_columns(data).first()["distinct_count"] == 2


def test_histogram_and_correlation(spark):
    data = spark.createDataFrame([(float(i), -2.0 * i, 7.0) for i in range(10)], "a double, b double, c double")
    bins = rows(profile.histogram(data, ["a", "c"], 3), "column_name", "bin")
    assert [(r[0], r[1], r[4]) for r in bins] == [("a", 0, 3), ("a", 1, 3), ("a", 2, 4), ("c", 0, 10)]
    pairs = profile.correlations(data, ["a", "b"]).first()
    assert pairs["correlation"] == pytest.approx(-1.0)


def test_top_values_limit_before_the_shuffle(spark):
    data = spark.createDataFrame([("x",), ("y",), ("y",), ("z",), (None,)], "s string")
    top = profile.top_values(data, ["s"], 2)
    assert rows(top, "position") == [("s", "y", 2, 1), ("s", "x", 1, 2)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
