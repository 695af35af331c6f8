"""Faults of the fifth review: what a query of a fitted model waits for, and what a profile carries."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest

from lagline.operators import boosting, profile, selection
from lagline.operators.boosting import _Walk
from lagline.operators.sampling import assign_folds, split_data
from lagline.plans import catalog

from .conftest import rows


def test_a_query_waits_only_for_the_fits_it_uses(spark, sf_dir, monkeypatch):
    """F3 to F14: every query of one model trained all candidates, out of fold and on all rows."""
    asked = []

    def fit(folded, candidates, folds=3, **more):
        asked.append((candidates, folds, more.get("final", True)))
        return dict.fromkeys(candidates, "scores"), dict.fromkeys(candidates, "model")

    monkeypatch.setattr(catalog, "_SHARED", {})
    monkeypatch.setattr(selection, "fit_candidates", fit)
    for _ in range(2):
        assert catalog._trained(spark, sf_dir, "deep_gbt") == "model"
    assert asked == [(("deep_gbt",), 0, True)]
    assert set(catalog._fold_scores(spark, sf_dir)) == {"gbt", "deep_gbt"}
    assert asked[1:] == [(("gbt", "deep_gbt"), 3, False)]
    catalog._trained(spark, sf_dir, "leafwise")
    assert asked[2:] == [(("leafwise",), 3, True)]


@pytest.mark.parametrize("name", ["gbt", "deep_gbt", "leafwise"])
def test_a_model_fitted_alone_is_the_one_fitted_with_folds(spark, sf_dir, name):
    folded = assign_folds(split_data(catalog._silver(spark, sf_dir))[0])
    scores, alone = selection.fit_candidates(folded, (name,), folds=0, max_iter=2)
    _, together = selection.fit_candidates(folded, (name,), max_iter=2)
    assert scores == {}
    trees = [found[name].stages[-1].toDebugString.split("\n", 1)[1] for found in (alone, together)]
    assert trees[0] == trees[1]
    held_out, models = selection.fit_candidates(folded, (name,), max_iter=2, final=False)
    assert models == {}
    assert rows(held_out[name].select("order_id", "fold"), "order_id") == rows(folded.select("order_id", "fold"), "order_id")


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_rows_find_their_node_in_trees_of_any_size(kind):
    """A chain of splits by number and by category; node numbers of one byte and of two."""
    inner = 100 if kind == np.uint8 else 300
    column = np.array([0] + [-1, 0] * (inner - 1) + [-1, -1])
    assert np.min_scalar_type(len(column)) == kind
    left = np.array([2 * (i // 2) + 1 if c >= 0 else 0 for i, c in enumerate(column)])
    by_category = np.zeros(len(column), bool)
    # The first split sends bin 0 to the right, the others what lies above their bin.
    by_category[0] = True
    walk = _Walk(column, np.arange(len(column)) // 2, by_category, left, left + (left > 0))
    bins = np.arange(inner + 1, dtype=np.int16)[None, :]
    assert walk.nodes_at(bins).tolist() == [3] + [1] * inner
    wanted = dict(walk.rows_at(bins, np.arange(1, inner + 1), {1, 3}))
    assert {node: len(own) for node, own in wanted.items()} == {1: inner, 3: 0}


def test_blocks_hold_more_rows_than_are_counted_at_once():
    """F3 to F14: every 30,000 rows added a table of all cells to a pass."""
    assert boosting.BLOCK_ROWS > boosting.COUNTED_ROWS
    assert boosting.COUNTED_ROWS < 2**15


def test_entries_are_counted_in_their_own_type(spark):
    """every entry carried the name of its column and the text of its value through the shuffle."""
    big = 2**60
    data = spark.createDataFrame(
        [
            (big, 1.5, dt.datetime(2020, 1, 1, 0, 0, 0, 5), dt.date(2020, 1, 2), Decimal("0.10"), "b", True),
            (big + 1, None, dt.datetime(2020, 1, 1), dt.date(999, 1, 2), Decimal("-7.00"), "", None),
            (big, float("nan"), None, None, None, None, True),
            (None, 1.5, dt.datetime(2020, 1, 1), dt.date(2020, 1, 2), Decimal("0.10"), "b", True),
        ],
        "k bigint, x double, at timestamp_ntz, day date, price decimal(12,2), s string, ok boolean",
    )
    cells = profile.cell_counts(data)
    assert {r["column"] for r in cells.filter("text IS NOT NULL").collect()} == {"at", "day", "s", "ok"}
    assert cells.filter("column = 'k' AND value IS NOT NULL").count() == 2
    found = {r["column_name"]: r for r in profile.profile_columns(data).collect()}
    counts = {name: tuple(r)[1:4] for name, r in found.items()}
    assert counts == {
        "k": (3, 1, 2), "x": (3, 1, 2), "at": (3, 1, 2), "day": (3, 1, 2), "price": (3, 1, 2), "s": (3, 1, 2), "ok": (3, 1, 1),
    }
    texts = {name: (r["min_text"], r["max_text"]) for name, r in found.items()}
    assert texts["at"] == ("2020-01-01 00:00:00", "2020-01-01 00:00:00.000005")
    assert texts["day"] == ("0999-01-02", "2020-01-02") and texts["s"] == ("", "b") and texts["ok"] == ("true", "true")
    assert texts["k"] == texts["x"] == texts["price"] == (None, None)
    assert (found["price"]["min_value"], found["price"]["median"], found["k"]["median"]) == (-7.0, 0.1, float(big))


def test_profiles_of_only_numbers_only_texts_and_no_rows(spark):
    data = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for part in (data, data.select("i"), data.select("s"), data.limit(0)):
        found = profile.profile_columns(part).collect()
        assert sorted(r["column_name"] for r in found) == sorted(part.columns)
        assert [r["value_count"] + r["null_count"] for r in found] == [part.count()] * len(part.columns)


def test_texts_are_not_sorted_to_find_their_range(spark):
    """the smallest and largest text by column sorted all counts."""
    data = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    plan = profile._text_ranges(profile.cell_counts(data), ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "hashpartitioning" not in plan
