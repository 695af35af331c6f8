"""Faults of the fourth review: what a pass of the boosting carries, and how often training reads."""

from __future__ import annotations

import numpy as np
import pytest

from lagline.operators import boosting, selection
from lagline.operators.boosting import BoostingParams, Layout, Run, _Walk
from lagline.operators.sampling import assign_folds, split_data
from lagline.plans import catalog

from .conftest import rows

SIZES = (6, 3, 40, 2, 5)


@pytest.fixture
def block():
    draw = np.random.default_rng(7)
    n = 500
    return {
        "bins": np.array([draw.integers(0, size, n) for size in SIZES], dtype=np.uint8),
        "label": draw.integers(0, 2, n).astype(np.float32), "fold": draw.integers(0, 3, n).astype(np.int32),
        "hash": draw.integers(0, 2**63, n).astype(np.uint64), "key": None,
    }


@pytest.fixture
def layout():
    cuts = (*[tuple(float(x) for x in range(size - 1)) for size in SIZES[:3]], None, None)
    return Layout(tuple("abcde"), cuts, SIZES, (0, 1, 2, 3, 5))


def test_blocks_carry_no_slopes(block):
    """F2 to F15: gradient and hessian of every run travelled with each pass."""
    started = boosting._started(block, [0.0, 0.5])
    walk = _Walk(*(np.array([x]) for x in (-1, 0, False, 0, 0)))
    moved = boosting._moved(started, [walk, walk], [np.array([0.25]), np.array([-1.0])])
    for found, margins in ((started, (0.0, 0.5)), (moved, (0.25, -0.5))):
        arrays = [name for name, value in found.items() if np.ndim(value) == 2]
        assert sorted(arrays) == ["bins", "margins"]
        assert "grad" not in found and "hess" not in found
        assert [set(own) for own in found["margins"]] == [{m} for m in margins]


def test_columns_counted_together_give_their_own_sums(spark, block, layout, monkeypatch):
    params = BoostingParams(iterations=1, rate=0.1, max_depth=2, row_share=0.7)
    runs = [Run(params, 0), Run(params), Run(params, 2)]
    # Splits at the root by column 2, and on its right by the category 3 of column 4.
    walk = _Walk(
        np.array([2, -1, 4, -1, -1]), np.array([11, 0, 3, 0, 0]), np.array([False, False, True, False, False]),
        np.array([1, 0, 3, 0, 0]), np.array([2, 0, 4, 0, 0]),
    )
    bins, label = block["bins"], block["label"]
    started = boosting._started(block, [0.0, 0.3, -0.2])
    assert len(boosting.joint_columns(SIZES)) < len(SIZES)
    assert sorted(sum(boosting.joint_columns(SIZES), [])) == list(range(len(SIZES)))
    blocks = spark.sparkContext.parallelize([started, started], 2)
    together = boosting.histograms(blocks, layout, runs, 0, [walk] * 3, [[1, 3], [4], []])
    monkeypatch.setattr(boosting, "JOINT_CELLS", 1)
    assert len(boosting.joint_columns(SIZES)) == len(SIZES)
    alone = boosting.histograms(blocks, layout, runs, 0, [walk] * 3, [[1, 3], [4], []])
    assert all(np.array_equal(a, b) for a, b in zip(together, alone))
    places = {
        1: bins[2] <= 11, 3: (bins[2] > 11) & (bins[4] != 3), 4: (bins[2] > 11) & (bins[4] == 3),
    }
    drawn = boosting._drawn(block["hash"], 0.7, params.seed, 0)
    for run, base, nodes, found in zip(runs, (0.0, 0.3), ([1, 3], [4]), together):
        p = 1 / (1 + np.exp(-base))
        slopes = [np.rint((p - label.astype(float)) * boosting.UNIT), np.full(len(label), np.rint(p * (1 - p) * boosting.UNIT))]
        for place, node in enumerate(nodes):
            own = places[node] & drawn & (block["fold"] != (-1 if run.fold is None else run.fold))
            for column, size in enumerate(SIZES):
                for at, weights in enumerate([*slopes, np.ones(len(label))]):
                    expected = [2 * int(weights[own & (bins[column] == b)].sum()) for b in range(size)]
                    begin = layout.offsets[column]
                    assert found[at, place, begin : begin + size].tolist() == expected
    assert together[2].shape == (3, 0, sum(SIZES))


def test_nodes_past_one_byte_are_found():
    """A chain of 200 splits: node numbers up to 400."""
    inner = 200
    column = np.array([0] + [-1, 0] * (inner - 1) + [-1, -1])
    left = np.array([2 * (i // 2) + 1 if c >= 0 else 0 for i, c in enumerate(column)])
    walk = _Walk(column, np.arange(len(column)) // 2, np.zeros(len(column), bool), left, left + (left > 0))
    bins = np.arange(201, dtype=np.int16)[None, :]
    found = walk.nodes_at(bins)
    assert found.tolist() == [*range(1, 2 * inner, 2), 2 * inner]


def test_training_reads_its_rows_once(spark, sf_dir):
    """F2 to F15: every fit and scan drew the split and the folds again."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    train = assign_folds(split_data(catalog._silver(spark, sf_dir))[0]).persist()
    counted = train.mapInArrow(seen, train.schema)
    scores, models = selection.fit_candidates(counted, ("gbt", "deep_gbt"), max_iter=1)
    assert read.value == train.count()
    assert {name: model.stages[-1].getNumTrees for name, model in models.items()} == {"gbt": 1, "deep_gbt": 1}
    columns = ["order_id", "is_late", "fold"]
    for found in scores.values():
        assert rows(found.select(columns), "order_id") == rows(train.select(columns), "order_id")
    train.unpersist()
