"""Faults of the sixth review: what training and attribution cost on large tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lagline.operators import attribution, boosting, encoding, selection
from lagline.operators.boosting import GradientBoosting, Run
from lagline.operators.candidates import boosting_of, candidate
from lagline.operators.sampling import assign_folds, split_data
from lagline.plans import catalog


@pytest.fixture(scope="module")
def train(spark, sf_dir):
    return assign_folds(split_data(catalog._silver(spark, sf_dir))[0]).persist()


@pytest.fixture(scope="module")
def coarse(train):
    """Training rows whose numbers take at most 20 values, so that Spark's trainer tries every cut."""
    rounded = train.withColumns(
        {name: F.pmod(F.floor(F.col(name) / 7), F.lit(20)).cast("double") for name in ("promised_days", "total_price", "total_freight")}
    )
    return encoding.encoder(impute=True).fit(rounded).transform(rounded).persist()


def raw_of(model, rows):
    found = model.transform(rows).select("order_id", vector_to_array("rawPrediction")[1].alias("raw")).orderBy("order_id")
    return np.array([r["raw"] for r in found.collect()])


@pytest.mark.parametrize("late", [None, 0])
def test_first_order_trees_are_those_of_sparks_trainer(spark, coarse, late):
    """F4 to F14: the gbt candidate was trained apart by Spark, slot by slot and fold by fold."""
    rows = coarse if late is None else coarse.withColumn("is_late", F.lit(late))
    # Each cut lies on a value, where Spark's lie between two: the same rows go left.
    cuts = {n: sorted(r[0] for r in rows.select(f"{n}_imputed").distinct().collect()) for n in encoding.NUMERIC_FEATURES}
    layout = boosting.layout_of(rows, boosting.category_sizes(rows), cuts)
    run = Run(boosting_of("gbt", 12))
    grown = boosting.boost(rows, layout, [run])
    model = boosting.spark_model(spark, layout, run, grown.bases[0], grown.trees[0])
    theirs = GBTClassifier(labelCol="is_late", maxIter=12, maxDepth=3, stepSize=0.1, seed=42).fit(rows)
    assert isinstance(model, GBTClassificationModel)
    assert model.treeWeights == theirs.treeWeights == [1.0, *[0.1] * 11]
    assert np.allclose(raw_of(model, rows), raw_of(theirs, rows), atol=1e-5)
    if late is None:
        assert np.std(raw_of(theirs, rows)) > 0.05
        assert [t.depth for t in model.trees] == [t.depth for t in theirs.trees]


def test_folds_of_the_first_order_equal_separate_fits_by_spark(spark, coarse):
    cuts = {n: sorted(r[0] for r in coarse.select(f"{n}_imputed").distinct().collect()) for n in encoding.NUMERIC_FEATURES}
    layout = boosting.layout_of(coarse, boosting.category_sizes(coarse), cuts)
    runs = [Run(boosting_of("gbt", 4), fold) for fold in (0, 1, 2)] + [Run(boosting_of("deep_gbt", 6), 0)]
    grown = boosting.boost(coarse, layout, runs, fold="fold")
    margins = grown.margins(spark, "bigint").orderBy("key").collect()
    for fold in range(3):
        rest = coarse.filter(F.col("fold") != fold)
        theirs = GBTClassifier(labelCol="is_late", maxIter=4, maxDepth=3, stepSize=0.1, seed=42).fit(rest)
        # A held-out value may lie between two that were seen, above our cut and below Spark's.
        seen = np.array([r["fold"] != fold for r in margins])
        ours, spark_raw = np.array([r["margins"][fold] / 2 for r in margins]), raw_of(theirs, coarse)
        assert np.allclose(ours[seen], spark_raw[seen], atol=1e-5)
        assert np.isclose(ours[~seen], spark_raw[~seen], atol=1e-5).mean() > 0.9


def test_the_gbt_candidate_is_sparks_with_its_parameters(train):
    trees = candidate("gbt", 3).getStages()[-1]
    assert isinstance(trees, GBTClassifier) and isinstance(trees, GradientBoosting)
    assert trees.settings() == boosting_of("gbt", 3)
    found = boosting_of("gbt")
    assert (found.iterations, found.rate, found.max_depth, found.bins, found.order) == (100, 0.1, 3, 32, 1)
    alone = candidate("gbt", 3).fit(train).stages[-1]
    together = selection.fit_candidates(train, ("gbt", "deep_gbt"), max_iter=3)[1]["gbt"].stages[-1]
    assert alone.toDebugString.split("\n", 1)[1] == together.toDebugString.split("\n", 1)[1]


def test_fewer_bins_are_taken_at_even_steps():
    layout = boosting.Layout(
        ("a", "b", "c"), (tuple(map(float, range(64))), (1.0, 2.0), None), (65, 3, 4), (0, 1, 2)
    )
    kept = layout.of_bins(32)
    assert kept[:64].sum() == 31 and kept[64:].all() and len(kept) == len(layout.candidates()["bin"])
    assert set(np.diff(np.flatnonzero(kept[:64]))) <= {2, 3}
    assert layout.of_bins(boosting.MAX_BINS + 1).all()


def test_training_submits_no_fits_of_sparks_trainer(train, monkeypatch):
    """F4 to F14: 100 iterations of Spark's trainer for every fold, next to the passes."""

    def refuse(*_):
        raise AssertionError("trained apart")

    monkeypatch.setattr(GBTClassifier, "_fit_java", refuse)
    scores, models = selection.fit_candidates(train, ("gbt", "deep_gbt"), max_iter=1)
    assert set(scores) == set(models) == {"gbt", "deep_gbt"}


def made_tree(rng, depth, width):
    """Stored nodes of a full tree with random splits, by number and by category."""
    nodes = {}

    def grow(level, rows):
        number = len(nodes)
        nodes[number] = node = {
            "leftChild": -1, "rightChild": -1, "prediction": float(rng.normal()), "rawCount": rows, "split": None,
        }
        if level < depth:
            by_category = rng.uniform() < 0.3
            node["split"] = {
                "featureIndex": int(rng.integers(width)),
                "leftCategoriesOrThreshold": [float(rng.integers(2) if by_category else rng.uniform())],
                "numCategories": 2 if by_category else -1,
            }
            left = int(rows * rng.uniform(0.2, 0.8))
            node["leftChild"], node["rightChild"] = grow(level + 1, left), grow(level + 1, rows - left)
        return number

    grow(0, 1 << 20)
    return nodes


def leaf_by_leaf(matrix, tree):
    """Contributions as a sum over leaves, each looked up in its own table."""
    total = np.zeros(matrix.shape)
    left = {number: split.goes_left(matrix) for number, split in tree.splits.items()}
    for leaf in tree.leaves:
        met = [np.all([left[n] == wanted for n, wanted in turns], axis=0) for turns in leaf.turns]
        line = sum(m.astype(int) << bit for bit, m in enumerate(met))
        table = attribution.shapley_table(leaf.shares, np.arange(1 << len(leaf.slots))) * leaf.value
        for bit, slot in enumerate(leaf.slots):
            total[:, slot] += table[line, bit]
    return total


@pytest.mark.parametrize("bits", [0, 4, 10])
@pytest.mark.parametrize("depth", [0, 1, 3, 5, 7])
def test_leaves_of_a_group_share_a_table(depth, bits, monkeypatch):
    """a row was looked up in every leaf of every tree, slot by slot."""
    monkeypatch.setattr(attribution, "TABLE_BITS", bits)
    rng = np.random.default_rng(depth)
    trees = [attribution.build_tree(made_tree(rng, depth, 6), weight) for weight in (1.0, 0.1)]
    matrix = np.where(rng.uniform(size=(200, 6)) < 0.5, rng.integers(2, size=(200, 6)), rng.uniform(size=(200, 6)))
    matrix[0, 0] = np.nan
    found = attribution.contributions_of(matrix, trees)
    assert np.allclose(found, sum(leaf_by_leaf(matrix, tree) for tree in trees), atol=1e-12)
    assert all(len(tree.leaves) == 2**depth for tree in trees)
    if depth == 5 and bits == 10:
        assert all(len(tree.groups) == 4 and not tree.single for tree in trees)
        assert all(group.table.shape == (len(group.slots), 2**9) for tree in trees for group in tree.groups)
