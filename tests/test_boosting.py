"""Second-order boosting: sums, splits, growth orders, folds in the same passes."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lagline.operators import boosting, encoding, selection
from lagline.operators.boosting import BoostingParams, Node, Run
from lagline.operators.candidates import candidate, settings_of
from lagline.operators.sampling import assign_folds, fold_parts, split_data
from lagline.plans import catalog

PLAIN = BoostingParams(iterations=3, rate=0.3, max_depth=2)


@pytest.fixture(scope="module")
def train(spark, sf_dir):
    return assign_folds(split_data(catalog._silver(spark, sf_dir))[0]).persist()


@pytest.fixture(scope="module")
def encoded(train):
    return encoding.encoder(impute=True).fit(train).transform(train).persist()


@pytest.fixture(scope="module")
def layout(encoded):
    return boosting.layout_of(encoded, boosting.category_sizes(encoded))


def shape(tree):
    return [(n.depth, n.rows, n.grad, n.hess, n.split, n.children, round(v, 12)) for n, v in zip(tree.nodes, tree.values)]


def dense(encoded):
    """Slots of every row as plain numbers, with label."""
    rows = encoded.select("features", "is_late").collect()
    return np.array([r["features"].toArray() for r in rows]), np.array([r["is_late"] for r in rows])


def grow_by_hand(matrix, label, margins, params, thresholds):
    """One tree by trying every slot and cut of every node, recursively."""
    p = 1 / (1 + np.exp(-margins))
    grad, hess = np.rint((p - label) * boosting.UNIT), np.rint(p * (1 - p) * boosting.UNIT)
    out = np.zeros(len(label))

    def term(rows):
        g, h = grad[rows].sum() / boosting.UNIT, hess[rows].sum() / boosting.UNIT
        return g * g / (h + params.l2)

    def split(rows, depth):
        g, h = grad[rows].sum() / boosting.UNIT, hess[rows].sum() / boosting.UNIT
        out[rows] = -g / (h + params.l2) * params.rate
        if depth == params.max_depth:
            return
        best = (boosting.MIN_GAIN, None)
        for slot, cuts in enumerate(thresholds):
            for cut in cuts:
                left = rows & (matrix[:, slot] <= cut)
                right = rows & ~left
                sides = [left, right]
                if min(s.sum() for s in sides) < max(1, params.min_rows):
                    continue
                if min(hess[s].sum() for s in sides) < params.min_hessian * boosting.UNIT:
                    continue
                gain = term(left) + term(right) - term(rows)
                if gain > best[0] + 1e-12:
                    best = (gain, (left, right))
        if best[1] is not None:
            for side in best[1]:
                split(side, depth + 1)

    split(np.ones(len(label), bool), 0)
    return out


@pytest.mark.parametrize("params", [PLAIN, replace(PLAIN, l2=0.0, min_hessian=0.001, min_rows=20)])
def test_trees_equal_those_grown_by_hand(spark, encoded, layout, params):
    matrix, label = dense(encoded)
    found = boosting.boost(encoded, layout, [Run(params)])
    split_rows = layout.candidates()
    thresholds = [
        split_rows["threshold"][split_rows["slot"] == slot].tolist() for slot in range(layout.slots)
    ]
    margins = np.full(len(label), math.log(label.mean() / (1 - label.mean())))
    for _ in range(params.iterations):
        margins = margins + grow_by_hand(matrix, label, margins, params, thresholds)
    rows = found.margins(spark, "bigint").orderBy("key").collect()
    order = np.argsort([r["order_id"] for r in encoded.select("order_id").collect()])
    assert np.allclose([r["margins"][0] for r in rows], margins[order], atol=1e-9)


def test_all_folds_together_equal_separate_fits(spark, encoded, layout):
    params = [settings_of("deep_gbt", 3), settings_of("leafwise", 3), replace(PLAIN, iterations=2)]
    runs = [Run(p, fold) for p in params for fold in (0, 1, None)]
    together = boosting.boost(encoded, layout, runs, fold="fold")
    for run, trees, base in zip(runs, together.trees, together.bases):
        rows = encoded if run.fold is None else encoded.filter(F.col("fold") != run.fold)
        alone = boosting.boost(rows, layout, [Run(run.params)])
        assert alone.bases == [base]
        assert [shape(t) for t in alone.trees[0]] == [shape(t) for t in trees[: run.params.iterations]]


def test_partitions_do_not_matter(spark, encoded, layout, monkeypatch):
    run = Run(settings_of("deep_gbt", 2))
    one = boosting.boost(encoded.coalesce(1), layout, [run])
    monkeypatch.setattr(boosting, "MOST_ROWS_PER_TASK", 10)
    monkeypatch.setattr(boosting, "TREE_REDUCE_FROM", 2)
    monkeypatch.setattr(boosting, "CHECKPOINT_EVERY", 1)
    many = boosting.boost(encoded.repartition(7), layout, [run])
    assert many.blocks.getNumPartitions() > 7
    assert [shape(t) for t in one.trees[0]] == [shape(t) for t in many.trees[0]]


def test_a_share_of_rows_and_columns_is_drawn_by_hash(encoded, layout):
    run = Run(replace(PLAIN, iterations=4, row_share=0.5, column_share=0.2))
    trees = boosting.boost(encoded, layout, [run]).trees[0]
    rows = encoded.count()
    assert all(0.35 * rows < t.nodes[0].rows < 0.65 * rows for t in trees)
    assert len({t.nodes[0].rows for t in trees}) > 1
    slots = layout.candidates()["slot"]
    for number, tree in enumerate(trees):
        allowed = boosting.drawn_slots(layout.slots, 0.2, 42, number)
        assert allowed.sum() == int(0.2 * layout.slots)
        assert all(allowed[slots[n.split]] for n in tree.nodes if n.children)


def leaves(tree):
    return sum(not n.children for n in tree.nodes)


def test_growth_by_leaf_takes_the_largest_gains(encoded, layout):
    """Equal to the full tree cut down by a queue, for every leaf limit."""
    full_params = BoostingParams(iterations=1, rate=0.1, max_depth=4, l2=0.0, min_rows=5, min_hessian=0.001)
    full = boosting.boost(encoded, layout, [Run(full_params)]).trees[0][0]
    limits = range(1, leaves(full) + 2)
    runs = [Run(replace(full_params, max_leaves=limit)) for limit in limits]
    for limit, trees in zip(limits, boosting.boost(encoded, layout, runs).trees):
        open_leaves, taken = {0}, []
        while len(open_leaves) < limit:
            splittable = [i for i in open_leaves if full.nodes[i].children]
            if not splittable:
                break
            best = min(splittable, key=lambda i: (-full.nodes[i].gain, i))
            open_leaves = open_leaves - {best} | set(full.nodes[best].children)
            taken.append(round(full.nodes[best].gain, 9))
        found = sorted(round(n.gain, 9) for n in trees[0].nodes if n.children)
        assert found == sorted(taken) and leaves(trees[0]) == len(open_leaves)


def test_a_leaf_that_is_not_reached_is_cut_off():
    nodes = [
        Node(0, 0, 0, 9, 5.0, 0, None, (1, 2)), Node(1, 0, 0, 5, 3.0, 1, None, (3, 4)), Node(1, 0, 0, 4, 4.0, 2, None, (5, 6)),
        Node(2, 0, 0, 2), Node(2, 0, 0, 3), Node(2, 0, 0, 1), Node(2, 0, 0, 3),
    ]
    kept = boosting.cut_back(nodes, BoostingParams(1, 0.1, 5, max_leaves=3))
    assert [(n.rows, n.children) for n in kept] == [(9, (1, 2)), (5, None), (4, (3, 4)), (1, None), (3, None)]


@pytest.mark.parametrize("name", ["deep_gbt", "leafwise"])
def test_the_stored_model_scores_like_the_passes(spark, train, name):
    scores, models = selection.fit_boosted(train, {name: settings_of(name, 4)}, folds=2)
    model = models[name]
    trees = model.stages[-1]
    assert trees.getNumTrees == 4 and trees.getMaxDepth() == 5
    assert all(t.depth <= 5 for t in trees.trees)
    limit = settings_of(name).max_leaves or 32
    assert all((t.numNodes + 1) // 2 <= limit for t in trees.trees)
    path = str(spark.conf.get("spark.checkpoint.dir")) + f"/stored-{name}"
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    for _, held_out in (fold_parts(train, 0),):
        both = selection.with_probability(model, held_out).select("order_id", "probability_positive")
        other = selection.with_probability(again, held_out).select("order_id", F.col("probability_positive").alias("p"))
        assert both.join(other, "order_id").filter("probability_positive <> p").count() == 0
    assert scores[name].count() == train.count()


def test_final_model_margins_match(spark, train):
    """The fitted pipeline and the blocks' own margins agree on all rows."""
    encoder = encoding.encoder(impute=True).fit(train)
    rows = encoder.transform(train)
    layout = boosting.layout_of(rows, boosting.category_sizes(rows))
    run = Run(settings_of("deep_gbt", 5))
    grown = boosting.boost(rows, layout, [run])
    model = PipelineModel([*encoder.stages, boosting.spark_model(spark, layout, run, grown.bases[0], grown.trees[0])])
    both = selection.with_probability(model, train).join(
        grown.margins(spark, "bigint"), F.col("key") == F.col("order_id")
    )
    gap = F.abs(F.col("probability_positive") - 1 / (1 + F.exp(-F.col("margins")[0])))
    assert both.agg(F.max(gap)).first()[0] < 1e-12 and both.count() == train.count()


def test_one_class_and_no_rows(spark, train):
    for rows, low, high in (
        (train.withColumn("is_late", F.lit(0)), 0.0, 0.001),
        (train.withColumn("is_late", F.lit(1)), 0.999, 1.0),
        (train.limit(0), 0.5, 0.5),
    ):
        encoder = encoding.encoder(impute=False).fit(train)
        ready = encoder.transform(rows)
        ready = ready.withColumns({f"{n}_imputed": F.col(n).cast("double") for n in encoding.NUMERIC_FEATURES})
        layout = boosting.layout_of(ready, boosting.category_sizes(ready), catalog.SMALL_CUTS)
        grown = boosting.boost(ready, layout, [Run(PLAIN)])
        model = boosting.spark_model(spark, layout, Run(PLAIN), grown.bases[0], grown.trees[0])
        scored = model.transform(encoder.transform(train)).withColumn("p", selection.positive_probability())
        bounds = scored.agg(F.min("p"), F.max("p")).first()
        assert low <= bounds[0] and bounds[1] <= high


def test_candidates_differ(silver_model_pair):
    deep, leafwise = silver_model_pair
    assert deep.stages[-1].toDebugString != leafwise.stages[-1].toDebugString


@pytest.fixture(scope="module")
def silver_model_pair(train):
    return [candidate(name, 2).fit(train) for name in ("deep_gbt", "leafwise")]
