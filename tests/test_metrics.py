"""Threshold search, confusion counts and ROC area."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

from lagline.functions.scores import threshold_label
from lagline.operators import active, metrics

from .conftest import rows

COLUMNS = "is_late int, probability_positive double"


def frame(spark, entries):
    return spark.createDataFrame([(label, score) for label, score in entries], COLUMNS)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    entries = []
    for _ in range(2000):
        late = int(rng.random() < 0.2)
        # Whole percents, so that many scores lie exactly on a threshold.
        entries.append((late, min(99, max(0, round(rng.gauss(25 + 15 * late, 12)))) / 100))
    return frame(spark, entries).persist()


def test_threshold_label_is_inclusive(spark):
    data = frame(spark, [(0, 0.16), (0, 0.1599), (0, None)])
    found = [r[0] for r in data.select(threshold_label(0.16)).collect()]
    assert found == [1, 0, 0]


def test_curve_equals_one_evaluation_per_threshold(scored):
    curve = {r["threshold"]: r for r in metrics.threshold_curve(scored).collect()}
    assert sorted(curve) == metrics.THRESHOLDS
    evaluator = MulticlassClassificationEvaluator(
        labelCol="is_late", predictionCol="p", metricName="fMeasureByLabel", metricLabel=1.0
    )
    for threshold in (0.05, 0.16, 0.29, 0.35, 0.5):
        labelled = scored.withColumn("p", threshold_label(threshold).cast("double"))
        assert curve[threshold]["f1"] == pytest.approx(evaluator.evaluate(labelled))
        single = metrics.confusion_metrics(scored, threshold).first()
        for name in ("tp", "fp", "fn", "precision", "recall", "f1"):
            assert single[name] == curve[threshold][name]


def test_best_threshold_is_the_lowest_of_equals(spark):
    tied = frame(spark, [(1, 0.9), (1, 0.8), (0, 0.1)])
    assert metrics.find_best_threshold(tied) == (0.11, 1.0)


def test_degenerate_scores(spark):
    nothing_positive = frame(spark, [(0, 0.4), (0, 0.2)])
    assert metrics.find_best_threshold(nothing_positive) == (0.05, 0.0)
    assert metrics.roc_auc(nothing_positive).first()[0] is None
    nothing_predicted = frame(spark, [(1, 0.01), (0, 0.02)])
    row = metrics.confusion_metrics(nothing_predicted, 0.5).first()
    assert (row["precision"], row["recall"], row["f1"], row["fn"]) == (0.0, 0.0, 0.0, 1)
    all_equal = frame(spark, [(1, 0.3), (0, 0.3), (0, 0.3)])
    assert metrics.roc_auc(all_equal).first()[0] == 0.5
    empty = frame(spark, [])
    assert metrics.confusion_metrics(empty, 0.5).first()["f1"] == 0.0
    assert metrics.find_best_threshold(empty) == (0.05, 0.0)


def test_missing_and_nan_scores_follow_the_comparison(spark):
    data = frame(spark, [(1, None), (1, math.nan), (0, 0.3)])
    curve = {r["threshold"]: r for r in metrics.threshold_curve(data).collect()}
    single = metrics.confusion_metrics(data, 0.5).first()
    assert (curve[0.5]["tp"], curve[0.5]["fp"], curve[0.5]["fn"]) == (1, 0, 1)
    assert (single["tp"], single["fp"], single["fn"]) == (1, 0, 1)


@pytest.mark.parametrize("ranges", [2, 8, 200])
def test_auc_equals_the_unbinned_evaluator(scored, ranges):
    exact = BinaryClassificationEvaluator(
        labelCol="is_late", rawPredictionCol="probability_positive", numBins=0
    ).evaluate(scored)
    assert metrics.roc_auc(scored, ranges=ranges).first()[0] == pytest.approx(exact, abs=1e-12)


def test_accuracy(spark):
    data = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 1)], "is_late int, prediction int")
    assert metrics.accuracy(data).first()[0] == 0.75


def test_first_listed_candidate_wins_ties(spark):
    good = frame(spark, [(1, 0.9), (0, 0.1)])
    results = metrics.candidate_results({"zeta": good, "alpha": good})
    assert metrics.best_candidate(results).first()["model_name"] == "zeta"


def test_equal_distance_prefers_the_lower_key(spark):
    data = spark.createDataFrame(
        [(3, 0.6), (1, 0.4), (2, 0.5), (4, 0.9)], "order_id int, probability_positive double"
    )
    found = [r["order_id"] for r in active.most_uncertain(data, 3).collect()]
    assert found[0] == 2 and set(found) == {1, 2, 3}
    plan = active.most_uncertain(data, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_curve_never_multiplies_rows(scored):
    plan = metrics.threshold_curve(scored)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Generate" not in plan


def test_queried_rows_move_from_pool_to_labelled(spark):
    columns = "order_id int, is_late int"
    labelled = spark.createDataFrame([(1, 0), (2, 1)], columns)
    pool = spark.createDataFrame([(3, 0), (4, 1), (5, 0)], columns)
    queried = spark.createDataFrame([(4, 0.5)], "order_id int, probability_positive double")
    after, rest = active.move_queried(labelled, pool, queried, pool)
    assert rows(after, "order_id") == [(1, 0), (2, 1), (4, 1)]
    assert rows(rest, "order_id") == [(3, 0), (5, 0)]


def test_a_labelled_set_with_one_class_is_refused(spark):
    data = spark.range(100).selectExpr("id AS order_id", "0 AS is_late")
    with pytest.raises(ValueError, match="at least two"):
        active.partition(data)
