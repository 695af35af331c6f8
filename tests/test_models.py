"""Encoding, training, the model store, scoring and attribution."""

from __future__ import annotations

import itertools
import math
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lagline.operators import attribution, encoding, scoring, selection
from lagline.operators.candidates import CANDIDATE_PARAMS, candidate
from lagline.operators.orders import model_input
from lagline.operators.sampling import split_data
from lagline.plans import catalog
from lagline.session import scratch_path
from lagline.sources import files, models

from .conftest import rows


@pytest.fixture(scope="module")
def silver(spark, sf_dir):
    return catalog._silver(spark, sf_dir).persist()


@pytest.fixture(scope="module")
def store(spark, silver):
    folder = scratch_path(spark, "store")
    train, _ = split_data(silver)
    selection.train_model("gbt", train, 0.2, folder, max_iter=4)
    return folder


def test_unseen_and_missing_values_get_the_last_slot(spark, silver):
    model = encoding.encoder().fit(silver)
    odd = silver.limit(1).withColumn("customer_state", F.lit("NOWHERE")).unionByName(
        silver.limit(1).withColumn("customer_state", F.lit(None).cast("string"))
    )
    width = silver.select("customer_state").distinct().count()
    slots = model.transform(odd).select(vector_to_array("customer_state_ohe").alias("v")).collect()
    assert all(r["v"] == [0.0] * width + [1.0] for r in slots)


def test_missing_number_is_nan_unless_imputed(silver):
    gap = silver.limit(1).withColumn("total_price", F.lit(None).cast("double"))
    plain = encoding.encoder().fit(silver).transform(gap)
    assert math.isnan(plain.select(vector_to_array("features")[3]).first()[0])
    filled = encoding.encoder(impute=True).fit(silver).transform(gap)
    mean = silver.agg(F.avg("total_price")).first()[0]
    assert filled.select(vector_to_array("features")[3]).first()[0] == pytest.approx(mean)


def test_slot_names_do_not_show_the_imputer(silver):
    plain = encoding.vector_names(encoding.encoder().fit(silver).transform(silver))
    imputed = encoding.vector_names(encoding.encoder(impute=True).fit(silver).transform(silver))
    assert plain == imputed
    assert plain[:2] == ["promised_days", "item_count"]
    assert encoding.source_column(plain[-1]) == "customer_state"


@pytest.mark.parametrize("name", sorted(CANDIDATE_PARAMS))
def test_candidates_fit_and_survive_odd_rows(silver, name):
    model = candidate(name, 2).fit(silver)
    odd = silver.limit(1).withColumn("customer_state", F.lit("NOWHERE")).withColumn(
        "item_count", F.lit(None).cast("double")
    )
    score = selection.with_probability(model, odd).first()["probability_positive"]
    assert 0.0 <= score <= 1.0


def test_candidate_settings():
    trees = candidate("gbt").getStages()[-1]
    assert (trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize()) == (100, 3, 0.1)
    with pytest.raises(ValueError, match="unknown model"):
        candidate("other")


def test_store_round_trip(spark, store, silver):
    assert models.load_metadata(spark, store) == ("gbt", 0.2)
    model = models.load_model(store)
    _, test = split_data(silver)
    scored = scoring.predict(model, test, 0.2)
    wrong = scored.filter((F.col("prediction") == 1) != (F.col("probability_positive") >= 0.2))
    assert scored.count() == test.count() and wrong.count() == 0
    models.save_metadata(spark, store, "gbt", 0.2)
    with pytest.raises(Exception):
        models.load_metadata(spark, store + "-absent")


def test_scoring_job_writes_gold_without_vectors(spark, store, silver):
    path = scratch_path(spark, "silver")
    files.save_dataset(silver, path)
    gold = scoring.score_orders(spark, store, path, scratch_path(spark, "gold"))
    assert gold.columns == [*silver.columns, "probability_positive", "prediction"]
    assert gold.count() == silver.count()
    again = scoring.score_orders(spark, store, path, scratch_path(spark, "gold"))
    assert rows(gold, "order_id") == rows(again, "order_id")


def test_out_of_fold_scores_every_row_once(silver):
    from lagline.operators.sampling import assign_folds

    scored = selection.out_of_fold(assign_folds(silver), "gbt", max_iter=2)
    assert scored.count() == silver.count()
    assert scored.select("order_id").distinct().count() == silver.count()


def test_selection_and_evaluation(silver):
    train, test = split_data(silver)
    results = selection.cross_validation_results(train, max_iter=2)
    assert [r["model_name"] for r in results.orderBy("candidate_order").collect()] == ["gbt", "deep_gbt"]
    name, threshold = selection.cross_validate_models(train, ("gbt",), max_iter=2)
    assert name == "gbt" and 0.05 <= threshold <= 0.5
    model = selection.train_model(name, train, threshold, max_iter=2)
    result = selection.evaluate_model(model, name, test, threshold)
    assert list(result) == ["model", "threshold", "precision", "recall", "f1", "roc_auc"]
    assert 0.4 < result["roc_auc"] <= 1.0
    with pytest.raises(ValueError):
        selection.train_model("other", train, 0.5)


def brute_force(tree, leaf_weight, row, width):
    """Shapley values from the definition, withholding features by cover share."""

    def expected(node, known):
        entry = tree[node]
        if entry["leftChild"] < 0:
            return entry["prediction"] * leaf_weight
        slot = entry["split"]["featureIndex"]
        values = entry["split"]["leftCategoriesOrThreshold"]
        if slot in known:
            if entry["split"]["numCategories"] == -1:
                left = row[slot] <= values[0]
            else:
                left = row[slot] in values
            return expected(entry["leftChild" if left else "rightChild"], known)
        return sum(
            tree[entry[side]]["rawCount"] / entry["rawCount"] * expected(entry[side], known)
            for side in ("leftChild", "rightChild")
        )

    result = []
    for i in range(width):
        others = [j for j in range(width) if j != i]
        total = 0.0
        for size in range(width):
            weight = factorial(size) * factorial(width - size - 1) / factorial(width)
            for chosen in itertools.combinations(others, size):
                total += weight * (expected(0, {*chosen, i}) - expected(0, set(chosen)))
        result.append(total)
    return result


@pytest.mark.parametrize("table_bits", [0, 10])
@pytest.mark.parametrize("iterations", [1, 3])
def test_contributions_equal_brute_force(spark, iterations, table_bits, monkeypatch):
    monkeypatch.setattr(attribution, "TABLE_BITS", table_bits)
    rng = np.random.default_rng(iterations)
    data = spark.createDataFrame(
        [
            (i, float(a), float(b), float(c), int(a + b * c > 0.3))
            for i, (a, b, c) in enumerate(rng.normal(size=(60, 3)).round(2))
        ],
        "order_id int, a double, b double, c double, is_late int",
    )
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"),
            GBTClassifier(labelCol="is_late", maxIter=iterations, maxDepth=3, seed=1),
        ]
    )
    path = scratch_path(spark, "small-trees")
    model = pipeline.fit(data)
    model.write().overwrite().save(path)
    trees = attribution.read_trees(spark, path)
    matrix = np.array(data.select("a", "b", "c").collect())
    found = attribution.contributions_of(matrix, trees)

    stored = spark.read.parquet(f"{path}/stages/*_{model.stages[-1].uid}/data")
    nodes = {}
    for r in stored.select("treeID", "nodeData.*").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    weights = model.stages[-1].treeWeights
    for line in (0, 17, 59):
        expected = np.sum(
            [brute_force(nodes[t], w, matrix[line], 3) for t, w in enumerate(weights)], axis=0
        )
        assert found[line] == pytest.approx(expected, abs=1e-10)


def test_contributions_add_up_to_the_log_odds(spark, store, silver):
    path = models.model_path(store)
    long, base = attribution.shap_values(spark, path, silver)
    sums = long.groupBy("order_id").agg(F.sum("contribution").alias("total"))
    probability = selection.with_probability(models.load_model(store), silver)
    p = F.col("probability_positive")
    gap = (
        probability.withColumn("log_odds", F.log(p / (1 - p)))
        .join(sums, "order_id")
        .agg(F.max(F.abs(F.lit(base) + F.col("total") - F.col("log_odds"))), F.count("*"))
        .first()
    )
    assert gap[0] < 1e-6 and gap[1] == silver.count()


def test_rolled_up_contributions_keep_the_sum(spark, store, silver):
    path = models.model_path(store)
    model = models.load_model(store)
    vectors = attribution.shap_input(model, silver, 50)
    assert vectors.count() == 50
    arrays = attribution.shap_arrays(vectors, attribution.read_trees(spark, path))
    names = encoding.vector_names(vectors)
    rolled = attribution.by_source(arrays, names)
    assert rolled.count() == 50 * 9
    total = F.sum("contribution").alias("t")
    fine = rows(attribution.long_contributions(arrays, names).groupBy("order_id").agg(total), "order_id")
    coarse = rows(rolled.groupBy("order_id").agg(total), "order_id")
    assert [f[1] for f in fine] == pytest.approx([c[1] for c in coarse], abs=1e-9)


def test_other_models_are_refused(spark, silver):
    stages = [VectorAssembler(inputCols=["item_count"], outputCol="features")]
    stages.append(LogisticRegression(labelCol="is_late", maxIter=1))
    path = scratch_path(spark, "logistic")
    Pipeline(stages=stages).fit(silver).write().save(path)
    with pytest.raises(TypeError, match="not a tree ensemble"):
        attribution.read_trees(spark, path)


def test_bar_and_beeswarm_tables(spark):
    long = spark.createDataFrame(
        [(1, "a", 0.0, 2.0), (2, "a", 4.0, -2.0), (1, "b", 1.0, 1.0), (2, "b", 1.0, 1.0), (1, "c", 0.0, 0.5), (2, "c", 1.0, -0.5)],
        "order_id int, feature string, value double, contribution double",
    )
    table = attribution.importance(long)
    assert rows(attribution.top_with_other(table, 1), "position") == [(1, "a", 2.0, 1), (2, "other", 1.5, 2)]
    bees = attribution.beeswarm(long, table, 2).select("feature", "order_id", "scaled_value", "position")
    assert rows(bees, "feature", "order_id") == [
        ("a", 1, 0.0, 1), ("a", 2, 1.0, 1), ("b", 1, None, 2), ("b", 2, None, 2),
    ]


def test_no_python_outside_the_attribution_step(spark, sf_dir):
    for name in ("order_features", "delay_by_state", "threshold_curve", "predict", "dq_failures"):
        text = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "MapInArrow" not in text, name


def test_model_input_can_drop_the_key(spark, sf_dir):
    assert "order_id" not in model_input(catalog._mart(spark, sf_dir), key=None).columns
