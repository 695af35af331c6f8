"""Model selection by out-of-fold F1, training and evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagline.functions.scores import positive_probability
from lagline.operators.boosting import (
    BoostingParams,
    Run,
    boost,
    category_sizes,
    layout_of,
    spark_model,
)
from lagline.operators.candidates import DEFAULT_CANDIDATES, boosting_of, candidate
from lagline.operators.encoding import encoder
from lagline.operators.metrics import (
    best_candidate,
    candidate_results,
    confusion_metrics,
    roc_auc,
)
from lagline.operators.sampling import assign_folds
from lagline.schemas import ORDER_KEY, SCORE, TARGET
from lagline.session import scratch_path
from lagline.sources.files import save_dataset
from lagline.sources.models import save_metadata, save_model


def with_probability(model: PipelineModel, data: DataFrame) -> DataFrame:
    return model.transform(data).withColumn(SCORE, positive_probability())


def out_of_fold(
    folded: DataFrame,
    model_name: str,
    folds: int = 3,
    max_iter: int | None = None,
    key: str = ORDER_KEY,
) -> DataFrame:
    """Each row scored by the model that did not see it: key, label, probability, fold.

    ``fold`` is written by the scoring itself: the number of the fold that was held
    out when the row's model was fitted.
    """
    return out_of_fold_runs(folded, (model_name,), folds, max_iter, key)[model_name]


def out_of_fold_runs(
    folded: DataFrame,
    candidates: tuple[str, ...] = DEFAULT_CANDIDATES,
    folds: int = 3,
    max_iter: int | None = None,
    key: str = ORDER_KEY,
) -> dict[str, DataFrame]:
    """Out-of-fold scores per candidate, as written tables."""
    return fit_candidates(folded, candidates, folds, max_iter, key, final=False)[0]


def fit_candidates(
    folded: DataFrame,
    candidates: tuple[str, ...] = DEFAULT_CANDIDATES,
    folds: int = 3,
    max_iter: int | None = None,
    key: str = ORDER_KEY,
    final: bool = True,
) -> tuple[dict[str, DataFrame], dict[str, PipelineModel]]:
    """Out-of-fold scores per candidate, as written tables, and the models of all rows.

    ``folds=0`` leaves out the scores, ``final=False`` the models.

    Candidates grow all their folds, and the model of all rows, in the same passes. The rows
    are read several times before they are packed, so split and folds are written once.
    """
    settings = {name: boosting_of(name, max_iter) for name in candidates}
    folded = save_dataset(folded, scratch_path(folded.sparkSession, "folded"))
    return fit_boosted(folded, settings, folds, key, final)


def fit_boosted(
    folded: DataFrame,
    settings: dict[str, BoostingParams],
    folds: int = 3,
    key: str = ORDER_KEY,
    final: bool = True,
    cuts: dict[str, list[float]] | None = None,
) -> tuple[dict[str, DataFrame], dict[str, PipelineModel]]:
    """Scores and final models of the candidates out of one set of passes.

    Bins and category slots come from all rows given, without their labels; they are the
    same for every fold. ``cuts`` names the cut points instead of taking quantiles.
    """
    if not settings:
        return {}, {}
    spark = folded.sparkSession
    encoding = encoder(impute=True).fit(folded)
    encoded = encoding.transform(folded)
    layout = layout_of(encoded, category_sizes(encoded), cuts)
    left_out = [*range(folds), *([None] if final else [])]
    runs = [Run(params, fold) for params in settings.values() for fold in left_out]
    grown = boost(encoded, layout, runs, key=key, fold="fold" if folds else None)
    try:
        if folds:
            margins = save_dataset(
                grown.margins(spark, folded.schema[key].dataType.simpleString()),
                scratch_path(spark, "margins"),
            )
    finally:
        grown.blocks.unpersist()
    scores, models = {}, {}
    for position, name in enumerate(settings):
        if folds:
            own = F.element_at("margins", position * len(left_out) + F.col("fold") + 1)
            scores[name] = margins.select(
                F.col("key").alias(key),
                F.col("label").alias(TARGET),
                (1 / (1 + F.exp(-own))).alias(SCORE),
                "fold",
            )
        if final:
            run = position * len(left_out) + folds
            trees = spark_model(spark, layout, runs[run], grown.bases[run], grown.trees[run])
            models[name] = PipelineModel([*encoding.stages, trees])
    return scores, models


def cross_validation_results(
    train: DataFrame,
    candidates: tuple[str, ...] = DEFAULT_CANDIDATES,
    folds: int = 3,
    seed: int = 42,
    max_iter: int | None = None,
    key: str = ORDER_KEY,
) -> DataFrame:
    """Best threshold and out-of-fold F1 per candidate."""
    folded = assign_folds(train, folds, seed, key)
    return candidate_results(out_of_fold_runs(folded, candidates, folds, max_iter, key))


def cross_validate_models(
    train: DataFrame,
    candidates: tuple[str, ...] = DEFAULT_CANDIDATES,
    folds: int = 3,
    seed: int = 42,
    max_iter: int | None = None,
) -> tuple[str, float]:
    """(name, threshold) of the candidate with the best out-of-fold F1."""
    results = cross_validation_results(train, candidates, folds, seed, max_iter)
    winner = best_candidate(results).first()
    return winner["model_name"], winner["threshold"]


def train_model(
    model_name: str,
    train: DataFrame,
    threshold: float,
    store: str | None = None,
    max_iter: int | None = None,
) -> PipelineModel:
    """Fit the chosen candidate on all training rows; keep it if a store is given."""
    model = candidate(model_name, max_iter).fit(train)
    if store is not None:
        save_model(model, store)
        save_metadata(train.sparkSession, store, model_name, threshold)
    return model


EVALUATION_SCHEMA = (
    "model string, threshold double, precision double, recall double, f1 double, roc_auc double"
)


def evaluate_model(
    model: PipelineModel, model_name: str, test: DataFrame, threshold: float
) -> dict:
    """Precision, recall, F1 and ROC-AUC on held-out rows.

    The model runs once: only label, probability and margin are kept for the
    aggregations, then dropped again.
    """
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    scored = with_probability(model, test).select(TARGET, SCORE, margin).persist()
    try:
        rates = confusion_metrics(scored, threshold).first()
        area = roc_auc(scored, score="margin").first()["roc_auc"]
    finally:
        scored.unpersist()
    return {
        "model": model_name,
        "threshold": float(threshold),
        "precision": rates["precision"],
        "recall": rates["recall"],
        "f1": rates["f1"],
        "roc_auc": area,
    }


def evaluation_frame(spark: SparkSession, result: dict) -> DataFrame:
    return spark.createDataFrame([tuple(result.values())], EVALUATION_SCHEMA)
