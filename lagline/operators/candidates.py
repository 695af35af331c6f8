"""The classifiers that compete, each a full pipeline from feature columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression

from lagline.operators.boosting import BoostingParams, GradientBoosting, HistogramBoosting
from lagline.operators.encoding import preprocessing_stages, scaling_stages
from lagline.schemas import TARGET

SEED = 42

# The hyperparameters of the candidates.
CANDIDATE_PARAMS: dict[str, dict | BoostingParams] = {
    "gbt": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3},
    # Second-order trees, grown by depth, with the usual penalty on leaf weights.
    "deep_gbt": BoostingParams(
        iterations=200, rate=0.05, max_depth=5, row_share=0.8, column_share=0.8, l2=1.0,
        min_hessian=1.0, min_rows=1, seed=SEED,
    ),
    # Grown by leaf up to 31 leaves; no penalty, but leaves of 20 rows or more.
    "leafwise": BoostingParams(
        iterations=200, rate=0.05, max_depth=5, max_leaves=31, row_share=0.8, column_share=0.8,
        l2=0.0, min_hessian=0.001, min_rows=20, seed=SEED,
    ),
}
DEFAULT_CANDIDATES = ("gbt", "deep_gbt")


def settings_of(name: str, max_iter: int | None = None) -> dict | BoostingParams:
    """Parameters of a candidate. ``max_iter`` shortens training."""
    if name not in CANDIDATE_PARAMS:
        raise ValueError(f"unknown model {name!r}, expected one of {sorted(CANDIDATE_PARAMS)}")
    settings = CANDIDATE_PARAMS[name]
    if max_iter is None:
        return settings
    if isinstance(settings, BoostingParams):
        return replace(settings, iterations=max_iter)
    return settings | {"maxIter": max_iter}


def boosting_of(name: str, max_iter: int | None = None) -> BoostingParams:
    """Parameters of a candidate as the boosting takes them."""
    settings = settings_of(name, max_iter)
    return settings if isinstance(settings, BoostingParams) else _spark_trees(settings, TARGET).settings()


def _spark_trees(settings: dict, label: str) -> GradientBoosting:
    return GradientBoosting(labelCol=label, featuresCol="features", seed=SEED, **settings)


def candidate(name: str, max_iter: int | None = None, label: str = TARGET) -> Pipeline:
    """An unfitted pipeline by name. ``max_iter`` shortens training."""
    settings = settings_of(name, max_iter)
    if isinstance(settings, BoostingParams):
        trees = HistogramBoosting(settings, label)
    else:
        trees = _spark_trees(settings, label)
    return Pipeline(stages=[*preprocessing_stages(impute=True), trees])


def logistic_candidate(
    columns: list[str], rows: int, label: str = TARGET, max_iter: int = 1000
) -> Pipeline:
    """Scaled L2 logistic regression.

    Spark averages the loss over rows where the usual C = 1 form sums it, hence
    the penalty of 1 / rows.
    """
    regression = LogisticRegression(
        labelCol=label,
        featuresCol="features",
        regParam=1.0 / rows,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
    )
    return Pipeline(stages=[*scaling_stages(columns), regression])
