"""Metrics over any frame with a 0/1 label and a score."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagline.operators.ordered import ordered_counts
from lagline.schemas import SCORE, TARGET

# 0.05 to 0.50 in steps of 0.01, built from integers to be exact,
# and the answer when there is nothing to choose from.
THRESHOLDS = [i / 100 for i in range(5, 51)]


def _ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient that is 0 when its denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def _with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def _count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def threshold_curve(
    predictions: DataFrame,
    label: str = TARGET,
    score: str = SCORE,
    thresholds: list[float] = THRESHOLDS,
) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of class 1 at every threshold.

    One pass: each score is counted in the interval between two thresholds that
    holds it, and what a threshold accepts is the sum of the intervals from it
    upwards. The rows are never multiplied by the number of thresholds, and the
    shuffle carries one row per interval and task. The intervals are closed on
    the left, so a score equal to a threshold is accepted by it.
    """
    infinity = float("inf")
    cuts = sorted(thresholds)
    # A missing score is accepted by no threshold, NaN by all, as in ``score >= t``.
    comparable = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(infinity)), F.lit(-infinity))
    cutter = Bucketizer(
        splits=[-infinity, *cuts, infinity], inputCol="__score", outputCol="__interval"
    )
    intervals = (
        cutter.transform(predictions.select(F.col(label), comparable.alias("__score")))
        .groupBy(F.col("__interval").cast("int").alias("interval"))
        .agg(
            _count_where(F.col(label) == 1).alias("positives"),
            _count_where(F.col(label) == 0).alias("negatives"),
        )
    )
    spark = predictions.sparkSession
    grid = spark.createDataFrame(
        [(i, None if i == 0 else cuts[i - 1]) for i in range(len(cuts) + 1)],
        "interval int, threshold double",
    )
    # len(thresholds) + 1 rows from here on.
    upwards = Window.orderBy(F.desc("interval"))
    everything = Window.partitionBy(F.lit(1))
    filled = grid.join(intervals, "interval", "left").fillna(0, ["positives", "negatives"])
    return _with_rates(
        filled.select(
            "threshold",
            F.sum("positives").over(upwards).alias("tp"),
            F.sum("negatives").over(upwards).alias("fp"),
            F.sum("positives").over(everything).alias("all_positives"),
        )
        .filter(F.col("threshold").isNotNull())
        .select("threshold", "tp", "fp", (F.col("all_positives") - F.col("tp")).alias("fn"))
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row with the highest F1; the lowest threshold wins ties."""
    return curve.orderBy(F.desc("f1"), F.asc("threshold")).limit(1).select("threshold", "f1")


def find_best_threshold(
    predictions: DataFrame, label: str = TARGET, score: str = SCORE
) -> tuple[float, float]:
    """(threshold, F1) of the best threshold; without rows the lowest one, with 0."""
    row = best_threshold(threshold_curve(predictions, label, score)).first()
    return row["threshold"], row["f1"]


def confusion_metrics(
    predictions: DataFrame, threshold: float, label: str = TARGET, score: str = SCORE
) -> DataFrame:
    """Counts and rates of class 1 at one threshold, one row, one aggregation."""
    accepted = F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))
    actual = F.col(label) == 1
    return _with_rates(
        predictions.agg(
            _count_where(actual & accepted).alias("tp"),
            _count_where((F.col(label) == 0) & accepted).alias("fp"),
            _count_where(actual & ~accepted).alias("fn"),
        )
    )


def roc_auc(
    predictions: DataFrame, label: str = TARGET, score: str = SCORE, ranges: int | None = None
) -> DataFrame:
    """Exact area under the ROC curve, one row; null when a class is absent.

    A positive beats the negatives with a lower score and ties with those of its
    own. Counted per distinct score in exact decimals, so neither binning nor
    the order of summation can move the result.
    """
    counts = ordered_counts(
        predictions,
        [score],
        {
            "pos": F.when(F.col(label) == 1, 1).otherwise(0).cast("bigint"),
            "neg": F.when(F.col(label) == 0, 1).otherwise(0).cast("bigint"),
        },
        ranges,
    )
    doubled_wins = (
        F.col("pos").cast("decimal(19,0)")
        * (2 * F.col("neg_before") + F.col("neg")).cast("decimal(19,0)")
    )
    totals = counts.agg(
        F.sum(doubled_wins).alias("wins"),
        F.max("pos_total").alias("positives"),
        F.max("neg_total").alias("negatives"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return totals.select(
        F.when(pairs > 0, F.col("wins").cast("double") / (2 * pairs)).alias("roc_auc")
    )


def accuracy(predictions: DataFrame, label: str = TARGET, prediction: str = "prediction") -> DataFrame:
    """Share of correct labels."""
    return predictions.agg(
        F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy")
    )


def best_candidate(results: DataFrame) -> DataFrame:
    """The candidate with the highest F1; the one listed first wins ties."""
    return results.orderBy(F.desc("f1"), F.asc("candidate_order")).limit(1)


def candidate_results(frames: dict[str, DataFrame]) -> DataFrame:
    """Best threshold and F1 per candidate, from one prediction frame each."""
    rows = [
        best_threshold(threshold_curve(predictions)).select(
            F.lit(position).alias("candidate_order"),
            F.lit(name).alias("model_name"),
            "threshold",
            "f1",
        )
        for position, (name, predictions) in enumerate(frames.items())
    ]
    return reduce(DataFrame.unionByName, rows)
