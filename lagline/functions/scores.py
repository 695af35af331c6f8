"""Expressions over classifier output."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from lagline.schemas import SCORE


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def positive_probability(vector: str = "probability") -> Column:
    """Probability of class 1 out of the model's probability vector."""
    return vector_to_array(vector)[1]


def threshold_label(threshold: float, score: Column | str = SCORE) -> Column:
    """1 when the score reaches the threshold, else 0; a missing score is 0."""
    return F.when(_column(score) >= F.lit(float(threshold)), 1).otherwise(0)


def distance_from(score: Column | str, centre: float = 0.5) -> Column:
    """How far a probability lies from the undecided point."""
    return F.abs(_column(score) - F.lit(centre))
