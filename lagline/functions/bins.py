"""Right-closed range labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The promise ranges in days and their labels, as reports name them.
PROMISE_EDGES = [0.0, 1.0, 3.0, 5.0, 10.0, float("inf")]
PROMISE_LABELS = ["Até 1", "2-3", "4–5", "6–10", "Mais de 10"]


def right_closed_bin(
    value: Column | str, edges: Sequence[float], labels: Sequence[str]
) -> Column:
    """Label of the interval ``(edges[i], edges[i + 1]]`` that holds ``value``.

    NULL for nulls, NaN and anything outside the outer edges.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need exactly one label per interval")
    if any(low >= high for low, high in zip(edges, edges[1:])):
        raise ValueError("edges must increase")
    column = F.col(value) if isinstance(value, str) else value
    chain = F.when(
        column.isNull() | F.isnan(column.cast("double")) | (column <= F.lit(edges[0])),
        F.lit(None).cast("string"),
    )
    for high, label in zip(edges[1:], labels):
        chain = chain.when(column <= F.lit(high), F.lit(label))
    return chain
