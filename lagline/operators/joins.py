"""Joins with a declared cardinality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Which sides must hold each key at most once.
UNIQUE_SIDES = {
    "one_to_one": ("left", "right"),
    "one_to_many": ("left",),
    "many_to_one": ("right",),
    "many_to_many": (),
}


def repeated_keys(data: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once. Counts are combined before the shuffle."""
    return (
        data.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )


def cardinality_violations(
    left: DataFrame, right: DataFrame, on: str | list[str], validate: str
) -> DataFrame:
    """Every key that breaks the declared cardinality: side, key columns, occurrences."""
    if validate not in UNIQUE_SIDES:
        raise ValueError(f"validate must be one of {sorted(UNIQUE_SIDES)}")
    keys = [on] if isinstance(on, str) else list(on)
    sides = {"left": left, "right": right}
    frames = [
        repeated_keys(sides[side], keys).select(F.lit(side).alias("side"), *keys, "occurrences")
        for side in UNIQUE_SIDES[validate]
    ]
    if not frames:
        return (
            left.select(F.lit("left").alias("side"), *keys, F.lit(0).cast("bigint").alias("occurrences"))
            .filter(F.lit(False))
        )
    return reduce(DataFrame.unionByName, frames)


def unique_rows(data: DataFrame, on: str | list[str], message: str) -> DataFrame:
    """``data``, which fails while it runs if a key occurs twice. Null keys match nothing and pass.

    The rows of a key are counted in a window over the key. A join on the key needs
    the same partitioning, so the check costs no shuffle and no pass of its own.
    """
    keys = [on] if isinstance(on, str) else list(on)
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    no_key = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(True)) for k in keys], F.lit(False))
    text = F.concat(F.lit(f"{message}, for example "), F.to_json(F.struct(*keys)))
    # A filter on it, because a column that nothing reads is not computed.
    alone = F.when((F.col("__rows") == 1) | no_key, F.lit(True)).otherwise(
        F.raise_error(text).cast("boolean")
    )
    return data.withColumn("__rows", count).filter(alone).drop("__rows")


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "left",
    validate: str = "many_to_one",
    early: bool = True,
) -> DataFrame:
    """A join that proves its declared cardinality.

    ``early`` proves it in a job of its own and names offenders in a ``ValueError``, before
    the join is returned. Otherwise the sides that must be unique carry the check: there
    is no job beforehand and no second scan, and a violation fails the job that runs
    the join. A left join whose right side is unique cannot change the row count, so
    uniqueness also proves that.
    """
    if validate not in UNIQUE_SIDES:
        raise ValueError(f"validate must be one of {sorted(UNIQUE_SIDES)}")
    if early:
        offenders = cardinality_violations(left, right, on, validate).limit(5).collect()
        if offenders:
            raise ValueError(f"join is not {validate}, for example {[r.asDict() for r in offenders]}")
        return left.join(right, on=on, how=how)
    sides = {"left": left, "right": right}
    for side in UNIQUE_SIDES[validate]:
        sides[side] = unique_rows(sides[side], on, f"join is not {validate} on its {side} side")
    return sides["left"].join(sides["right"], on=on, how=how)
