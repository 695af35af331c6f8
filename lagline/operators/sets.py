"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, duplicates kept, columns matched by name."""
    return reduce(DataFrame.unionByName, frames)


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that do not occur in ``right``.

    Not a way to form a test set: on rows without a key it also drops each row
    that merely equals one on the right, and collapses the rest.

    Written as one aggregate over both sides. An anti join would send every copy
    of a frequent row to one task before removing duplicates; here copies are
    combined where they are read. Grouping treats nulls as equal, as EXCEPT does.
    """
    columns = left.columns
    tagged = left.withColumn("__right", F.lit(0)).unionByName(
        right.select(*columns).withColumn("__right", F.lit(1))
    )
    return (
        tagged.groupBy(*columns)
        .agg(F.max("__right").alias("__right"))
        .filter(F.col("__right") == 0)
        .select(*columns)
    )


def without_keys(
    data: DataFrame, removed: DataFrame, key: str, bounded: bool = False
) -> DataFrame:
    """Rows of ``data`` whose key is not among ``removed``.

    ``bounded`` is for callers that have limited ``removed`` to a known number of
    rows: the join then happens in the map tasks.
    """
    keys = removed.select(key)
    return data.join(F.broadcast(keys) if bounded else keys, on=key, how="left_anti")
