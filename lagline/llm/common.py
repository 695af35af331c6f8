"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagline.session import scratch_path

# The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row.

    A higher-order function would evaluate a plain expression again for each
    element; a lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; an empty list for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, since one text may be very long."""
    spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    The written table cuts the lineage: losing an executor costs a re-read, not
    a recomputation of everything above.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
