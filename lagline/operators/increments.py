"""Scoring only what is new: gold by partition and a ledger of what was scored.

Gold is partitioned by a column of the orders, such as the purchase day. The ledger
holds, per partition, how many rows of silver it had, a checksum of their keys and
features, and the model that scored them. A run scores the partitions whose entry is
missing or different, overwrites just these, then adds their entries. So a second run
scores nothing, late rows of a day bring only that day back, and a new model brings
everything back.

A run that dies between gold and ledger leaves partitions that the next run scores
again to the same content.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.operators.scoring import numeric_as_double, predict, scored_columns
from lagline.session import scratch_path
from lagline.sources.files import read_table, save_dataset
from lagline.sources.models import load_metadata, load_model

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("checksum", T.DecimalType(38, 0)),
        T.StructField("model_id", T.StringType()),
        T.StructField("scored_at", T.TimestampType()),
    ]
)


def partition_states(data: DataFrame, part: str) -> DataFrame:
    """part (as text), row_count, checksum: what a partition of silver holds, in any order."""
    columns = [name for name in data.columns if name != part]
    return data.groupBy(F.col(part).cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum"),
    )


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The latest entry of each partition; no rows before the first run."""
    try:
        entries = spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)
    latest = Window.partitionBy("part").orderBy(F.desc("scored_at"))
    return (
        entries.withColumn("place", F.row_number().over(latest))
        .filter(F.col("place") == 1)
        .drop("place")
    )


def pending_partitions(data: DataFrame, part: str, ledger: DataFrame, model_id: str) -> DataFrame:
    """States of the partitions that the ledger does not know in this form."""
    known = ledger.filter(F.col("model_id") == model_id)
    same = ["part", "row_count", "checksum"]
    condition = [F.col(f"s.{name}").eqNullSafe(F.col(f"k.{name}")) for name in same]
    every: Column = condition[0] & condition[1] & condition[2]
    return partition_states(data, part).alias("s").join(known.alias("k"), every, "left_anti")


def score_increment(
    spark: SparkSession, store: str, silver: DataFrame, gold: str, ledger: str, part: str, model_id: str
) -> DataFrame:
    """Score what is pending, bring gold and ledger up to date; returns the scored states.

    ``model_id`` names the stored model, for example by the time of its training. The list
    of pending partitions goes to the rows. Before the write the scored rows are brought
    together by partition, so that a small one is one file; adaptive execution splits one
    that holds a large share of all rows.
    """
    pending = save_dataset(
        pending_partitions(silver, part, read_ledger(spark, ledger), model_id),
        scratch_path(spark, "pending"),
    )
    if pending.isEmpty():
        return pending
    _, threshold = load_metadata(spark, store)
    wanted = pending.select("part")
    rows = numeric_as_double(silver).join(
        wanted, F.col(part).cast("string").eqNullSafe(F.col("part")), "left_semi"
    )
    scored = scored_columns(predict(load_model(store), rows, threshold), silver)
    (
        scored.hint("rebalance", part)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(part)
        .parquet(gold)
    )
    entries = pending.select(
        "part", "row_count", "checksum",
        F.lit(model_id).alias("model_id"), F.current_timestamp().alias("scored_at"),
    )
    entries.coalesce(1).write.mode("append").parquet(ledger)
    return pending


def read_gold(spark: SparkSession, gold: str) -> DataFrame:
    return read_table(spark, gold)
