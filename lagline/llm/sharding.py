"""Shards that all match the mixture: proportional stratified interleaving.

Rows of each source are put in a seeded random order. A row's fractional rank is
``(2 * rank - 1) / (2 * rows of its source)``. Sorting all rows by that number
interleaves the sources in proportion; cutting the order into equal runs gives
shards whose row counts differ by one at most and whose share of every source is
that of the whole table.

Neither ranking puts a source, or all rows, into one task. Both cut their order
into buckets first (by the leading part of the random number, by the fractional
rank), count the buckets, and number the rows of each bucket from its offset. The
number of buckets follows the row count; results do not depend on it.

Defined results: null texts have size 1 and checksum 0; a null source is a source
of its own; rows with equal id are ordered by checksum and size, and rows equal
in those too are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
SEED = 42
ROWS_PER_BUCKET = 200_000
LEAST_BUCKETS = 2_048
RANDOM_RANGE = 1 << 48


def seeded_number(key: Column, seed: int | str) -> Column:
    """48 random bits of md5(seed:key) as a bigint."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def bucketed_rank(rows: DataFrame, group: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Position from 1 within ``group``, by ``bucket`` and then ``order``.

    Buckets are counted first; a window over the counts, one row per bucket,
    gives each bucket its offset.
    """
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"__{c}") for c in [*group, bucket]],
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    numbered = rows.withColumn("__position", F.row_number().over(inside))
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*group, bucket]]
    condition = match[0]
    for extra in match[1:]:
        condition = condition & extra
    return numbered.join(offsets, condition).select(
        *rows.columns, (F.col("__offset") + F.col("__position")).alias(out)
    )


def proportional_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: id, stratum, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum_col}`")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        seeded_number(F.col(f"`{id_col}`"), seed).alias("random"),
    )
    totals = docs.groupBy(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum_col}`")), F.lit("")).alias("stratum")
    ).agg(F.count(F.lit(1)).alias("stratum_rows"))
    total = int(totals.agg(F.sum("stratum_rows")).first()[0] or 0)
    buckets = max(LEAST_BUCKETS, total // ROWS_PER_BUCKET)
    tie = ["random", F.col("id").asc_nulls_first(), "text_crc32", "size"]
    by_random = F.floor(F.col("random") * F.lit(buckets) / F.lit(float(RANDOM_RANGE)))
    ranked = bucketed_rank(
        rows.withColumn("cut", by_random), ["stratum"], "cut", tie, "rank"
    ).drop("cut")
    # One row per source: adaptive execution broadcasts it if it is small.
    placed = ranked.join(totals, "stratum").withColumn(
        "fraction", (2 * F.col("rank") - 1) / (2.0 * F.col("stratum_rows"))
    )
    ordered = bucketed_rank(
        placed.withColumn("cut", F.floor(F.col("fraction") * buckets)).withColumn("all", F.lit(0)),
        ["all"],
        "cut",
        ["fraction", "stratum", "rank"],
        "place",
    )
    place = F.col("place") - 1
    rows_in_all = F.lit(max(total, 1))
    whole = place * shards
    shard = ((whole - whole % rows_in_all) / rows_in_all).cast("int")
    # Shard s starts at the first place with place * shards >= s * rows.
    first = shard.cast("long") * rows_in_all + (shards - 1)
    first = (first - first % shards) / shards
    return ordered.select(
        F.col("id").alias(id_col),
        F.expr("if(stratum = '', null, substring(stratum, 2))").alias(stratum_col),
        "size",
        "text_crc32",
        shard.alias("shard"),
        (place - first).cast("long").alias("slot"),
    )
