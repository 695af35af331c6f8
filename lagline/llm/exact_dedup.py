"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step looks only at texts that still share their key with another text. The
step before leaves a table of *slots*: its surviving keys hashed into at most
``2 ** slot_bits`` numbers. That table has a size bound whatever the input, so it
is broadcast, and a text whose slot is absent is settled without being read
further. Two keys in one slot only let a text through to the next step, where the
real key decides; no text is lost.

Full hashes are SHA-256 of the whole text; texts with the same length, prefix
hash and SHA-256 are taken as equal.

Defined results: a null text counts as empty; null ids sort below all others;
rows that repeat both id and text form a group whose ``kept`` row is each of
them, and ``survivors`` returns one of those; an empty table gives an empty
result; extra columns are carried by ``survivors`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_CHARS = 64
SLOT_BITS = 18


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def _slot(bits: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << bits))


def _shared_slots(rows: DataFrame, key: list[str], bits: int) -> DataFrame:
    """Slots of keys that more than one row has; at most ``2 ** bits`` rows."""
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return F.broadcast(counted.select(_slot(bits, *key).alias("slot")).distinct())


def _in_slots(rows: DataFrame, slots: DataFrame, bits: int, *key: str) -> DataFrame:
    return rows.withColumn("slot", _slot(bits, *key)).join(slots, "slot", "left_semi").drop("slot")


def refined_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    slot_bits: int = SLOT_BITS,
) -> DataFrame:
    """Groups of two or more rows: (length, prefix, full, keep_id, group_size, keep_rows).

    ``keep_rows`` counts the rows that carry ``keep_id`` itself.
    """
    text = _text(text_col)
    start = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        text.alias("body"),
        F.octet_length(text).alias("length"),
    )
    by_length = _shared_slots(start, ["length"], slot_bits)
    second = _in_slots(start, by_length, slot_bits, "length").withColumn(
        "prefix", F.xxhash64(F.substring("body", 1, prefix_chars))
    )
    by_prefix = _shared_slots(second, ["length", "prefix"], slot_bits)
    third = _in_slots(second, by_prefix, slot_bits, "length", "prefix").select(
        "id", "length", "prefix", F.unhex(F.sha2("body", 256)).alias("full")
    )
    # Ids first, so that a group with a third of all rows is still spread over
    # the tasks; its second step combines in the map tasks.
    per_id = third.groupBy("length", "prefix", "full", "id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_id.groupBy("length", "prefix", "full")
        .agg(
            F.max("id").alias("keep_id"),
            F.sum("n").alias("group_size"),
            F.max_by("n", F.coalesce("id", F.lit(-(1 << 63)))).alias("keep_rows"),
        )
        .filter("group_size > 1")
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group of equal texts stays.
    """
    groups = refined_groups(docs, id_col, text_col, **options)
    rows = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        F.unhex(F.sha2(_text(text_col), 256)).alias("full"),
    )
    # The group side has one row per key, the other side is split by adaptive
    # execution where a key is hot.
    joined = rows.join(groups.select("full", "keep_id", "group_size"), "full", "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return joined.select(
        id_col,
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col(id_col)).alias("kept"),
        F.lower(F.hex("full")).alias("text_sha256"),
    )


def survivors(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    slot_bits: int = SLOT_BITS,
    **options,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only texts whose fingerprint falls into a slot of some group are shuffled to
    meet their group; all others pass through the scan.
    """
    groups = refined_groups(docs, id_col, text_col, slot_bits=slot_bits, **options).select(
        F.col("full").alias("__full"),
        F.col("keep_id").alias("__keep"),
        F.col("keep_rows").alias("__rows"),
    )
    tagged = docs.withColumn("__full", F.unhex(F.sha2(_text(text_col), 256))).withColumn(
        "__slot", _slot(slot_bits, "__full")
    )
    slots = F.broadcast(groups.select(_slot(slot_bits, "__full").alias("__slot")).distinct())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    clear = tagged.join(slots, "__slot", "left_anti").select(*columns)
    met = tagged.join(slots, "__slot", "left_semi").join(groups, "__full", "left")
    own = F.col("__keep").eqNullSafe(F.col(f"`{id_col}`"))
    single = met.filter(F.col("__rows").isNull() | (own & (F.col("__rows") == 1)))
    repeated = met.filter(own & (F.col("__rows") > 1)).dropDuplicates(["__full"])
    return clear.unionByName(single.select(*columns)).unionByName(repeated.select(*columns))
