"""Splits, folds and samples drawn by key hash.

Membership is a function of the key and the seed. It does not change when data
is repartitioned or a task is run again on another executor, and the two parts
of a split are complements by construction. A split made by sampling first and
subtracting afterwards, on rows without a key, would also lose every test row
that happens to equal a train row; see ``lagline.operators.sets``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagline.functions.hashing import HASH_BITS, key_bucket, key_hash
from lagline.schemas import ORDER_KEY, TARGET
from lagline.session import scratch_path
from lagline.sources.files import save_dataset

SPLIT_STEPS = 10_000
ROWS_PER_SLOT = 50_000
# Samples up to this size are found by merging bottom-k sets.
BOTTOM_K = 20_000


def in_train(
    train_size: float = 0.8,
    seed: int = 42,
    key: str = ORDER_KEY,
    label: str | None = None,
    fractions: dict | None = None,
) -> Column:
    """Whether a row belongs to the train part; with per-class fractions if given."""
    step = key_bucket(key, SPLIT_STEPS, seed)
    cut = F.lit(round(train_size * SPLIT_STEPS))
    if fractions:
        for value, fraction in fractions.items():
            cut = F.when(F.col(label) == F.lit(value), round(fraction * SPLIT_STEPS)).otherwise(cut)
    return step < cut


def split_data(
    data: DataFrame,
    train_size: float = 0.8,
    seed: int = 42,
    key: str = ORDER_KEY,
    label: str | None = None,
    fractions: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and test parts. Two filters over one scan shape, no shuffle."""
    chosen = in_train(train_size, seed, key, label, fractions)
    return data.filter(chosen), data.filter(~chosen)


def assign_folds(
    data: DataFrame, folds: int = 3, seed: int = 42, key: str = ORDER_KEY, column: str = "fold"
) -> DataFrame:
    """Fold number per row, from another salt than the split uses."""
    return data.withColumn(column, key_bucket(key, folds, f"fold:{seed}").cast("int"))


def fold_parts(data: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(all other folds, this fold), without the fold column."""
    return (
        data.filter(F.col(column) != fold).drop(column),
        data.filter(F.col(column) == fold).drop(column),
    )


def class_quotas(classes: DataFrame, size: int | None, fraction: float | None) -> DataFrame:
    """Rows to draw per class so that they add up to the size: largest remainder.

    ``classes`` has one row per class, ``cut_class`` and its count ``n``; adds
    ``quota``. Equal remainders go to the smaller
    label. Products are decimals: the size times a count can pass 64 bits.
    """
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n").over(everything)
    wanted = F.ceil(total * F.lit(fraction)) if size is None else F.lit(size).cast("bigint")
    sized = classes.select(
        "cut_class",
        "n",
        total.alias("total"),
        F.least(wanted, total).alias("size"),
    ).withColumn("product", F.col("size").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    shares = sized.withColumn("whole", F.expr("product div total")).withColumn(
        "remainder", F.expr("product % total")
    )
    by_remainder = Window.partitionBy(F.lit(1)).orderBy(
        F.desc("remainder"), F.asc_nulls_first("cut_class")
    )
    left_over = F.col("size") - F.sum("whole").over(everything)
    extra = (F.row_number().over(by_remainder) <= left_over).cast("int")
    return shares.select("cut_class", "n", (F.col("whole") + extra).alias("quota"))


@dataclass(frozen=True)
class SampleCut:
    """Per class, the last (hash, key) pair that is still in the sample."""

    cuts: DataFrame
    key: str
    label: str | None
    salt: str

    def parts(self, data: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows inside the sample, all other rows)."""
        marked = self.mark(data)
        return (
            marked.filter("selected").drop("selected"),
            marked.filter("NOT selected").drop("selected"),
        )

    def mark(self, data: DataFrame, column: str = "selected") -> DataFrame:
        """Rows with a flag: inside the sample or not. One map-side join."""
        label = F.col(self.label) if self.label else F.lit(0)
        rows = data.withColumn("__hash", key_hash(self.key, self.salt)).withColumn("__class", label)
        # One row per class; broadcast by its measured size where that is small.
        joined = rows.join(self.cuts, F.col("__class").eqNullSafe(F.col("cut_class")), "left")
        inside = F.struct(F.col("__hash").alias("h"), F.col(self.key).alias("k")) <= F.struct(
            F.col("cut_hash").alias("h"), F.col("cut_key").alias("k")
        )
        return joined.withColumn(
            column, F.col("cut_hash").isNotNull() & F.coalesce(inside, F.lit(False))
        ).drop("__hash", "__class", "cut_class", "cut_hash", "cut_key")


def sample_cut(
    data: DataFrame,
    size: int | None = None,
    fraction: float | None = None,
    label: str | None = TARGET,
    key: str = ORDER_KEY,
    seed: int | str = 42,
    bits: int | None = None,
) -> SampleCut:
    """Find where an exact sample of the given size ends, class by class.

    The data are read once, for (class, key, hash), which are written; what follows
    reads that narrow table. ``key`` must be unique.

    A sample of at most ``BOTTOM_K`` rows keeps the rows of the smallest hashes, that many
    per class: bottom-k sets merge, so the rank limit works in the map tasks and each
    sends a set of bounded size. Quotas are applied afterwards.

    A larger sample would put a class in one task. There the rows are counted per
    (class, leading hash bits); the running count of those at most 2^bits numbers per
    class shows the one slot in which the quota is reached, and only that slot's rows,
    1/2^bits of the class, are ranked. ``bits`` follows the row count, so a slot stays small.
    """
    if (size is None) == (fraction is None):
        raise ValueError("give either size or fraction")
    salt = f"sample:{seed}"
    spark = data.sparkSession
    rows = save_dataset(
        data.select(
            (F.col(label) if label else F.lit(0)).alias("cut_class"),
            F.col(key).alias("cut_key"),
            key_hash(key, salt).alias("cut_hash"),
        ),
        scratch_path(spark, "sample-keys"),
    )
    totals = rows.groupBy("cut_class").agg(F.count(F.lit(1)).alias("n"))
    wanted = class_quotas(totals, size, fraction).filter(F.col("quota") > 0)
    by_hash = Window.partitionBy("cut_class").orderBy("cut_hash", "cut_key")
    if size is not None and size <= BOTTOM_K and bits is None:
        smallest = rows.withColumn("position", F.row_number().over(by_hash)).filter(
            F.col("position") <= size
        )
        # One row per class on the right.
        last = (
            smallest.alias("r")
            .join(wanted.alias("w"), F.col("r.cut_class").eqNullSafe(F.col("w.cut_class")))
            .filter(F.col("position") == F.col("quota"))
            .select("r.cut_class", "cut_hash", "cut_key")
        )
        return SampleCut(save_dataset(last, scratch_path(spark, "sample-cuts")), key, label, salt)
    if bits is None:
        bits = min(HASH_BITS, max(16, (rows.count() // ROWS_PER_SLOT).bit_length()))
    slot = F.shiftright("cut_hash", HASH_BITS - bits).cast("bigint")
    rows = rows.withColumn("slot", slot)
    slots = rows.groupBy("cut_class", "slot").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("cut_class").orderBy("slot")
    filled = slots.withColumn("upto", F.sum("n").over(running))
    reached = (
        filled.alias("f")
        .join(wanted.alias("w"), F.col("f.cut_class").eqNullSafe(F.col("w.cut_class")))
        .filter(F.col("upto") >= F.col("quota"))
        .filter(F.col("upto") - F.col("f.n") < F.col("quota"))
        .select(
            F.col("f.cut_class").alias("reached_class"),
            F.col("slot").alias("reached_slot"),
            (F.col("quota") - (F.col("upto") - F.col("f.n"))).alias("missing"),
        )
    )
    last = (
        rows.join(
            reached,
            F.col("cut_class").eqNullSafe(F.col("reached_class"))
            & (F.col("slot") == F.col("reached_slot")),
        )
        .withColumn("position", F.row_number().over(by_hash))
        .filter(F.col("position") == F.col("missing"))
        .select("cut_class", "cut_hash", "cut_key")
    )
    # One row per class, written once for the uses that follow.
    return SampleCut(save_dataset(last, scratch_path(spark, "sample-cuts")), key, label, salt)


def stratified_parts(
    data: DataFrame,
    size: int | None = None,
    fraction: float | None = None,
    label: str | None = TARGET,
    key: str = ORDER_KEY,
    seed: int | str = 42,
) -> tuple[DataFrame, DataFrame]:
    """(sample of exactly the wanted size keeping class shares, all other rows)."""
    return sample_cut(data, size, fraction, label, key, seed).parts(data)


def exact_stratified_sample(
    data: DataFrame,
    size: int | None = None,
    fraction: float | None = None,
    label: str = TARGET,
    key: str = ORDER_KEY,
    seed: int = 42,
) -> DataFrame:
    return stratified_parts(data, size, fraction, label, key, seed)[0]


def capped_sample(
    data: DataFrame, size: int = 2_000, key: str = ORDER_KEY, seed: int = 42
) -> DataFrame:
    """All rows if there are at most ``size``, else exactly ``size`` of them."""
    return stratified_parts(data, size, label=None, key=key, seed=seed)[0]


def disjointness(
    data: DataFrame, train: DataFrame, test: DataFrame, key: str = ORDER_KEY
) -> DataFrame:
    """One row: sizes, keys in both parts, keys in neither, keys from nowhere.

    The three key sets are tagged, stacked and grouped once, so there is a
    single shuffle with counts combined ahead of it.
    """
    tagged = None
    for name, part in (("data", data), ("train", train), ("test", test)):
        rows = part.select(
            F.col(key).alias("key"),
            *[F.lit(int(name == tag)).cast("bigint").alias(tag) for tag in ("data", "train", "test")],
        )
        tagged = rows if tagged is None else tagged.unionByName(rows)
    per_key = tagged.groupBy("key").agg(*[F.sum(tag).alias(tag) for tag in ("data", "train", "test")])

    def keys_where(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))

    has = {tag: F.col(tag) > 0 for tag in ("data", "train", "test")}
    return per_key.agg(
        *[F.coalesce(F.sum(tag), F.lit(0)).alias(f"{tag}_rows") for tag in has],
        keys_where(has["train"] & has["test"]).alias("in_both"),
        keys_where(has["data"] & ~has["train"] & ~has["test"]).alias("in_neither"),
        keys_where(~has["data"]).alias("unknown"),
    )
