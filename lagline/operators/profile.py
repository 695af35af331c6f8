"""Column profiles: summary, frequent values, histograms, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.operators.ordered import quantiles_of, value_counts
from lagline.operators.sketches import QUARTILES, column_sketches, profile_from_sketches
from lagline.session import scratch_path
from lagline.sources.files import save_dataset

# Counts kept per column to find frequent values, and how many buckets are looked at first.
BUCKETS = 65_536
GUESS = 4
# Types whose values stay apart when read as doubles.
EXACT_AS_DOUBLE = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
# Types that are counted as they are: narrower than their text, and no two values share one.
EXACT_AS_SELF = (T.LongType, T.DecimalType, T.DateType, T.TimestampNTZType)


def numeric_columns(data: DataFrame) -> list[str]:
    return [f.name for f in data.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long(entries: list[Column]) -> Column:
    return F.inline(F.array(*entries))


def describe(data: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """count, mean, sample standard deviation, min, quartiles and max in one row.

    Quartiles are exact by default. The data are read once, for the counts per value;
    all figures come from these. ``approximate`` takes quartiles from a sketch instead
    and keeps no counts.
    """
    order = ["count", "mean", "std", "min", *QUARTILES, "max"]
    if approximate:
        value = F.col(column).cast("double")
        parts = data.agg(
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.percentile_approx(value, list(QUARTILES.values()), 10_000).alias("sketch"),
        )
        return parts.withColumns(
            {name: F.col("sketch")[i] for i, name in enumerate(QUARTILES)}
        ).select(*order)
    counts = value_counts(data, [column], {"n": F.lit(1)})
    found = _moments(counts).join(F.broadcast(quantiles_of(counts, QUARTILES)), "column", "left")
    # A row even where there is no value at all.
    one = data.sparkSession.createDataFrame([(column,)], "column string")
    return one.join(found, "column", "left").select(
        F.coalesce("count", F.lit(0)).alias("count"), *order[1:]
    )


def _moments(counts: DataFrame) -> DataFrame:
    """column, count, mean, std, min and max out of counts per value.

    Squares are taken around the mean, so large numbers that lie close together keep
    their deviation.
    """
    sums = counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    # One row per column.
    around = counts.join(F.broadcast(sums.select("column", "mean")), "column").groupBy("column").agg(
        F.sum((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")) * F.col("n")).alias("squares")
    )
    return sums.join(F.broadcast(around), "column").select(
        "column",
        "count",
        "mean",
        F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1))).alias("std"),
        "min",
        "max",
    )


def cell_counts(data: DataFrame) -> DataFrame:
    """column, value (as a number), text, n: how often each value of each column occurs.

    Every row turns into one narrow entry per column and entries combine in the map
    tasks; wide rows are never repeated. An entry carries the number of its column and the
    value in its own type; names and texts are made from what is left after counting.
    Numbers have no text, so two that are the same double are two rows. A null has neither.
    Written once; everything else in an exact profile reads this.
    """
    fields = data.schema.fields
    kinds, homes = {"number": "double", "text": "string"}, []
    for field in fields:
        home = "number" if isinstance(field.dataType, EXACT_AS_DOUBLE) else "text"
        if isinstance(field.dataType, EXACT_AS_SELF):
            home = field.dataType.simpleString()
            kinds[home] = home
        homes.append(home)
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            *[
                (F.col(field.name) if kind == home else F.lit(None)).cast(of).alias(kind)
                for kind, of in kinds.items()
            ],
        )
        for i, (field, home) in enumerate(zip(fields, homes))
    ]
    counts = data.select(_long(entries)).groupBy("position", *[F.col(f"`{kind}`") for kind in kinds])
    numbers = {"number", *[h for f, h in zip(fields, homes) if isinstance(f.dataType, T.NumericType)]}
    names = F.array(*[F.lit(field.name) for field in fields])

    def whichever(chosen: list[str], of: str) -> Column:
        return F.coalesce(*[F.col(f"`{kind}`").cast(of) for kind in chosen])

    return save_dataset(
        counts.agg(F.count(F.lit(1)).alias("n")).select(
            names[F.col("position")].alias("column"),
            whichever([kind for kind in kinds if kind in numbers], "double").alias("value"),
            whichever([kind for kind in kinds if kind not in numbers], "string").alias("text"),
            "n",
        ),
        scratch_path(data.sparkSession, "cell-counts"),
    )


def _text_ranges(cells: DataFrame, columns: list[str]) -> DataFrame:
    """column, min_text and max_text of the named columns.

    One aggregation without a key: grouped by column, texts would be sorted by it first.
    """
    own = [F.when(F.col("column") == name, F.col("text")) for name in columns]
    wide = cells.filter(F.col("text").isNotNull()).agg(
        *[F.min(text).alias(f"low_{i}") for i, text in enumerate(own)],
        *[F.max(text).alias(f"high_{i}") for i, text in enumerate(own)],
    )
    return wide.select(
        _long(
            [
                F.struct(
                    F.lit(name).alias("column"),
                    F.col(f"low_{i}").alias("min_text"),
                    F.col(f"high_{i}").alias("max_text"),
                )
                for i, name in enumerate(columns)
            ]
        )
    )


def profile_columns(data: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: count, nulls, distinct, range, and moments for numbers.

    Exact by default, from the counts of all values. ``approximate`` keeps no values: it
    merges sketches of a fixed size (``lagline.operators.sketches``).
    """
    if approximate:
        return profile_from_sketches(column_sketches(data))
    cells = cell_counts(data)
    present = F.col("value").isNotNull() | F.col("text").isNotNull()
    numeric = numeric_columns(data)
    summary = cells.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("value_count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.when(present, 1)).alias("distinct_count"),
    )
    names = data.sparkSession.createDataFrame([(name,) for name in data.columns], "column string")
    rows = names.join(summary, "column", "left").fillna(
        0, ["value_count", "null_count", "distinct_count"]
    )
    worded = [name for name in data.columns if name not in numeric]
    if worded:
        # One row per column, so the broadcast is bounded by the schema.
        rows = rows.join(F.broadcast(_text_ranges(cells, worded)), "column", "left")
    else:
        rows = rows.withColumns({n: F.lit(None).cast("string") for n in ("min_text", "max_text")})
    if numeric:
        numbers = cells.filter(F.col("value").isNotNull()).select("column", "value", "n")
        figures = _moments(numbers).join(quantiles_of(numbers, QUARTILES), "column", "left")
        # One row per numeric column, so the broadcast is bounded by the schema.
        rows = rows.join(F.broadcast(figures), "column", "left")
    else:
        empty = F.lit(None).cast("double")
        rows = rows.withColumns({n: empty for n in ("min", "max", "mean", "std", *QUARTILES)})
    return rows.select(
        F.col("column").alias("column_name"),
        "value_count",
        "null_count",
        "distinct_count",
        "min_text",
        "max_text",
        F.col("min").alias("min_value"),
        F.col("max").alias("max_value"),
        "mean",
        "std",
        *QUARTILES,
    )


def _bucket() -> Column:
    return F.pmod(F.xxhash64("column_name", "value"), F.lit(BUCKETS)).cast("int").alias("bucket")


def top_values(data: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column; smaller text first among equals.

    Values are not grouped as such at first, but counted by hash bucket: a sketch of
    ``BUCKETS`` counts per column, whatever the number of values, in which no value
    counts less than it occurs. The values of the fullest buckets are counted exactly;
    the k-th count among them is a bound that any other value of the top k must reach, and
    so must its bucket. Only values of such buckets are counted in the end, so where a few
    values stand out, the shuffle carries their buckets and not the column.
    """
    entries = [
        F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"))
        for name in columns
    ]
    # Written once: three passes follow.
    values = save_dataset(
        data.select(_long(entries)).filter(F.col("value").isNotNull()),
        scratch_path(data.sparkSession, "top-values"),
    )
    sketch = save_dataset(
        values.groupBy("column_name", _bucket()).agg(F.count(F.lit(1)).alias("size")),
        scratch_path(data.sparkSession, "top-buckets"),
    )
    fullest = Window.partitionBy("column_name").orderBy(F.desc("size"), "bucket")
    first = sketch.withColumn("place", F.row_number().over(fullest)).filter(F.col("place") <= GUESS * k)

    def counted(buckets: DataFrame) -> DataFrame:
        """Exact counts of the values that fall into the given buckets."""
        # BUCKETS rows per column at most.
        kept = values.withColumn("bucket", _bucket()).join(
            F.broadcast(buckets.select("column_name", "bucket")), ["column_name", "bucket"], "left_semi"
        )
        return kept.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("occurrences"))

    by_count = Window.partitionBy("column_name").orderBy(F.desc("occurrences"), F.asc("value"))
    position = F.row_number().over(by_count)
    bounds = (
        counted(first).withColumn("position", position).filter(F.col("position") == k)
        .select("column_name", F.col("occurrences").alias("least"))
    )
    reached = sketch.join(F.broadcast(bounds), "column_name", "left").filter(
        F.col("size") >= F.coalesce("least", F.lit(1))
    )
    return counted(reached).withColumn("position", position).filter(F.col("position") <= k)


def histogram(data: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Equal-width histogram per numeric column; bins without rows are not listed.

    Edges come from one min/max aggregation, a row per column, which is
    broadcast to the pass that counts.
    """
    numbers = [F.col(name).cast("double").alias(name) for name in columns]
    values = data.select(*numbers)
    ranges = values.agg(
        *[F.min(name).alias(f"{name}__low") for name in columns],
        *[F.max(name).alias(f"{name}__high") for name in columns],
    ).select(
        _long(
            [
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.col(f"{name}__low").alias("low"),
                    F.col(f"{name}__high").alias("high"),
                )
                for name in columns
            ]
        )
    )
    long = values.select(
        _long(
            [
                F.struct(F.lit(name).alias("column_name"), F.col(name).alias("value"))
                for name in columns
            ]
        )
    ).filter(F.col("value").isNotNull())
    width = F.col("high") - F.col("low")
    position = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("low")) * bins / width))
    )
    return (
        long.join(F.broadcast(ranges), "column_name")
        .groupBy("column_name", position.cast("int").alias("bin"), "low", "high")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .select(
            "column_name",
            "bin",
            (F.col("low") + width * F.col("bin") / bins).alias("bin_low"),
            (F.col("low") + width * (F.col("bin") + 1) / bins).alias("bin_high"),
            "occurrences",
        )
    )


def correlations(data: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, from one aggregation."""
    pairs = list(combinations(columns, 2))
    wide = data.agg(
        *[
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"pair_{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(
        _long(
            [
                F.struct(
                    F.lit(a).alias("column_a"),
                    F.lit(b).alias("column_b"),
                    F.col(f"pair_{i}").alias("correlation"),
                )
                for i, (a, b) in enumerate(pairs)
            ]
        )
    )
