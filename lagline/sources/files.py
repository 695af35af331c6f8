"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.schemas import CUSTOMERS_SCHEMA, ITEMS_SCHEMA, ORDERS_SCHEMA

CORRUPT_COLUMN = "_corrupt_record"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_csv(
    spark: SparkSession,
    path: str,
    declared: T.StructType | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """CSV with a header line.

    With declared types only the header is looked at beforehand: columns get
    their declared type by name, others stay text, and no pass over the data is
    made to infer anything. ``keep_corrupt`` adds a column holding the text of
    lines that do not fit; without it such fields become null. Every file must have
    the columns in the order of the first one's header: a file that differs is an
    error, since its fields would otherwise land in other columns unnoticed.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if declared is None:
        return reader.option("inferSchema", True).csv(str(path))
    types = {field.name: field.dataType for field in declared.fields}
    header = reader.csv(str(path)).columns
    fields = [T.StructField(name, types.get(name, T.StringType())) for name in header]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT_COLUMN, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    return (
        reader.option("timestampFormat", TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("enforceSchema", False)
        .schema(T.StructType(fields))
        .csv(str(path))
    )


def load_data(
    orders_path: str,
    items_path: str,
    customers_path: str,
    spark: SparkSession,
    infer: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, items and customers from CSV."""
    paths = (orders_path, items_path, customers_path)
    declared = (ORDERS_SCHEMA, ITEMS_SCHEMA, CUSTOMERS_SCHEMA)
    orders, items, customers = (
        read_csv(spark, path, None if infer else schema)
        for path, schema in zip(paths, declared)
    )
    return orders, items, customers


def write_csv(data: DataFrame, path: str) -> None:
    """CSV with header, one file per partition, in the format ``read_csv`` expects."""
    (
        data.write.mode("overwrite")
        .option("header", True)
        .option("timestampFormat", TIMESTAMP_FORMAT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .csv(str(path))
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; filters and projections on it reach the scan."""
    return spark.read.parquet(str(path))


def save_dataset(dataset: DataFrame, output_path: str) -> DataFrame:
    """Overwrite a Parquet table and return it as read back.

    Going on from the written table, not from the plan that produced it, keeps
    later stages from computing the joins again.
    """
    dataset.write.mode("overwrite").parquet(str(output_path))
    return dataset.sparkSession.read.parquet(str(output_path))


def save_bucketed(
    dataset: DataFrame, output_path: str, key: str, buckets: int, table: str | None = None
) -> DataFrame:
    """Write a table hashed and sorted by ``key`` and return it as read back.

    Tables with the same key and number of buckets join and group by the key without a
    shuffle, however often. The layout belongs to the catalog entry ``table`` (a name made
    from the path if none is given), the files stay in ``output_path``. Rows are dealt to
    the buckets first, so that a bucket is one file and not one per task.
    """
    spark = dataset.sparkSession
    name = table or "bucketed_" + "".join(c if c.isalnum() else "_" for c in str(output_path))[-100:]
    (
        dataset.repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", str(output_path))
        .saveAsTable(name)
    )
    return spark.table(name)


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row and column count per table, one row per table."""
    frames = [
        data.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.col("row_count"),
            F.lit(len(data.columns)).alias("column_count"),
        )
        for name, data in tables.items()
    ]
    shapes = frames[0]
    for frame in frames[1:]:
        shapes = shapes.unionByName(frame)
    return shapes


def preview(data: DataFrame, columns: list[str], key: str, rows: int = 20) -> DataFrame:
    """First rows by key, so the same rows appear on every run."""
    return data.orderBy(key).select(*columns).limit(rows)
