"""Declarative table checks that collect every failure.

Checks that look at one row at a time share a single scan: each row yields an
array of the failures it has, and the array is exploded. Uniqueness is a grouped
count per column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.operators.sets import union_all, without_keys
from lagline.schemas import ORDER_STATUSES

FAILURE_COLUMNS = ["check", "column", "key", "value"]


@dataclass(frozen=True)
class ColumnRule:
    """What one column must look like. Null values pass every check but ``nullable``."""

    name: str
    type: str = "string"
    nullable: bool = True
    unique: bool = False
    length: tuple[int, int] | None = None
    allowed: tuple[str, ...] | None = None


@dataclass(frozen=True)
class TableRule:
    """Column rules plus named row rules. A row rule that compares with a missing
    value does not hold, unless the rule itself allows for it."""

    columns: tuple[ColumnRule, ...]
    key: str
    row_rules: dict[str, Callable[[], Column]] = field(default_factory=dict)
    strict: bool = True


def approval_after_purchase() -> Column:
    return F.col("order_approved_at").isNull() | (
        F.col("order_approved_at") >= F.col("order_purchase_timestamp")
    )


# The declared shape of the orders table.
ORDER_RULES = TableRule(
    columns=(
        ColumnRule("order_id", nullable=False, unique=True, length=(32, 32)),
        ColumnRule("customer_id", nullable=False, unique=True, length=(32, 32)),
        ColumnRule("order_status", nullable=False, allowed=tuple(ORDER_STATUSES)),
        ColumnRule("order_purchase_timestamp", "timestamp_ntz", nullable=False),
        ColumnRule("order_approved_at", "timestamp_ntz"),
        ColumnRule("order_delivered_carrier_date", "timestamp_ntz"),
        ColumnRule("order_delivered_customer_date", "timestamp_ntz"),
        ColumnRule("order_estimated_delivery_date", "timestamp_ntz", nullable=False),
    ),
    key="order_id",
    row_rules={"approval_after_purchase": approval_after_purchase},
)


def _raw(name: str) -> str:
    return f"__raw_{name}"


def _present(data: DataFrame, rules: TableRule) -> list[ColumnRule]:
    return [rule for rule in rules.columns if rule.name in data.columns]


def coerced(data: DataFrame, rules: TableRule) -> DataFrame:
    """Every ruled column in its declared type; what cannot be read becomes null.

    ``try_cast``, because a plain cast of bad text fails the query in ANSI mode.
    """
    return data.withColumns(
        {rule.name: F.col(rule.name).try_cast(rule.type) for rule in _present(data, rules)}
    )


def unchecked_rules(data: DataFrame, rules: TableRule) -> list[str]:
    """Row rules that use a column the table does not have."""
    blocked = []
    for name, holds in rules.row_rules.items():
        try:
            coerced(data, rules).select(holds()).schema  # noqa: B018  analysis only, no job
        except AnalysisException:
            blocked.append(name)
    return blocked


def column_failures(data: DataFrame, rules: TableRule) -> DataFrame:
    """Missing and unexpected columns, and row rules that cannot be evaluated for
    want of a column. Looks at the schema, never at the rows."""
    expected = [rule.name for rule in rules.columns]
    found = [("missing_column", name) for name in expected if name not in data.columns]
    found += [("extra_column", name) for name in data.columns if name not in expected]
    found += [("unchecked_rule", name) for name in unchecked_rules(data, rules)]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in FAILURE_COLUMNS])
    return data.sparkSession.createDataFrame(
        [(check, name, None, None) for check, name in found], schema
    )


def _row_cases(data: DataFrame, rules: TableRule, checks: set[str] | None) -> list[tuple]:
    """(check, column, failing condition, reported value) for every one-row check.

    Values as read carry the prefix of ``_raw``, bare names are coerced values.
    """
    cases = []
    for rule in _present(data, rules):
        raw, value = F.col(_raw(rule.name)), F.col(rule.name)
        if not rule.nullable:
            cases.append(("not_null", rule.name, raw.isNull(), raw))
        if dict(data.dtypes)[rule.name] != rule.type:
            cases.append(("type_coerce", rule.name, raw.isNotNull() & value.isNull(), raw))
        if rule.length:
            cases.append(("length", rule.name, ~F.length(value).between(*rule.length), raw))
        if rule.allowed:
            cases.append(("allowed_values", rule.name, ~value.isin(list(rule.allowed)), raw))
    blocked = set(unchecked_rules(data, rules))
    for name, holds in rules.row_rules.items():
        if name not in blocked:
            cases.append((name, None, ~F.coalesce(holds(), F.lit(False)), F.lit(None)))
    return [case for case in cases if checks is None or case[0] in checks]


def _with_raw(data: DataFrame, rules: TableRule) -> DataFrame:
    """Coerced columns next to the values as read."""
    return coerced(data.withColumns({_raw(name): F.col(name) for name in data.columns}), rules)


def row_failures(data: DataFrame, rules: TableRule, checks: set[str] | None = None) -> DataFrame:
    """Failures of the checks that need only the row itself, from one scan."""
    entries = [
        F.when(
            failing,
            F.struct(
                F.lit(check).alias("check"),
                F.lit(column).cast("string").alias("column"),
                F.col(_raw(rules.key)).cast("string").alias("key"),
                value.cast("string").alias("value"),
            ),
        )
        for check, column, failing, value in _row_cases(data, rules, checks)
    ]
    if not entries:
        schema = T.StructType([T.StructField(name, T.StringType()) for name in FAILURE_COLUMNS])
        return data.sparkSession.createDataFrame([], schema)
    return _with_raw(data, rules).select(F.inline(F.array_compact(F.array(*entries))))


def repeated_values(data: DataFrame, column: str) -> DataFrame:
    """Non-null values that occur more than once."""
    return (
        data.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
        .select(column)
    )


def unique_failures(data: DataFrame, rules: TableRule) -> DataFrame | None:
    """Every row that shares a value which should be unique, in its declared type.

    The grouped count reduces in the map tasks. The semi join keeps all rows of
    a repeated value; if one value holds a large share of the rows, adaptive
    execution splits its partition.
    """
    frames = []
    for rule in _present(data, rules):
        if not rule.unique:
            continue
        rows = _with_raw(data, rules).join(
            repeated_values(coerced(data, rules), rule.name), on=rule.name, how="left_semi"
        )
        frames.append(
            rows.select(
                F.lit("unique").alias("check"),
                F.lit(rule.name).alias("column"),
                F.col(_raw(rules.key)).cast("string").alias("key"),
                F.col(_raw(rule.name)).cast("string").alias("value"),
            )
        )
    return union_all(frames) if frames else None


def failures(data: DataFrame, rules: TableRule) -> DataFrame:
    """All failures of all checks: check, column, key, value."""
    frames = [row_failures(data, rules)]
    duplicates = unique_failures(data, rules)
    if duplicates is not None:
        frames.append(duplicates)
    if rules.strict or unchecked_rules(data, rules):
        frames.append(column_failures(data, rules))
    return union_all(frames)


def validate(data: DataFrame, rules: TableRule) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, in their declared types; all failures).

    A failing column check concerns the table, not single rows: it shows up among
    the failures and the rows that pass keep only declared columns.
    """
    failing = F.lit(False)
    for _, _, condition, _ in _row_cases(data, rules, None):
        failing = failing | F.coalesce(condition, F.lit(False))
    names = [rule.name for rule in _present(data, rules)]
    valid = _with_raw(data, rules).filter(~failing).select(*names)
    for rule in _present(data, rules):
        if rule.unique:
            repeated = repeated_values(coerced(data, rules), rule.name)
            valid = without_keys(valid, repeated, rule.name).select(*names)
    return valid, failures(data, rules)
