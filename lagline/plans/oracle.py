"""SQL counterparts of the named queries, for an independent engine.

``ADAPTER_SQL`` holds the same derivation as ``lagline.sources.adapter`` as
common table expressions; each query appends its own SELECT.
"""

from __future__ import annotations

from itertools import combinations

from lagline.plans.catalog import PROFILED, SMALL_CUTS, WEIGHTS
from lagline.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES, ORDER_STATUSES
from lagline.sources.adapter import PROMISE_BY_PRIORITY, WIDE_EDGES, WIDE_LABELS


# Added after rounding: Spark rounds a tiny negative number to 0.0, not to -0.0.
_ZERO = "0.0::DOUBLE"


def _hash(key: str, salt: str = "") -> str:
    text = f"'{salt}:' || CAST({key} AS VARCHAR)" if salt else f"CAST({key} AS VARCHAR)"
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


def _case(pairs: dict[str, int], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + " END"


ADAPTER_SQL = f"""
WITH base AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'delivered' END AS order_status,
         o_orderdate, {_hash('o_orderkey')} AS h,
         {_case(PROMISE_BY_PRIORITY, "substr(o_orderpriority, 1, 1)")} AS promise,
         o_orderdate + to_minutes({_hash('o_orderkey')} % 1440) AS order_purchase_timestamp
  FROM orders
),
delivery AS (
  SELECT order_id, min(l_shipdate) AS order_delivered_customer_date
  FROM base JOIN lineitem ON l_orderkey = order_id AND l_shipdate >= order_purchase_timestamp
  GROUP BY order_id
),
m_orders AS (
  SELECT order_id, customer_id, order_status, order_purchase_timestamp,
         CASE WHEN h % 50 <> 0 THEN order_purchase_timestamp + to_hours(h % 72) END
           AS order_approved_at,
         order_delivered_customer_date,
         o_orderdate + to_days(CAST(promise AS INTEGER)) AS order_estimated_delivery_date
  FROM base LEFT JOIN delivery USING (order_id)
),
m_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_suppkey AS seller_id,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))
              AS DECIMAL(12,2)) AS freight_value
  FROM lineitem
),
m_customers AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS customer_city, n_name AS customer_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
),
labelled AS (
  SELECT *, CAST(CASE WHEN order_delivered_customer_date > order_estimated_delivery_date
                      THEN 1 ELSE 0 END AS INTEGER) AS is_late
  FROM m_orders
  WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
    AND order_estimated_delivery_date IS NOT NULL AND order_approved_at IS NOT NULL
),
rollup AS (
  SELECT order_id, count(order_item_id) AS item_count, count(DISTINCT seller_id) AS seller_count,
         CAST(sum(price) AS DOUBLE) AS total_price,
         CAST(sum(freight_value) AS DOUBLE) AS total_freight
  FROM m_items GROUP BY order_id
),
dataset AS (
  SELECT l.*, r.item_count, r.seller_count, r.total_price, r.total_freight,
         c.customer_city, c.customer_state
  FROM labelled l LEFT JOIN rollup r USING (order_id) LEFT JOIN m_customers c USING (customer_id)
),
features AS (
  SELECT *,
    (epoch_us(order_estimated_delivery_date) - epoch_us(order_approved_at)) / 86400000000
      AS promised_days,
    CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month,
    CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS purchase_weekday,
    CAST(hour(order_purchase_timestamp) AS INTEGER) AS purchase_hour
  FROM dataset
),
scored AS (
  SELECT order_id, is_late,
    least(99, greatest(0, 60 - 8 * item_count + (1095 - p) // 20)) / 100.0::DOUBLE
      AS probability_positive,
    least(99, greatest(0, 35 - 4 * item_count + (1095 - p) // 20)) / 100.0::DOUBLE
      AS second_probability
  FROM (SELECT *, date_diff('day', order_purchase_timestamp, order_estimated_delivery_date) AS p
        FROM features)
),
split AS (
  SELECT *, {_hash('order_id', '42')} % 10000 < 8000 AS in_train,
         CAST({_hash('order_id', 'fold:42')} % 3 AS INTEGER) AS fold
  FROM features
),
model_input AS (
  SELECT order_id, purchase_hour, purchase_weekday, purchase_month, promised_days,
         CAST(item_count AS DOUBLE) AS item_count, CAST(seller_count AS DOUBLE) AS seller_count,
         total_price, total_freight, customer_state, is_late
  FROM features
),
raw_base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, {_hash('o_orderkey')} AS h,
         o_orderdate + to_minutes({_hash('o_orderkey')} % 1440) AS purchase
  FROM orders
),
raw_orders AS (
  SELECT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, CASE WHEN h % 101 = 0 THEN 31 ELSE 32 END)
           AS order_id,
         md5(CAST(o_custkey AS VARCHAR)) AS customer_id,
         CASE WHEN h % 89 = 0 THEN 'lost' WHEN o_orderstatus = 'P' THEN 'processing'
              ELSE 'delivered' END AS order_status,
         CASE WHEN h % 97 <> 0 THEN CAST(purchase AS VARCHAR) END AS order_purchase_timestamp,
         CASE WHEN h % 83 = 0 THEN 'not a date'
              WHEN h % 79 = 0 THEN CAST(purchase - to_minutes(60) AS VARCHAR)
              WHEN h % 50 <> 0 THEN CAST(purchase + to_hours(h % 72) AS VARCHAR) END
           AS order_approved_at,
         CASE WHEN h % 71 = 0 THEN 'soon'
              WHEN h % 3 <> 0 THEN CAST(purchase + to_days(4) AS VARCHAR) END
           AS order_delivered_carrier_date,
         CASE WHEN h % 67 = 0 THEN 'unknown'
              WHEN h % 4 <> 0 THEN CAST(purchase + to_days(9) AS VARCHAR) END
           AS order_delivered_customer_date,
         CASE WHEN h % 61 = 0 THEN 'to be set'
              WHEN h % 59 <> 0 THEN CAST(purchase + to_days(20) AS VARCHAR) END
           AS order_estimated_delivery_date
  FROM raw_base
)
"""

ORACLE_SQL: dict[str, str] = {}


def _add(name: str, select: str, ctes: str = "") -> None:
    ORACLE_SQL[name] = ADAPTER_SQL + (f", {ctes.strip()}" if ctes else "") + select


def _rates(key: str, source: str = "features") -> str:
    return (
        f"SELECT {key}, avg(is_late) AS delay_rate, count(order_id) AS order_count "
        f"FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}"
    )


# Sources and sinks

_add(
    "csv_scan",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
    item_count, total_price, customer_state, is_late FROM features""",
)
_add("csv_timestamp_scan", "SELECT * FROM m_orders")
ORACLE_SQL["parquet_scan"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'"
_add("parquet_sink", "SELECT * FROM features")
ORACLE_SQL["table_shapes"] = """
SELECT 'orders' AS table_name, count(*) AS row_count, CAST(7 AS INTEGER) AS column_count FROM orders
UNION ALL SELECT 'items', count(*), CAST(5 AS INTEGER) FROM lineitem
UNION ALL SELECT 'customers', count(*), CAST(3 AS INTEGER) FROM customer"""
_add(
    "score_preview",
    """SELECT order_id, probability_positive,
    CAST(CASE WHEN probability_positive >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS prediction
    FROM scored ORDER BY order_id LIMIT 20""",
)

# Projections, filters, predicates

_add("delivered_orders", "SELECT * EXCLUDE (is_late) FROM labelled")
_add("label_late", "SELECT * FROM labelled")
_add("model_input", "SELECT * FROM model_input")
_add("customer_prune", "SELECT * FROM m_customers")
_add(
    "fold_filter",
    """SELECT order_id, is_late, CASE WHEN fold = 0 THEN 'held_out' ELSE 'others' END AS part
    FROM split""",
)
_add(
    "threshold_label",
    """SELECT order_id, probability_positive,
    CAST(CASE WHEN probability_positive >= CAST(0.16 AS DOUBLE) THEN 1 ELSE 0 END AS INTEGER)
      AS prediction FROM scored""",
)
_add("min_support_filter", _rates("customer_state") + " HAVING count(order_id) >= 100")
_add(
    "nonpositive_promise",
    "SELECT CAST(count(*) FILTER (promised_days <= 0) AS BIGINT) AS nonpositive_count FROM features",
)

# Joins

_add(
    "order_item_join",
    """SELECT order_id, order_status, CAST(item_count AS DOUBLE) AS item_count,
      CAST(seller_count AS DOUBLE) AS seller_count, total_price, total_freight
    FROM m_orders LEFT JOIN rollup USING (order_id)""",
)
_add(
    "order_customer_join",
    """SELECT customer_id, order_id, customer_city, customer_state
    FROM m_orders LEFT JOIN m_customers USING (customer_id)""",
)
_add("order_dataset", "SELECT * FROM dataset")
_add(
    "join_cardinality",
    """SELECT 'right' AS side, order_id, count(*) AS occurrences FROM m_items
    GROUP BY order_id HAVING count(*) > 1""",
)
_add(
    "checked_order_join",
    """SELECT order_id, customer_id, is_late, item_count, seller_count, total_price, total_freight,
    customer_city, customer_state FROM dataset""",
)

# Aggregations

_add("aggregate_items", "SELECT * FROM rollup")
_add(
    "class_balance",
    """SELECT is_late, count(*) AS order_count, count(*) / sum(count(*)) OVER () AS order_share
    FROM (SELECT CAST(l.is_late AS VARCHAR) AS is_late FROM m_orders o LEFT JOIN labelled l USING (order_id)) GROUP BY is_late""",
)
_add(
    "describe_promised_days",
    """SELECT count(promised_days) AS count, round(avg(promised_days), 6) AS mean,
    round(stddev_samp(promised_days), 6) AS std, round(min(promised_days), 6) AS min,
    round(quantile_cont(promised_days, 0.25), 6) AS q1,
    round(quantile_cont(promised_days, 0.5), 6) AS median,
    round(quantile_cont(promised_days, 0.75), 6) AS q3, round(max(promised_days), 6) AS max
    FROM features""",
)


def _wide_bin(value: str) -> str:
    cases = [f"WHEN {value} <= {WIDE_EDGES[0]} THEN NULL"]
    for high, label in zip(WIDE_EDGES[1:-1], WIDE_LABELS):
        cases.append(f"WHEN {value} <= {high} THEN '{label}'")
    return f"CASE WHEN {value} IS NULL THEN NULL {' '.join(cases)} ELSE '{WIDE_LABELS[-1]}' END"


_add(
    "delay_by_promised_range",
    _rates("promised_days_range", "binned"),
    f"binned AS (SELECT *, {_wide_bin('promised_days')} AS promised_days_range FROM features)",
)
_add("delay_by_items", _rates("item_count"))
_add("delay_by_sellers", _rates("seller_count"))
_add("delay_by_state", _rates("customer_state") + " HAVING count(order_id) >= 100")
_add("delay_by_month", _rates("purchase_month"))
_add(
    "majority_baseline",
    "SELECT avg(CASE WHEN is_late = 0 THEN 1 ELSE 0 END) AS accuracy FROM features",
)

# Windows, sorting, top-k

for _name, _key in (("items", "item_count"), ("sellers", "seller_count")):
    _add(
        f"cumulative_orders_by_{_name}",
        f"""SELECT *, CAST(sum(order_count) OVER (ORDER BY {_key}) AS BIGINT) AS order_count_cumsum,
        sum(order_count) OVER (ORDER BY {_key}) / sum(order_count) OVER ()
          AS order_count_cumsum_pct FROM rates""",
        f"rates AS ({_rates(_key)})",
    )
_add(
    "states_ranked",
    "SELECT *, CAST(row_number() OVER (ORDER BY delay_rate DESC, customer_state) AS INTEGER) "
    f"AS position FROM ({_rates('customer_state')})",
)
_add(
    "uncertainty_topk",
    """SELECT order_id, probability_positive FROM scored
    ORDER BY abs(probability_positive - 0.5::DOUBLE), order_id LIMIT 10""",
)

_F1 = """CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE
         ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END"""


def _curve(name: str, score: str) -> str:
    return f"""
    {name}_counts AS (
      SELECT i / 100.0::DOUBLE AS threshold,
        count(*) FILTER (is_late = 1 AND {score} >= i / 100.0::DOUBLE) AS tp,
        count(*) FILTER (is_late = 0 AND {score} >= i / 100.0::DOUBLE) AS fp,
        count(*) FILTER (is_late = 1 AND NOT {score} >= i / 100.0::DOUBLE) AS fn
      FROM scored, range(5, 51) AS t(i) GROUP BY i
    ),
    {name} AS (
      SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS recall, {_F1} AS f1
      FROM {name}_counts
    )"""


_add(
    "best_candidate",
    """SELECT * FROM (
      (SELECT CAST(0 AS INTEGER) AS candidate_order, 'first' AS model_name, threshold, f1 FROM a
       ORDER BY f1 DESC, threshold LIMIT 1)
      UNION ALL
      (SELECT CAST(1 AS INTEGER), 'second', threshold, f1 FROM b ORDER BY f1 DESC, threshold LIMIT 1)
    ) ORDER BY f1 DESC, candidate_order LIMIT 1""",
    _curve("a", "probability_positive") + "," + _curve("b", "second_probability"),
)

# Set operations

_add("oof_union", "SELECT is_late, probability_positive FROM scored")
_add(
    "except_distinct",
    """SELECT item_count, seller_count, order_status, is_late FROM split
    EXCEPT SELECT item_count, seller_count, order_status, is_late FROM split WHERE in_train""",
)

# Scalar functions

_add(
    "promised_days",
    """SELECT order_id, (epoch_us(order_estimated_delivery_date) - epoch_us(order_approved_at))
      / 86400000000 AS promised_days FROM m_orders""",
)
_add(
    "purchase_month",
    """SELECT order_id, CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month
    FROM m_orders""",
)
_add(
    "purchase_weekday",
    """SELECT order_id, CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS purchase_weekday
    FROM m_orders""",
)
_add(
    "purchase_hour",
    """SELECT order_id, CAST(hour(order_purchase_timestamp) AS INTEGER) AS purchase_hour
    FROM m_orders""",
)
_add("order_features", "SELECT * FROM features")
_add(
    "promised_range_bin",
    f"SELECT order_id, {_wide_bin('days')} AS promised_days_range FROM days",
    """days AS (SELECT order_id, (epoch_us(order_estimated_delivery_date)
      - epoch_us(order_approved_at)) / 86400000000 AS days FROM m_orders)""",
)
_add(
    "cast_numeric",
    """SELECT order_id, CAST(is_late AS TINYINT) AS late_flag,
    epoch_us(order_purchase_timestamp) / 1000000 AS purchase_seconds FROM labelled""",
)
_add(
    "abs_distance",
    "SELECT order_id, abs(probability_positive - 0.5::DOUBLE) AS distance FROM scored",
)

ORACLE_SQL["order_dataset_bucketed"] = ORACLE_SQL["order_dataset"]

# Data quality and profile


def _failure(check: str, column: str | None, where: str, value: str) -> str:
    name = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT '{check}' AS \"check\", {name} AS \"column\", order_id AS key, "
        f"CAST({value} AS VARCHAR) AS value FROM raw_orders WHERE {where}"
    )


_PURCHASE = "TRY_CAST(order_purchase_timestamp AS TIMESTAMP)"
_APPROVED = "TRY_CAST(order_approved_at AS TIMESTAMP)"
_LATER = (
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
_STATUSES = ", ".join(f"'{status}'" for status in ORDER_STATUSES)
_FAILURES = {
    "dq_not_null": [
        _failure("not_null", name, f"{name} IS NULL", name)
        for name in (
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_timestamp",
            "order_estimated_delivery_date",
        )
    ],
    "dq_unique": [
        _failure(
            "unique",
            name,
            f"{name} IN (SELECT {name} FROM raw_orders GROUP BY {name} HAVING count(*) > 1)",
            name,
        )
        for name in ("order_id", "customer_id")
    ],
    "dq_length": [
        _failure("length", name, f"length({name}) <> 32", name)
        for name in ("order_id", "customer_id")
    ],
    "dq_allowed_values": [
        _failure(
            "allowed_values", "order_status", f"order_status NOT IN ({_STATUSES})", "order_status"
        )
    ],
    "dq_type_coerce": [
        _failure("type_coerce", name, f"{name} IS NOT NULL AND {cast} IS NULL", name)
        for name, cast in (
            ("order_purchase_timestamp", _PURCHASE),
            ("order_approved_at", _APPROVED),
            *[(name, f"TRY_CAST({name} AS TIMESTAMP)") for name in _LATER],
        )
    ],
    "dq_row_rule": [
        _failure(
            "approval_after_purchase",
            None,
            f"NOT coalesce({_APPROVED} IS NULL OR {_APPROVED} >= {_PURCHASE}, false)",
            "NULL",
        )
    ],
}
for _name, _parts in _FAILURES.items():
    _add(_name, " UNION ALL ".join(_parts))
_add(
    "dq_failures",
    " UNION ALL ".join(
        part
        for parts in _FAILURES.values()
        for part in parts
        if "'order_delivered_carrier_date' AS" not in part
    )
    + " UNION ALL SELECT 'missing_column', 'order_delivered_carrier_date', NULL, NULL"
    + " UNION ALL SELECT 'extra_column', 'channel', NULL, NULL",
)
_add(
    "dq_strict_columns",
    """SELECT name AS "check", col AS "column", (SELECT count(*) FROM raw_orders) AS affected_rows
    FROM (VALUES
      ('missing_column', 'order_delivered_carrier_date'),
      ('extra_column', 'channel')) AS t(name, col)""",
)
_add(
    "dq_valid_rows",
    f"""SELECT order_id, customer_id, order_status,
      {_PURCHASE} AS order_purchase_timestamp, {_APPROVED} AS order_approved_at,
      {", ".join(f"TRY_CAST({name} AS TIMESTAMP) AS {name}" for name in _LATER)}
    FROM raw_orders
    WHERE length(order_id) = 32 AND order_status IN ({_STATUSES})
      AND {" AND ".join(f"({name} IS NULL OR TRY_CAST({name} AS TIMESTAMP) IS NOT NULL)" for name in _LATER)}
      AND order_estimated_delivery_date IS NOT NULL
      AND {_PURCHASE} IS NOT NULL AND (order_approved_at IS NULL OR {_APPROVED} >= {_PURCHASE})""",
)


# Columns of the orders table that are profiled as text.
_ORDER_TEXTS = (
    "order_status",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)


def _column_profile(name: str, table: str = "model_input") -> str:
    common = (
        f"SELECT '{name}' AS column_name, count({name}) AS value_count, "
        f"count(*) FILTER ({name} IS NULL) AS null_count, count(DISTINCT {name}) AS distinct_count, "
    )
    if name == "customer_state" or name in _ORDER_TEXTS:
        text = f"CAST({name} AS VARCHAR)"
        rest = f"min({text}) AS min_text, max({text}) AS max_text, " + ", ".join(
            f"CAST(NULL AS DOUBLE) AS {field}"
            for field in ("min_value", "max_value", "mean", "std", "q1", "median", "q3")
        )
    else:
        rest = (
            "CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text, "
            f"CAST(min({name}) AS DOUBLE) AS min_value, CAST(max({name}) AS DOUBLE) AS max_value, "
            f"round(avg({name}), 6) AS mean, round(stddev_samp({name}), 6) AS std, "
            + ", ".join(
                f"round(quantile_cont(CAST({name} AS DOUBLE), {q}), 6) AS {field}"
                for field, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
            )
        )
    return f"{common}{rest} FROM {table}"


_add(
    "profile_columns",
    " UNION ALL ".join(
        [_column_profile(n, "m_orders") for n in ("order_id", "customer_id", *_ORDER_TEXTS)]
        + [_column_profile(n) for n in PROFILED]
    ),
)
def _sketch_profile(name: str, is_number: bool) -> str:
    number = f"CAST({name} AS DOUBLE)" if is_number else "NULL::DOUBLE"
    text = "NULL::VARCHAR" if is_number else name
    return (
        f"SELECT '{name}' AS column_name, count({name}) AS value_count, "
        f"count(*) FILTER ({name} IS NULL) AS null_count, min({text}) AS min_text, max({text}) AS max_text, "
        f"round(min({number}), 4) AS min_value, round(max({number}), 4) AS max_value, "
        f"round(avg({number}), 4) AS mean, true AS distinct_close, true AS median_between FROM features"
    )


_add(
    "profile_sketches",
    " UNION ALL ".join(
        _sketch_profile(name, name != "order_status")
        for name in ("order_id", "order_status", "total_price", "promised_days")
    ),
)
_add(
    "profile_top_values",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_name
        ORDER BY occurrences DESC, value) AS INTEGER) AS position FROM counts) WHERE position <= 5""",
    "counts AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, CAST({name} AS VARCHAR) AS value, count(*) AS occurrences "
        f"FROM dataset WHERE {name} IS NOT NULL GROUP BY {name}"
        for name in ("customer_state", "customer_city", "customer_id")
    )
    + ")",
)
_add(
    "profile_histogram",
    """SELECT column_name, bin, low + (high - low) * bin / 10 AS bin_low,
      low + (high - low) * (bin + 1) / 10 AS bin_high, occurrences
    FROM (SELECT column_name, low, high, CAST(CASE WHEN high - low = 0 THEN 0
            ELSE least(9, floor((value - low) * 10 / (high - low))) END AS INTEGER) AS bin,
            count(*) AS occurrences
          FROM ranged GROUP BY ALL)""",
    """entries AS ("""
    + " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {name} AS value FROM model_input"
        for name in NUMERIC_FEATURES
    )
    + """), ranged AS (SELECT *, min(value) OVER (PARTITION BY column_name) AS low,
      max(value) OVER (PARTITION BY column_name) AS high FROM entries)""",
)
_add(
    "profile_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) + {_ZERO} "
        "AS correlation FROM model_input"
        for a, b in combinations(NUMERIC_FEATURES, 2)
    ),
)

# Sampling and splits

_add(
    "stratified_split",
    "SELECT order_id, is_late, CASE WHEN in_train THEN 'train' ELSE 'test' END AS part FROM split",
)
_add("fold_assign", "SELECT order_id, is_late, fold FROM split")


def _sample(source: str, size: str, seed: str, name: str) -> str:
    """Exact sample by largest remainder: adds CTEs ending in ``name`` with a flag."""
    return f"""
    {name}_class AS (SELECT is_late, count(*) AS n FROM {source} GROUP BY is_late),
    {name}_size AS (SELECT {size} AS size, sum(n) AS total FROM {name}_class),
    {name}_quota AS (
      SELECT is_late, (size * n) // total
        + CASE WHEN row_number() OVER (ORDER BY (size * n) % total DESC, is_late)
            <= size - sum((size * n) // total) OVER () THEN 1 ELSE 0 END AS quota
      FROM {name}_class, {name}_size),
    {name} AS (
      SELECT order_id, is_late, row_number() OVER (PARTITION BY is_late
          ORDER BY {_hash('order_id', seed)}, order_id) <= quota AS selected
      FROM {source} JOIN {name}_quota USING (is_late))"""


_QUARTER = "CAST(ceil(sum(n) * 0.25) AS HUGEINT)"
_add(
    "exact_stratified_sample",
    "SELECT order_id, is_late FROM sampled WHERE selected",
    _sample("labelled", _QUARTER, "sample:42", "sampled"),
)
_add(
    "capped_sample",
    f"SELECT order_id, is_late FROM labelled ORDER BY {_hash('order_id', 'sample:42')}, order_id LIMIT 2000",
)
_add(
    "disjointness_check",
    """SELECT count(*) AS data_rows, count(*) FILTER (in_train) AS train_rows,
    count(*) FILTER (NOT in_train) AS test_rows, CAST(0 AS BIGINT) AS in_both,
    CAST(0 AS BIGINT) AS in_neither, CAST(0 AS BIGINT) AS unknown FROM split""",
)

# Encoding


def _index(source: str) -> str:
    """Category positions per column: most frequent first, ties by text."""
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, CAST({name} AS VARCHAR) AS value, "
        f"CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({name} AS VARCHAR)) - 1 AS INTEGER) "
        f"AS value_index FROM {source} WHERE {name} IS NOT NULL GROUP BY {name}"
        for name in CATEGORICAL_FEATURES
    )
    return f"category AS ({parts}), width AS (SELECT column_name, count(*) + 1 AS slots FROM category GROUP BY 1)"


def _slot(name: str) -> str:
    return (
        f"(SELECT value_index FROM category WHERE column_name = '{name}' "
        f"AND value = CAST(m.{name} AS VARCHAR))"
    )


def _offset(name: str) -> str:
    before = CATEGORICAL_FEATURES[: CATEGORICAL_FEATURES.index(name)]
    names = ", ".join(f"'{n}'" for n in before) or "''"
    return (
        f"({len(NUMERIC_FEATURES)} + coalesce((SELECT sum(slots) FROM width "
        f"WHERE column_name IN ({names})), 0))"
    )


_add("string_index", "SELECT column_name, value, value_index FROM category", _index("model_input"))
_add(
    "one_hot",
    "SELECT order_id, "
    + ", ".join(f"{_slot(name)} AS {name}_slot" for name in CATEGORICAL_FEATURES)
    + ", (SELECT CAST(slots AS INTEGER) FROM width WHERE column_name = 'customer_state')"
    " AS state_width FROM model_input m",
    _index("model_input"),
)


def _vectors(source: str) -> str:
    hot = " || ',' || ".join(
        f"CAST({_offset(name)} + {_slot(name)} AS VARCHAR)" for name in CATEGORICAL_FEATURES
    )
    numbers = ", ".join(f"{name} AS slot_{name}" for name in NUMERIC_FEATURES)
    return (
        f"SELECT order_id, (SELECT CAST({len(NUMERIC_FEATURES)} + sum(slots) AS INTEGER) FROM width) "
        f"AS width, {numbers}, {hot} AS hot_slots FROM {source} m"
    )


_add("assemble", _vectors("model_input"), _index("model_input"))
_TRAIN = (
    f"train AS (SELECT * FROM model_input WHERE {_hash('order_id', '42')} % 10000 < 8000), "
)
_add(
    "shap_input",
    _vectors("sampled"),
    _TRAIN
    + _index("train")
    + f""", sampled AS (SELECT * FROM model_input
      ORDER BY {_hash('order_id', 'sample:42')}, order_id LIMIT 2000)""",
)
_add(
    "feature_names",
    " UNION ALL ".join(
        [
            f"SELECT CAST({i} AS INTEGER) AS slot, '{name}' AS feature"
            for i, name in enumerate(NUMERIC_FEATURES)
        ]
        + [
            f"SELECT CAST({_offset(name)} + value_index AS INTEGER), '{name}_ohe_' || value "
            f"FROM category WHERE column_name = '{name}' UNION ALL "
            f"SELECT CAST({_offset(name)} + slots - 1 AS INTEGER), '{name}_ohe___unknown' "
            f"FROM width WHERE column_name = '{name}'"
            for name in CATEGORICAL_FEATURES
        ]
    ),
    _index("model_input"),
)
_add(
    "standard_scale",
    "SELECT order_id, "
    + ", ".join(
        f"round(({n} - avg({n}) OVER ()) / stddev_samp({n}) OVER (), 6) + {_ZERO} AS scaled_{n}"
        for n in NUMERIC_FEATURES
    )
    + " FROM model_input",
)

# Metrics

_add(
    "threshold_search",
    "SELECT threshold, f1 FROM curve ORDER BY f1 DESC, threshold LIMIT 1",
    _curve("curve", "probability_positive"),
)
_add("threshold_curve", "SELECT * FROM curve", _curve("curve", "probability_positive"))
_add(
    "out_of_fold",
    """SELECT order_id, is_late, fold, CAST(2 AS BIGINT) AS times_scored FROM split
    WHERE in_train""",
)

# Fitted models: what must hold of any fit, per order

_TEST = "FROM split WHERE NOT in_train"
_add("model_store", f"SELECT order_id, true AS agrees {_TEST}")
_add("positive_probability", f"SELECT order_id, true AS probability_ok {_TEST}")
for _name, _trees in (("gbt", 100), ("deep_gbt", 200), ("leafwise", 200)):
    _add(
        f"{_name}_candidate",
        f"SELECT order_id, is_late, CAST({_trees} AS INTEGER) AS trees, true AS depth_ok, "
        f"true AS probability_ok {_TEST}",
    )
_add(
    "logistic_candidate",
    f"SELECT order_id, is_late, true AS gradient_ok, true AS probability_ok {_TEST}",
)
_add(
    "train_winner",
    f"SELECT true AS is_winner, true AS has_threshold, count(*) AS order_count {_TEST}",
)
_add(
    "cross_validate",
    """SELECT CAST(c AS INTEGER) AS candidate_order, name AS model_name, true AS on_grid,
      true AS f1_ok FROM (VALUES (0, 'gbt'), (1, 'deep_gbt')) AS t(c, name)""",
)
_add("evaluate_model", f"SELECT count(*) AS order_count, true AS f1_ok, true AS area_ok {_TEST}")
_add("predict", f"SELECT order_id, is_late, true AS follows, true AS probability_ok {_TEST}")
_add(
    "score_orders",
    "SELECT order_id, purchase_hour, customer_state, is_late, true AS sound FROM model_input",
)
_add("score_consistency", "SELECT order_id, is_late, true AS consistent FROM features")
_add(
    "confusion_metrics",
    """SELECT tp, fp, fn, precision, recall, f1 FROM curve
    WHERE threshold = 16 / 100.0::DOUBLE""",
    _curve("curve", "probability_positive"),
)
_add(
    "roc_auc",
    """SELECT round(CAST(sum(pos * (2 * below + neg)) AS DOUBLE)
      / (2 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 9) AS roc_auc
    FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY probability_positive
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score)""",
    """by_score AS (SELECT probability_positive, count(*) FILTER (is_late = 1) AS pos,
      count(*) FILTER (is_late = 0) AS neg FROM scored GROUP BY 1)""",
)
_add(
    "accuracy",
    """SELECT avg(CASE WHEN is_late = CASE WHEN probability_positive >= 0.5 THEN 1 ELSE 0 END
      THEN 1 ELSE 0 END) AS accuracy FROM scored""",
)

# Histogram boosting: models of one tree, grown by the same sums

_UNIT = "16777216.0::DOUBLE"
_CATEGORY = {name: f"CAST({name} AS VARCHAR)" for name in CATEGORICAL_FEATURES}
_CUT_ROWS = ", ".join(
    f"({slot}, '{name}', {cut}::DOUBLE, {b})"
    for slot, name in enumerate(NUMERIC_FEATURES)
    for b, cut in enumerate(SMALL_CUTS[name])
)
_LONG = " UNION ALL ".join(
    [f"SELECT f, order_id, g, h, '{n}' AS column_name, CAST({n} AS DOUBLE) AS x, NULL AS v FROM seen"
     for n in NUMERIC_FEATURES]
    + [f"SELECT f, order_id, g, h, '{n}', NULL, {text} FROM seen" for n, text in _CATEGORY.items()]
)
# Whether a row goes left at the split in the same row of the join.
_LEFT = (
    "CASE column_name "
    + " ".join(f"WHEN '{n}' THEN {n} <= threshold" for n in NUMERIC_FEATURES)
    + " ".join(f" WHEN '{n}' THEN coalesce({text} <> category, true)" for n, text in _CATEGORY.items())
    + " END"
)
_SLOPES = (
    _TRAIN.replace("model_input", "split").strip().removesuffix(",")
    + f""",
    {_index("train")},
    cuts(slot, column_name, threshold, bin) AS (VALUES {_CUT_ROWS}),
    firsts(column_name, slot) AS (
      {" UNION ALL ".join(f"SELECT '{n}', {_offset(n)}" for n in CATEGORICAL_FEATURES)}),
    options AS (
      SELECT slot, column_name, threshold, bin, NULL AS category FROM cuts UNION ALL
      SELECT slot + value_index, column_name, 0.5::DOUBLE, value_index, value
      FROM category JOIN firsts USING (column_name)),
    base_rates AS (
      SELECT f, sum(is_late) / count(*) AS share
      FROM (SELECT unnest([0, 1, 2, -1]) AS f) JOIN train ON fold <> f GROUP BY f),
    started AS (
      SELECT f, ln(share / (1 - share)) AS margin, 1 / (1 + exp(-ln(share / (1 - share)))) AS p FROM base_rates),
    seen AS (
      SELECT f, t.*, CAST(round((p - is_late) * {_UNIT}) AS BIGINT) AS g,
             CAST(round(p * (1 - p) * {_UNIT}) AS BIGINT) AS h
      FROM started JOIN train t ON fold <> f),
    long AS ({_LONG}),
    families(model_name, candidate_order, l2, min_hessian, min_rows) AS (
      VALUES ('deep_gbt', 0, 1.0::DOUBLE, 1.0::DOUBLE, 1), ('leafwise', 1, 0.0::DOUBLE, 0.001::DOUBLE, 20))"""
)


def _term(g: str, h: str) -> str:
    return f"({g} / {_UNIT}) * ({g} / {_UNIT}) / ({h} / {_UNIT} + l2)"


def _best_split(name: str, rows: str) -> str:
    """The split with the largest gain per family, run and node of ``rows``."""
    return f"""
    {name}_sums AS (
      SELECT f, node, slot, column_name, threshold, category,
        coalesce(sum(g) FILTER (goes_left), 0) AS gl, coalesce(sum(h) FILTER (goes_left), 0) AS hl,
        count(*) FILTER (goes_left) AS nl, sum(g) AS g, sum(h) AS h, count(*) AS n
      FROM (SELECT r.*, o.slot, o.threshold, o.category,
                   CASE WHEN o.category IS NULL THEN x <= o.threshold ELSE v <> o.category END AS goes_left
            FROM {rows} r JOIN options o USING (column_name))
      GROUP BY ALL),
    {name}_gains AS (
      SELECT *, {_term("gl", "hl")} + {_term("(g - gl)", "(h - hl)")} - {_term("g", "h")} AS gain
      FROM {name}_sums, families
      WHERE hl >= min_hessian * {_UNIT} AND h - hl >= min_hessian * {_UNIT}
        AND nl >= min_rows AND n - nl >= min_rows),
    {name} AS (
      SELECT * FROM {name}_gains WHERE gain > 1e-6
      QUALIFY row_number() OVER (PARTITION BY model_name, f, node ORDER BY gain DESC, slot, threshold) = 1)"""


_STUMPS = (
    _SLOPES
    + ", roots AS (SELECT *, '' AS node FROM long), "
    + _best_split("split1", "roots")
    + f""",
    stumps AS (
      SELECT *, margin - gl / {_UNIT} / (hl / {_UNIT} + l2) * 0.05::DOUBLE AS left_margin,
             margin - (g - gl) / {_UNIT} / ((h - hl) / {_UNIT} + l2) * 0.05::DOUBLE AS right_margin
      FROM split1 JOIN started USING (f)),
    held_out AS (
      SELECT model_name, candidate_order, t.order_id, t.is_late, t.fold,
             1 / (1 + exp(-CASE WHEN {_LEFT} THEN left_margin ELSE right_margin END)) AS probability_positive
      FROM train t JOIN stumps s ON s.f = t.fold),
    stump_counts AS (
      SELECT model_name, candidate_order, i / 100.0::DOUBLE AS threshold,
        count(*) FILTER (is_late = 1 AND probability_positive >= i / 100.0::DOUBLE) AS tp,
        count(*) FILTER (is_late = 0 AND probability_positive >= i / 100.0::DOUBLE) AS fp,
        count(*) FILTER (is_late = 1 AND NOT probability_positive >= i / 100.0::DOUBLE) AS fn
      FROM held_out, range(5, 51) AS t(i) GROUP BY ALL),
    stump_results AS (
      SELECT CAST(candidate_order AS INTEGER) AS candidate_order, model_name, threshold, {_F1} AS f1
      FROM stump_counts
      QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY {_F1} DESC, threshold) = 1),
    winner AS (SELECT * FROM stump_results ORDER BY f1 DESC, candidate_order LIMIT 1),
    chosen AS (SELECT s.*, w.threshold AS cut FROM stumps s JOIN winner w USING (model_name) WHERE s.f = -1),
    tested AS (
      SELECT t.order_id, t.is_late, cut, model_name,
             1 / (1 + exp(-CASE WHEN {_LEFT} THEN left_margin ELSE right_margin END)) AS probability_positive
      FROM split t, chosen WHERE NOT in_train)"""
)
_add(
    "boosting_histogram",
    """SELECT CAST(f AS INTEGER) AS fold, column_name AS feature, CAST(bin AS INTEGER) AS bin,
      CAST(coalesce(sum(g), 0) AS BIGINT) AS grad, CAST(coalesce(sum(h), 0) AS BIGINT) AS hess,
      count(order_id) AS order_count
    FROM all_bins LEFT JOIN binned USING (f, column_name, bin) GROUP BY ALL""",
    _SLOPES
    + """, binned AS (
      SELECT l.*, CASE WHEN l.v IS NULL
          THEN (SELECT count(*) FROM cuts c WHERE c.column_name = l.column_name AND c.threshold < l.x)
          ELSE (SELECT value_index FROM category c WHERE c.column_name = l.column_name AND c.value = l.v)
        END AS bin
      FROM long l WHERE f >= 0),
    all_bins AS (
      SELECT f, column_name, unnest(range(bins)) AS bin
      FROM (SELECT unnest([0, 1, 2]) AS f),
           (SELECT column_name, count(*) + 1 AS bins FROM options GROUP BY column_name))""",
)


def _path_rows(split: str, path: str) -> str:
    """Both children of a split as nodes."""
    return " UNION ALL ".join(
        f"SELECT model_name, {path} || '{turn}' AS path, {g} AS g, {h} AS h, {n} AS n, l2 FROM {split}"
        for turn, g, h, n in (("L", "gl", "hl", "nl"), ("R", "g - gl", "h - hl", "n - nl"))
    )


_add(
    "boosted_first_trees",
    f"""SELECT model_name, path, feature, threshold, round(gain, 6) AS gain,
      CAST(n AS BIGINT) AS order_count,
      round(-(n_g / {_UNIT}) / (n_h / {_UNIT} + l2) * 0.05::DOUBLE, 6) + {_ZERO} AS value
    FROM (SELECT a.model_name, a.path, a.g AS n_g, a.h AS n_h, a.n, a.l2, s.gain, s.threshold,
                 coalesce(s.column_name || '_ohe_' || s.category, s.column_name) AS feature
          FROM nodes a LEFT JOIN splits s ON s.model_name = a.model_name AND s.node = a.path)""",
    _SLOPES
    + ", roots AS (SELECT *, '' AS node FROM long WHERE f = -1), "
    + _best_split("split1", "roots")
    + f""",
    turns AS (
      SELECT model_name, t.order_id, CASE WHEN {_LEFT} THEN 'L' ELSE 'R' END AS side
      FROM train t, split1),
    halves AS (
      SELECT l.* EXCLUDE (node), model_name || '/' || side AS node
      FROM roots l JOIN turns USING (order_id)), """
    + _best_split("split2", "halves")
    + """,
    seconds AS (
      SELECT * REPLACE (split_part(node, '/', 2) AS node) FROM split2
      WHERE split_part(node, '/', 1) = model_name),
    grown AS (
      SELECT * FROM seconds WHERE model_name = 'deep_gbt' UNION ALL
      (SELECT * FROM seconds WHERE model_name = 'leafwise' ORDER BY gain DESC, node LIMIT 1)),
    splits AS (SELECT * FROM split1 UNION ALL SELECT * FROM grown),
    nodes AS (
      SELECT model_name, '' AS path, g, h, n, l2 FROM split1 UNION ALL """
    + _path_rows("split1", "''")
    + " UNION ALL "
    + _path_rows("grown", "node")
    + ")",
)
_add(
    "cross_validate_stumps",
    "SELECT candidate_order, model_name, threshold, round(f1, 9) AS f1 FROM stump_results",
    _STUMPS,
)
_add(
    "out_of_fold_stumps",
    """SELECT model_name, order_id, is_late, fold, round(probability_positive, 9) AS probability_positive
    FROM held_out""",
    _STUMPS,
)
_add(
    "evaluate_stump",
    f"""SELECT model_name AS model, cut AS threshold,
      round(CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END, 9) AS precision,
      round(CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END, 9) AS recall,
      round({_F1}, 9) AS f1, round(area, 9) AS roc_auc
    FROM (SELECT model_name, cut,
            count(*) FILTER (is_late = 1 AND probability_positive >= cut) AS tp,
            count(*) FILTER (is_late = 0 AND probability_positive >= cut) AS fp,
            count(*) FILTER (is_late = 1 AND NOT probability_positive >= cut) AS fn
          FROM tested GROUP BY ALL),
      (SELECT CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2 * CAST(sum(pos) AS DOUBLE) * sum(neg)) AS area
       FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY probability_positive
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
             FROM (SELECT probability_positive, count(*) FILTER (is_late = 1) AS pos,
                     count(*) FILTER (is_late = 0) AS neg FROM tested GROUP BY 1)))""",
    _STUMPS,
)
_add(
    "predict_stump",
    """SELECT order_id, is_late, round(probability_positive, 9) AS probability_positive,
      CAST(probability_positive >= cut AS INTEGER) AS prediction FROM tested""",
    _STUMPS,
)
_add(
    "score_increments",
    f"""SELECT order_id, purchase_month AS month,
      round(1 / (1 + exp(-CASE WHEN {_LEFT} THEN left_margin ELSE right_margin END)), 9) AS probability_positive,
      CAST(1 / (1 + exp(-CASE WHEN {_LEFT} THEN left_margin ELSE right_margin END)) >= cut AS INTEGER) AS prediction,
      CAST((SELECT count(DISTINCT purchase_month) FROM features WHERE purchase_month <= 6) AS INTEGER) AS run_1_parts,
      CAST((SELECT count(DISTINCT purchase_month) FROM features WHERE purchase_month > 6) AS INTEGER) AS run_2_parts,
      CAST(0 AS INTEGER) AS run_3_parts
    FROM features, chosen""",
    _STUMPS,
)
_add(
    "shap_stump",
    f"""SELECT order_id, feature, round(CASE WHEN feature = column_name
        THEN CASE WHEN goes_left THEN (left_margin - right_margin) * (n - nl) / n
             ELSE (right_margin - left_margin) * nl / n END ELSE 0 END, 9) + {_ZERO} AS contribution
    FROM (SELECT order_id, {_LEFT} AS goes_left, chosen.* EXCLUDE (f) FROM features, chosen),
      (SELECT unnest([{", ".join(f"'{n}'" for n in (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES))}]) AS feature)""",
    _STUMPS,
)

# Attribution

_LINEAR = (
    "linear AS ("
    + " UNION ALL ".join(
        f"SELECT order_id, '{name}' AS feature, CAST({name} AS DOUBLE) AS value, "
        f"{weight} * ({name} - avg({name}) OVER ()) AS contribution FROM features"
        for name, weight in WEIGHTS.items()
    )
    + """), importances AS (SELECT feature, avg(abs(contribution)) AS importance FROM linear
      GROUP BY feature),
    positions AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER)
      AS position FROM importances)"""
)
_add(
    "shap_values",
    "SELECT order_id, true AS values_ok, true AS contributions_ok FROM model_input",
)
_add(
    "shap_model_importance",
    "SELECT unnest(["
    + ", ".join(f"'{name}'" for name in (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES))
    + "]) AS feature, true AS importance_ok",
)
_add("shap_additivity", "SELECT order_id, 0.0::DOUBLE AS gap FROM features")
_add(
    "shap_importance",
    "SELECT feature, round(importance, 6) AS importance FROM importances",
    _LINEAR,
)
_add(
    "shap_beeswarm_table",
    f"""SELECT feature, order_id, value, round(contribution, 6) + {_ZERO} AS contribution, position,
      round((value - low) / (high - low), 6) AS scaled_value
    FROM linear JOIN positions USING (feature)
    JOIN (SELECT feature, min(value) AS low, max(value) AS high FROM linear GROUP BY 1)
      USING (feature)
    WHERE position <= 3""",
    _LINEAR,
)
_add(
    "shap_top_with_other",
    """SELECT CAST(least(position, 4) AS INTEGER) AS position,
      CASE WHEN position <= 3 THEN feature ELSE 'other' END AS feature,
      round(sum(importance), 6) AS importance, count(*) AS feature_count
    FROM positions GROUP BY 1, 2""",
    _LINEAR,
)

# Active learning

_POOLS = (
    _sample("labelled", _QUARTER, "sample:42", "tested")
    + ", available AS (SELECT order_id, is_late FROM tested WHERE NOT selected), "
    + _sample("available", "CAST(20 AS HUGEINT)", "sample:labelled:42", "initial")
    + """, queried AS (SELECT i.order_id, i.is_late, s.probability_positive
      FROM initial i JOIN scored s USING (order_id) WHERE NOT selected
      ORDER BY abs(s.probability_positive - 0.5::DOUBLE), i.order_id LIMIT 10),
    membership AS (
      SELECT i.order_id, i.is_late, selected,
             i.order_id IN (SELECT order_id FROM queried) AS asked FROM initial i)"""
)
_add(
    "al_partition",
    """SELECT order_id, is_late, 'test' AS part FROM tested WHERE selected
    UNION ALL SELECT order_id, is_late, CASE WHEN selected THEN 'labelled' ELSE 'pool' END
    FROM initial""",
    _POOLS,
)
_add("al_fit", "SELECT order_id, true AS probability_ok FROM initial WHERE NOT selected", _POOLS)
_add(
    "al_round",
    """SELECT stage, labelled + moved AS labelled, pool - moved AS pool, test, true AS accuracy_ok
    FROM (SELECT count(*) FILTER (selected) AS labelled,
                 count(*) FILTER (NOT selected) AS pool FROM initial),
         (SELECT count(*) FILTER (selected) AS test FROM tested),
         (VALUES ('before', 0), ('after', 10)) AS s(stage, moved)""",
    _POOLS,
)
_add("al_query", "SELECT order_id, probability_positive FROM queried", _POOLS)
_add(
    "al_update",
    """SELECT order_id, is_late, CASE WHEN selected OR asked THEN 'labelled' ELSE 'pool' END AS part
    FROM membership""",
    _POOLS,
)
_add("label_union", "SELECT order_id, is_late FROM membership WHERE selected OR asked", _POOLS)
_add(
    "pool_minus_queried",
    "SELECT order_id, is_late FROM membership WHERE NOT (selected OR asked)",
    _POOLS,
)
