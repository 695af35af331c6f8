"""Splits, folds, samples and set operations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lagline.operators import sampling, sets

from .conftest import rows


@pytest.fixture(scope="module")
def labelled(spark):
    data = spark.range(3000).select(
        F.col("id").alias("order_id"), (F.col("id") % 10 < 3).cast("int").alias("is_late")
    )
    return data.withColumn("same", F.lit("x"))


def ids(frame):
    return {r["order_id"] for r in frame.select("order_id").collect()}


def test_split_is_complete_disjoint_and_layout_free(labelled):
    train, test = sampling.split_data(labelled)
    checked = sampling.disjointness(labelled, train, test).first()
    assert (checked["in_both"], checked["in_neither"], checked["unknown"]) == (0, 0, 0)
    assert checked["train_rows"] + checked["test_rows"] == 3000
    assert 0.77 < checked["train_rows"] / 3000 < 0.83
    for parts in (1, 7):
        assert ids(sampling.split_data(labelled.repartition(parts))[0]) == ids(train)


def test_split_seed_and_class_fractions(labelled):
    first, _ = sampling.split_data(labelled, seed=1)
    second, _ = sampling.split_data(labelled, seed=2)
    assert ids(first) != ids(second)
    only_late, _ = sampling.split_data(labelled, label="is_late", fractions={0: 0.0, 1: 1.0})
    assert rows(only_late.groupBy("is_late").count(), "is_late") == [(1, 900)]


def test_disjointness_finds_every_kind_of_fault(labelled):
    train = labelled.filter("order_id < 10")
    test = labelled.filter("order_id >= 8 AND order_id < 20").unionByName(
        labelled.limit(1).withColumn("order_id", F.lit(-5).cast("bigint"))
    )
    row = sampling.disjointness(labelled, train, test).first()
    assert (row["in_both"], row["in_neither"], row["unknown"]) == (2, 2980, 1)


def test_folds_cover_all_rows_and_differ_from_the_split(labelled):
    folded = sampling.assign_folds(labelled)
    counts = rows(folded.groupBy("fold").count(), "fold")
    assert [c[0] for c in counts] == [0, 1, 2] and all(900 < c[1] < 1100 for c in counts)
    train, _ = sampling.split_data(folded)
    assert train.select("fold").distinct().count() == 3
    others, held_out = sampling.fold_parts(folded, 1)
    assert others.count() + held_out.count() == 3000 and "fold" not in others.columns
    assert rows(sampling.assign_folds(labelled.repartition(7)), "order_id") == rows(folded, "order_id")


@pytest.mark.parametrize(
    "counts, size, fraction, expected",
    [
        ({"0": 7, "1": 13}, 9, None, {"0": 3, "1": 6}),
        ({"0": 1, "1": 1, "2": 1}, 2, None, {"0": 1, "1": 1, "2": 0}),
        ({"0": 5, None: 5}, None, 0.15, {None: 1, "0": 1}),
        ({"0": 5, None: 5}, 3, None, {None: 2, "0": 1}),
        ({"0": 2}, 5, None, {"0": 2}),
        ({"0": 3 * 10**17, "1": 10**17}, 10**17, None, {"0": 75 * 10**15, "1": 25 * 10**15}),
    ],
)
def test_quotas_use_largest_remainders(spark, counts, size, fraction, expected):
    classes = spark.createDataFrame(list(counts.items()), "cut_class string, n bigint")
    found = sampling.class_quotas(classes, size, fraction)
    assert {r["cut_class"]: r["quota"] for r in found.collect()} == expected


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_exact_sample_equals_ranking_all_rows(labelled, bits):
    cut = sampling.sample_cut(labelled, size=101, bits=bits)
    chosen = ids(cut.mark(labelled).filter("selected"))
    ranked = labelled.selectExpr(
        "order_id",
        "row_number() OVER (PARTITION BY is_late ORDER BY "
        "conv(substring(md5(concat('sample:42:', order_id)), 1, 8), 16, 10)::bigint, order_id) AS n",
        "is_late",
    ).filter("n <= CASE is_late WHEN 1 THEN 30 ELSE 71 END")
    assert chosen == ids(ranked) and len(chosen) == 101


def test_sample_and_rest_add_up_with_missing_labels(labelled):
    data = labelled.withColumn("is_late", F.when(F.col("order_id") % 4 > 0, F.col("is_late")))
    sample, rest = sampling.stratified_parts(data, fraction=0.25)
    assert sample.count() == 750 and rest.count() == 2250
    assert ids(sample).isdisjoint(ids(rest))
    missing = sample.filter("is_late IS NULL").count()
    assert missing in (187, 188)


def test_small_strata(spark):
    data = spark.range(20).select(
        F.col("id").alias("order_id"), (F.col("id") < 7).cast("int").alias("is_late")
    )
    sample = sampling.exact_stratified_sample(data, size=9)
    assert rows(sample.groupBy("is_late").count(), "is_late") == [(0, 6), (1, 3)]
    everything = sampling.exact_stratified_sample(data, size=50)
    assert everything.count() == 20


def test_a_label_may_have_thousands_of_values(spark):
    data = spark.range(15_000).select(
        F.col("id").alias("order_id"), (F.col("id") % 5_000).alias("city")
    )
    sample = sampling.exact_stratified_sample(data, size=5_000, label="city")
    assert rows(sample.groupBy("city").count().groupBy("count").count(), "count") == [(1, 5_000)]


def test_few_hash_bits_give_the_same_sample(labelled):
    found = [ids(sampling.sample_cut(labelled, size=200, bits=b).parts(labelled)[0]) for b in (2, 16, 32)]
    assert found[0] == found[1] == found[2]


def test_capped_sample_is_exact(labelled):
    small = ids(sampling.capped_sample(labelled, 200))
    assert len(small) == 200
    assert ids(sampling.capped_sample(labelled.repartition(7), 200)) == small
    assert sampling.capped_sample(labelled, 5000).count() == 3000


def test_except_distinct_matches_spark_and_loses_equal_rows(spark):
    columns = "a int, b string"
    left = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None), (3, "z")], columns)
    right = spark.createDataFrame([(2, None), (9, "q")], columns)
    ours = sets.except_distinct(left, right)
    assert rows(ours, "a") == rows(left.subtract(right), "a") == [(1, "x"), (3, "z")]
    assert "Join" not in ours._jdf.queryExecution().executedPlan().toString()


def test_union_matches_columns_by_name_and_keeps_duplicates(spark):
    left = spark.createDataFrame([(1, "x")], "a int, b string")
    right = spark.createDataFrame([("x", 1)], "b string, a int")
    assert rows(sets.union_all([left, right]), "a") == [(1, "x"), (1, "x")]
    assert rows(sets.without_keys(left, right, "a"), "a") == []
