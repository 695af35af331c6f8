"""One round of uncertainty sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.functions.scores import distance_from
from lagline.operators.candidates import logistic_candidate
from lagline.operators.sampling import sample_cut, stratified_parts
from lagline.operators.selection import with_probability
from lagline.operators.sets import union_all, without_keys
from lagline.schemas import ORDER_KEY, SCORE, TARGET
from lagline.session import scratch_path
from lagline.sources.files import save_dataset

# The sizes of a round and the seed.
INITIAL_SIZE = 20
QUERY_SIZE = 10
TEST_FRACTION = 0.25
SEED = 42


@dataclass(frozen=True)
class Pools:
    labelled: DataFrame
    pool: DataFrame
    test: DataFrame


def partition(
    data: DataFrame,
    test_fraction: float = TEST_FRACTION,
    initial_size: int = INITIAL_SIZE,
    label: str = TARGET,
    key: str = ORDER_KEY,
    seed: int = SEED,
) -> Pools:
    """A fixed test set, a small labelled set with every class, and the pool."""
    test, available = stratified_parts(data, fraction=test_fraction, label=label, key=key, seed=seed)
    cut = sample_cut(
        available, size=initial_size, label=label, key=key, seed=f"labelled:{seed}"
    )
    classes = available.select(label).distinct().count()
    if cut.cuts.count() < max(2, classes):
        raise ValueError(f"the labelled set must contain each of the {classes} classes, at least two")
    labelled, pool = cut.parts(available)
    return Pools(labelled, pool, test)


def most_uncertain(
    scored: DataFrame, size: int = QUERY_SIZE, score: str = SCORE, key: str = ORDER_KEY
) -> DataFrame:
    """The rows nearest 0.5, lower key first among equals.

    Spark keeps ``size`` rows per task, or sorts in ranges where ``size`` is large; any
    size works.
    """
    return scored.orderBy(distance_from(score), F.col(key)).limit(size)


def move_queried(
    labelled: DataFrame,
    pool: DataFrame,
    queried: DataFrame,
    labels: DataFrame,
    key: str = ORDER_KEY,
    label: str = TARGET,
) -> tuple[DataFrame, DataFrame]:
    """(labelled with the queried rows added, pool without them).

    ``labels`` is asked for the queried keys only. A short query is broadcast by its
    measured size; a long one is joined by shuffling.
    """
    answers = labels.select(key, label).join(queried.select(key), key)
    revealed = (
        pool.drop(label)
        .join(queried.select(key), key, "left_semi")
        .join(answers, key)
        .select(*labelled.columns)
    )
    return union_all([labelled, revealed]), without_keys(pool, queried, key)


def fit_labelled(labelled: DataFrame, columns: list[str], label: str = TARGET) -> PipelineModel:
    """Scale and fit on the labelled rows only.

    They are picked out of a large table and the fit reads them several times, so they are
    kept meanwhile, unless the caller keeps them already.
    """
    kept = labelled.storageLevel.useMemory or labelled.storageLevel.useDisk
    rows = labelled if kept else labelled.persist()
    try:
        return logistic_candidate(columns, rows.count(), label).fit(rows)
    finally:
        if not kept:
            rows.unpersist()


@dataclass(frozen=True)
class Round:
    before: Pools
    after: Pools
    queried: DataFrame
    report: DataFrame


REPORT_SCHEMA = "stage string, labelled bigint, pool bigint, test bigint, accuracy double"


def run_round(
    data: DataFrame,
    columns: list[str],
    label: str = TARGET,
    key: str = ORDER_KEY,
    initial_size: int = INITIAL_SIZE,
    query_size: int = QUERY_SIZE,
    seed: int = SEED,
) -> Round:
    """Fit, ask for the least certain labels, fit again; accuracy on the fixed test.

    No improvement is promised: a round can lower the accuracy.
    """
    spark = data.sparkSession
    start = partition(data, initial_size=initial_size, label=label, key=key, seed=seed)
    # A handful of rows picked out of a large table; fitting reads them many times.
    small = start.labelled.persist()
    try:
        first = fit_labelled(small, columns, label)
        chosen = most_uncertain(with_probability(first, start.pool), query_size, key=key)
        chosen = chosen.select(key, SCORE)
        # Written, so that both sides of the move see the same rows.
        queried = save_dataset(chosen, scratch_path(spark, "queried"))
        labels = start.pool.select(key, label)
        labelled, pool = move_queried(small, start.pool, queried, labels, key, label)
        end = Pools(labelled, pool, start.test)
        larger = labelled.persist()
        try:
            second = fit_labelled(larger, columns, label)
            report = spark.createDataFrame(
                [
                    _report_line("before", first, start, label),
                    _report_line("after", second, end, label),
                ],
                REPORT_SCHEMA,
            )
        finally:
            larger.unpersist()
    finally:
        small.unpersist()
    return Round(start, end, queried, report)


def _report_line(stage: str, model: PipelineModel, pools: Pools, label: str) -> tuple:
    """Sizes and accuracy; the test rows are counted in the pass that scores them."""
    correct = F.avg((F.col(label) == F.col("prediction")).cast("int"))
    tested = model.transform(pools.test).agg(F.count(F.lit(1)), correct).first()
    return stage, pools.labelled.count(), pools.pool.count(), tested[0], tested[1]
