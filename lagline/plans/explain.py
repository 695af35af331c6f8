"""Attribution job: contributions per order and importance per feature.

    spark-submit -m lagline.plans.explain --silver ... --store ... --output ...
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lagline.operators.attribution import (
    beeswarm,
    by_source,
    importance,
    long_contributions,
    read_trees,
    shap_arrays,
    shap_input,
    top_with_other,
)
from lagline.operators.encoding import vector_names
from lagline.operators.scoring import numeric_as_double
from lagline.session import get_session
from lagline.sources.files import read_table, save_dataset
from lagline.sources.models import load_model, model_path



def run(
    spark: SparkSession,
    silver_path: str,
    store: str,
    output: str,
    sample_size: int | None = None,
    top: int = 10,
) -> dict[str, DataFrame]:
    """Write contributions, importance, the bar table and the beeswarm table.

    The contributions, one row with arrays per order, are written first and read
    back, so the trees are walked once however many summaries follow. Importance is
    by source column; the beeswarm shows single slots and unfolds only the top ones.
    """
    data = numeric_as_double(read_table(spark, silver_path))
    vectors = shap_input(load_model(store), data, sample_size)
    names = vector_names(vectors)
    arrays = shap_arrays(vectors, read_trees(spark, model_path(store)))
    stored = save_dataset(arrays, f"{output}/contributions")
    ranking = save_dataset(importance(by_source(stored, names)), f"{output}/importance")
    slots = long_contributions(stored, names)
    return {
        "contributions": stored,
        "importance": ranking,
        "bar": save_dataset(top_with_other(ranking, top - 1), f"{output}/bar"),
        "beeswarm": save_dataset(beeswarm(slots, importance(slots), top), f"{output}/beeswarm"),
    }


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Explain the stored model.")
    parser.add_argument("--silver", required=True, help="Parquet table to explain")
    parser.add_argument("--store", required=True, help="model store to read")
    parser.add_argument("--output", required=True, help="folder for the result tables")
    parser.add_argument("--sample-size", type=int, help="explain so many rows instead of all")
    args = parser.parse_args(argv)
    tables = run(
        get_session("late-delivery-attribution"),
        args.silver,
        args.store,
        args.output,
        args.sample_size,
    )
    tables["bar"].orderBy("position").show(truncate=False)


if __name__ == "__main__":
    main()
