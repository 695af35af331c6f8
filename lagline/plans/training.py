"""Training job: CSV tables to silver table, chosen model and its metrics.

    spark-submit -m lagline.plans.training --orders ... --items ... --customers ... \\
        --silver ... --store ...
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lagline.operators.candidates import CANDIDATE_PARAMS, DEFAULT_CANDIDATES
from lagline.operators.orders import model_input, order_features
from lagline.operators.sampling import split_data
from lagline.operators.selection import cross_validate_models, evaluate_model, train_model
from lagline.session import get_session
from lagline.sources.files import load_data, save_dataset


def run(
    spark: SparkSession,
    orders_path: str,
    items_path: str,
    customers_path: str,
    silver_path: str,
    store: str,
    candidates: tuple[str, ...] = DEFAULT_CANDIDATES,
    train_size: float = 0.8,
    seed: int = 42,
    max_iter: int | None = None,
) -> dict:
    """Build silver, pick a candidate out of fold, fit it, evaluate on the test part.

    Everything after the write reads the silver table, so the joins run once and
    the split is a filter on a Parquet scan. Model selection caches what it reads
    repeatedly and lets it go before the final fit.
    The test part plays no role in choosing model or threshold.
    """
    orders, items, customers = load_data(orders_path, items_path, customers_path, spark)
    silver = save_dataset(order_features(orders, items, customers), silver_path)
    train, test = split_data(model_input(silver), train_size, seed)
    name, threshold = cross_validate_models(train, candidates, seed=seed, max_iter=max_iter)
    model = train_model(name, train, threshold, store, max_iter)
    return evaluate_model(model, name, test, threshold)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Train the late-delivery model.")
    for name in ("orders", "items", "customers"):
        parser.add_argument(f"--{name}", required=True, help=f"{name} CSV with header")
    parser.add_argument("--silver", required=True, help="Parquet table to write")
    parser.add_argument("--store", required=True, help="model store to write")
    parser.add_argument(
        "--candidates", nargs="+", default=list(DEFAULT_CANDIDATES), choices=sorted(CANDIDATE_PARAMS)
    )
    parser.add_argument("--train-size", type=float, default=0.8)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--max-iter", type=int)
    args = parser.parse_args(argv)
    result = run(
        get_session("late-delivery-training"),
        args.orders,
        args.items,
        args.customers,
        args.silver,
        args.store,
        tuple(args.candidates),
        args.train_size,
        args.seed,
        args.max_iter,
    )
    print(json.dumps(result))


if __name__ == "__main__":
    main()
