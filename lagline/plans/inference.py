"""Scoring job: silver table to gold table with the stored model and threshold.

    spark-submit -m lagline.plans.inference --silver ... --store ... --gold ...
"""

from __future__ import annotations

import argparse

from lagline.operators.scoring import score_orders
from lagline.schemas import ORDER_KEY, SCORE
from lagline.session import get_session
from lagline.sources.files import preview


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Score orders in bulk.")
    parser.add_argument("--silver", required=True, help="Parquet table to score")
    parser.add_argument("--store", required=True, help="model store to read")
    parser.add_argument("--gold", required=True, help="Parquet table to write")
    args = parser.parse_args(argv)
    spark = get_session("late-delivery-scoring")
    gold = score_orders(spark, args.store, args.silver, args.gold)
    preview(gold, [ORDER_KEY, SCORE, "prediction"], ORDER_KEY).show(20, truncate=False)


if __name__ == "__main__":
    main()
