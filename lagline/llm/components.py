"""Connected components of a link table, by repeated joins of narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is its smallest id.

    Each round takes the smallest label among a vertex and its neighbours, then the
    label of that label, so long chains shorten by half per round. Rounds end when no
    label changes. Every round is written to the shared folder, so its lineage is one
    read; only a count reaches the driver.
    """
    edges = stored(
        links.select("a", "b")
        .unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(),
        "links",
    )
    first = edges.groupBy("a").agg(F.min("b").alias("m"))
    labels = stored(
        first.select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels"
    )
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        lowered = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("label")
        )
        jump = labels.select(F.col("id").alias("label"), F.col("component").alias("beyond"))
        moved = stored(
            lowered.join(jump, "label", "left").select(
                "id", "old", F.least("label", F.coalesce("beyond", "label")).alias("component")
            ),
            "labels",
        )
        labels = moved.select("id", "component")
        if moved.filter(F.col("component") < F.col("old")).isEmpty():
            return labels
