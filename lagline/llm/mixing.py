"""Mixing sources to target weights by hierarchical budgeting.

Sources are the leaves of a tree domain - language - source. A total of tokens is
passed down: children of a node share its budget by weight. No child can take more
than its supply allows (its tokens times ``max_epochs``); what it cannot take goes to
its siblings, by weight, and only what no child of a node can take counts against the
node itself and so goes to the node's own siblings. Capacities are summed up the tree
first, so one pass down settles it: per node, children are ordered by capacity over
weight and a running sum finds the water level.

A leaf's budget is filled from seeded epochs: whole passes over the leaf, then the
prefix of one more pass, in a new random order, whose tokens fit. That prefix is given
by a cut point in the order, found from token sums of buckets of the order and the rows
of the one bucket where the budget ends. Rows with texts are only compared with the cut
of their leaf; they are not shuffled unless there are very many leaves, and no leaf is
gathered in one task.

Defined results: null level values form a node of their own; null texts have no tokens
and follow their place in the order; rows equal in id are in or out together; nodes
without a weight have weight 1, a weight of 0 or less gives nothing; an empty table
gives an empty result; all columns are carried and ``copy`` (from 0) is added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagline.llm.common import stored, words_of
from lagline.llm.sharding import RANDOM_RANGE, seeded_number

SEED = 42
MAX_EPOCHS = 4
BUCKETS = 4_096
BROADCAST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")


def n_words(text_col: str = "text") -> Column:
    """Default token measure: words between white space."""
    return F.size(words_of(F.col(f"`{text_col}`"))).cast("long")


def _key(column: Column | str) -> Column:
    value = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budget of each child from (parent keys, name, weight, capacity, parent_budget).

    Children are ordered by capacity over weight. A child is full when an equal rate
    for it and all after it, once those before are full, would exceed its capacity.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(name)]
    siblings = Window.partitionBy(*parent)
    before = siblings.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = siblings.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    ranked = children.filter("weight > 0").select(
        "*",
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).alias("__taken"),
        F.sum("weight").over(onward).alias("__weights"),
    )
    full = F.col("capacity") * F.col("__weights") <= F.col("weight") * (
        F.col("parent_budget") - F.col("__taken")
    )
    flagged = ranked.withColumn("__full", full)
    open_weight = F.sum(F.when(~F.col("__full"), F.col("weight"))).over(siblings)
    spent = F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(siblings), F.lit(0))
    rate = (F.col("parent_budget") - spent) / open_weight
    return flagged.withColumn(
        "budget",
        # Thousandths of a token, so that sums taken in another order agree.
        F.round(
            F.when(F.col("__full"), F.col("capacity").cast("double")).otherwise(
                F.col("weight") * rate
            ),
            3,
        ),
    ).drop("__taken", "__weights", "__full")


def leaf_budgets(
    supply: DataFrame,
    levels: Sequence[str],
    weights: Mapping[tuple[str, ...], float],
    total: float,
    max_epochs: int,
) -> DataFrame:
    """Budgets of all leaves from (levels, supply)."""
    spark = supply.sparkSession
    # A parent whose weighted children are all exhausted passes its own shortage on,
    # so leaves without weight must not count as capacity above them.
    listed = spark.createDataFrame(
        [("\x01".join(f"={p}" for p in path), float(w)) for path, w in weights.items()],
        "path string, own_weight double",
    )
    tree = supply.withColumn("capacity", F.col("supply") * max_epochs)
    for depth in range(1, len(levels) + 1):
        path = F.concat_ws("\x01", *levels[:depth])
        tree = (
            tree.withColumn("path", path)
            .join(listed, "path", "left")
            .withColumn(f"weight_{depth}", F.coalesce("own_weight", F.lit(1.0)))
            .drop("path", "own_weight")
        )
    usable = F.lit(True)
    for depth in range(1, len(levels) + 1):
        usable = usable & (F.col(f"weight_{depth}") > 0)
    tree = tree.filter(usable)
    everything = tree.agg(F.sum("capacity").alias("c")).select(
        F.least(F.coalesce("c", F.lit(0)).cast("double"), F.lit(float(total))).alias("parent_budget")
    )
    level = None
    for depth, name in enumerate(levels, 1):
        keys = list(levels[:depth])
        nodes = tree.groupBy(*keys).agg(
            F.sum("capacity").alias("capacity"), F.first(f"weight_{depth}").alias("weight")
        )
        if level is None:
            # One row on the right: the total of the whole tree.
            nodes = nodes.withColumn("__one", F.lit(1)).join(
                everything.withColumn("__one", F.lit(1)), "__one"
            ).drop("__one")
            level = share_out(nodes.withColumn("__root", F.lit(0)), ["__root"], name).drop("__root")
        else:
            parents = level.select(*keys[:-1], F.col("budget").alias("parent_budget"))
            level = share_out(nodes.join(parents, keys[:-1]), keys[:-1], name)
    return level.join(supply, list(levels)).select(*levels, "supply", "budget")


def leaf_cuts(rows: DataFrame, budgets: DataFrame, levels: Sequence[str], seed: int) -> DataFrame:
    """Per leaf: whole epochs and the cut point of the next one.

    ``rows`` has (levels, id, tokens). A row is inside when its (random number, id) is
    not above (cut_random, cut_id).
    """
    leaf = list(levels)
    usable = budgets.withColumn(
        "epochs", F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0)
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    random = seeded_number(F.concat_ws(":", F.col("epochs"), F.col("id")), seed)
    placed = (
        rows.join(usable.select(*leaf, "epochs", "rest"), leaf)
        .withColumn("random", random)
        .withColumn("bucket", F.floor(F.col("random") * F.lit(BUCKETS) / F.lit(float(RANDOM_RANGE))))
    )
    sums = placed.groupBy(*leaf, "bucket").agg(
        F.sum("tokens").alias("tokens"), F.first("rest").alias("rest")
    )
    so_far = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("after", F.sum("tokens").over(so_far)).withColumn(
        "before", F.col("after") - F.col("tokens")
    )
    # The first bucket whose end lies beyond the budget; none if all of them fit.
    edge = (
        running.filter(F.col("after") > F.col("rest"))
        .groupBy(*leaf)
        .agg(F.min(F.struct("bucket", "before")).alias("e"))
        .select(*leaf, F.col("e.bucket").alias("bucket"), F.col("e.before").alias("before"))
    )
    inside = Window.partitionBy(*leaf, "bucket").orderBy("random", F.col("id").asc_nulls_first())
    last = (
        placed.join(edge, [*leaf, "bucket"])
        .withColumn(
            "sum",
            F.col("before")
            + F.sum("tokens").over(inside.rangeBetween(Window.unboundedPreceding, 0)),
        )
        .filter(F.col("sum") <= F.col("rest"))
        .groupBy(*leaf)
        .agg(F.max(F.struct("random", "id")).alias("c"))
    )
    low = F.ceil(F.col("bucket") * F.lit(float(RANDOM_RANGE)) / F.lit(BUCKETS)) - 1
    return (
        usable.join(edge, leaf, "left")
        .join(last, leaf, "left")
        .select(
            *leaf,
            "epochs",
            # Without a row inside the edge bucket the cut lies before that bucket.
            F.when(F.col("bucket").isNull(), F.lit(RANDOM_RANGE))
            .otherwise(F.coalesce("c.random", low))
            .cast("long")
            .alias("cut_random"),
            F.col("c.id").alias("cut_id"),
            F.col("c").isNotNull().alias("cut_inside"),
        )
    )


def mix(
    docs: DataFrame,
    weights: Mapping[tuple[str, ...], float],
    levels: Mapping[str, Column] | Sequence[str] = LEVELS,
    total_tokens: float | None = None,
    max_epochs: int = MAX_EPOCHS,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Rows of ``docs``, repeated and left out so that token sums follow the weights.

    ``levels`` names the tree's levels from the top, as columns or expressions.
    ``weights`` gives weights by path, such as ``("web",)`` or ``("web", "en")``.
    ``total_tokens`` defaults to the tokens of the table.
    """
    named = dict(levels) if isinstance(levels, Mapping) else {n: F.col(f"`{n}`") for n in levels}
    names = [f"__level_{i}" for i in range(len(named))]
    keys = [_key(c).alias(n) for n, c in zip(names, named.values())]
    measure = n_words() if tokens is None else tokens
    narrow = stored(
        docs.select(*keys, F.col(f"`{id_col}`").alias("id"), measure.alias("tokens")), "mixing-rows"
    )
    supply = narrow.groupBy(*names).agg(F.sum("tokens").alias("supply"))
    if total_tokens is None:
        total_tokens = float(supply.agg(F.sum("supply")).first()[0] or 0)
    budgets = leaf_budgets(supply, names, weights, total_tokens, max_epochs)
    # Shared by the cuts' three uses: one row per leaf, small next to the documents.
    budgets = stored(budgets, "mixing-budgets")
    cuts = stored(leaf_cuts(narrow, budgets, names, seed), "mixing-cuts")
    if cuts.count() <= BROADCAST_LEAVES:
        cuts = F.broadcast(cuts)
    key = F.col(f"`{id_col}`")
    random = seeded_number(F.concat_ws(":", F.col("epochs"), key), seed)
    # Nulls sort first, as in the order of the cut.
    id_inside = F.when(
        F.col("cut_inside"), key.isNull() | F.coalesce(key <= F.col("cut_id"), F.lit(False))
    ).otherwise(F.lit(True))
    inside = (random < F.col("cut_random")) | ((random == F.col("cut_random")) & id_inside)
    copies = F.col("epochs") + inside.cast("int")
    return (
        docs.select(*[F.col(f"`{c}`") for c in docs.columns], *keys)
        .join(cuts, names)
        .withColumn("__copies", copies)
        .filter(F.col("__copies") > 0)
        .select(
            *[F.col(f"`{c}`") for c in docs.columns if c != "copy"],
            F.explode(F.sequence(F.lit(0), F.col("__copies").cast("int") - 1)).alias("copy"),
        )
    )
