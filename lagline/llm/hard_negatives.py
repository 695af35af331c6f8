"""Hard negatives by cover trees over norm-augmented candidates.

A vector's components become ``floor(256 * x)``; scores are integer inner products. For
every anchor the first ``k`` rows of its label by score are its positives. For each of
them, the negatives are the first ``k`` rows of other labels whose score lies between
``low`` and ``high`` hundredths of the positive's.

All rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their id, so equal
vectors or one frequent label make no shard larger. A shard's candidates get one more
component, ``sqrt(largest norm ** 2 - norm ** 2)``; in that space the largest inner
product is the smallest distance. Its cover tree has a radius per level: the members of
a node are covered by greedily chosen centres within the next radius, more than that
radius apart, until ``LEAF`` members are left (or most members would be centres of their
own, which means that the level tells them no longer apart). A node keeps the largest
distance ``r`` of a member from its centre ``c``; since a query's last component is 0,
this is taken in the others, and ``q * c - |q| * r <= q * x <= q * c + |q| * r`` for
every member ``x``.

Anchors come in blocks; each block meets each shard once. A descent takes the node with
the highest bound first, skips nodes whose bounds miss every open window (above it, or
below it or below the ``k``-th score found so far) and verifies the members of leaves
exactly. Each block and shard yields ``k`` rows per anchor or window at most, which are
merged by rank. Trees are built once and written.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part, nor do those with a scaled component of ``LIMIT`` or more, whose
scores could leave 64 bits; of rows that repeat an id one counts, the one with the
smallest label, then vector; vectors of unlike length are filled up with zeros; equal
scores go by the smaller id; an anchor without positives, or a window without rows,
yields nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagline.llm.common import bounded_batches, stored

SCALE = 256
K = 5
LOW, HIGH = 80, 100
SHARD_ROWS = 4_096
BLOCK_ROWS = 2_048
LEAF = 96
STEP = 1.3
LIMIT = 1 << 26
MAX_TASKS = 20_000

Batches = Iterator[pa.RecordBatch]


def scaled_rows(
    rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, label and the whole-number vector of the rows that take part."""
    usable = F.forall(
        vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(LIMIT / SCALE))
    )
    return (
        rows.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable)
        .select(
            F.col(id_col).cast("long").alias("vec_id"),
            label.cast("int").alias("label"),
            F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("vector"),
        )
        .filter(F.col("label").isNotNull())
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "vector")).alias("row"))
        .select("vec_id", "row.label", "row.vector")
    )


def packed(**arrays: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.savez(file, **arrays)
    return file.getvalue()


def unpacked(block: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(block)) as found:
        return dict(found)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    lengths = np.array([len(v) if v is not None else 0 for v in column.to_pylist()], dtype=np.int64)
    width = int(lengths.max(initial=0))
    flat = np.concatenate([np.zeros(0, np.int32), *[c.flatten().to_numpy() for c in column.chunks]])
    out = np.zeros((len(lengths), width), dtype=np.int32)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class CoverTree:
    """A cover tree in arrays; members of a node are consecutive rows, children consecutive nodes."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.ids, self.labels, self.vectors = arrays["ids"], arrays["labels"], arrays["vectors"]
        self.centres, self.radius = arrays["centres"], arrays["radius"]
        self.begins, self.ends = arrays["begins"], arrays["ends"]
        self.children, self.counts = arrays["children"], arrays["counts"]


def build(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a shard's tree."""
    order = np.argsort(ids, kind="stable")
    plain = vectors.astype(np.float64)
    norms = (plain * plain).sum(axis=1)
    augmented = np.column_stack([plain, np.sqrt(np.maximum(norms.max() - norms, 0.0))])

    def distances(rows: np.ndarray, centre: int) -> np.ndarray:
        apart = augmented[rows] - augmented[centre]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    def reach(rows: np.ndarray, centre: int) -> float:
        apart = plain[rows] - plain[centre]
        return float(np.sqrt(np.einsum("ij,ij->i", apart, apart).max()))

    def covered(rows: np.ndarray, centre: int, apart: np.ndarray, radius: float):
        """Groups within ``radius`` of centres that are further apart; None if hardly any form."""
        near = apart <= radius
        groups, rest = [(centre, rows[near])], rows[~near]
        while len(rest):
            if 4 * len(groups) > len(rows):
                return None
            near = distances(rest, int(rest[0])) <= radius
            groups.append((int(rest[0]), rest[near]))
            rest = rest[~near]
        return groups

    centres, begins, ends = [int(order[0])], [0], [len(order)]
    radius, children, counts = [reach(order, int(order[0]))], [], []
    widest = float(distances(order, centres[0]).max())
    node = 0
    while node < len(centres):
        begin, end = begins[node], ends[node]
        rows = order[begin:end]
        groups = None
        if len(rows) > LEAF:
            apart = distances(rows, centres[node])
            far = float(apart.max())
            if far > 0:
                # The largest level radius below the farthest member.
                level = np.floor(np.log(widest / far) / np.log(STEP)) + 1
                groups = covered(rows, centres[node], apart, widest / STEP**level)
        children.append(len(centres) if groups else 0)
        counts.append(len(groups) if groups else 0)
        for centre, members in groups or []:
            order[begin : begin + len(members)] = members
            centres.append(centre)
            begins.append(begin)
            ends.append(begin + len(members))
            radius.append(reach(members, centre))
            begin += len(members)
        node += 1
    return {
        "ids": ids[order], "labels": labels[order], "vectors": vectors[order],
        "centres": vectors[centres], "radius": np.array(radius),
        "begins": np.array(begins), "ends": np.array(ends),
        "children": np.array(children), "counts": np.array(counts),
    }


def products(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides as the number type whose inner products are exact, of equal width."""
    width = max(left.shape[1], right.shape[1])

    def filled(side: np.ndarray) -> np.ndarray:
        return np.pad(side, ((0, 0), (0, width - side.shape[1])))

    most = [float(np.abs(side.astype(np.float64)).max(initial=0)) for side in (left, right)]
    kind = np.float64 if most[0] * most[1] * max(1, width) < 2**53 else np.int64
    return filled(left).astype(kind), filled(right).astype(kind)


class Best:
    """The first ``k`` rows by score and id among those offered."""

    def __init__(self, k: int, least: float = float("-inf"), most: float = float("inf")):
        self.k, self.least, self.most = k, least, most
        self.found: list[tuple] = []

    @property
    def needed(self) -> float:
        """A score below this one can no longer enter."""
        return max(self.least, -self.found[-1][0]) if len(self.found) >= self.k else self.least

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = np.flatnonzero((scores >= self.needed) & (scores <= self.most))
        if len(rows):
            first = rows[np.lexsort((ids[rows], -scores[rows]))[: self.k]]
            mine = [(-int(scores[r]), int(ids[r])) for r in first]
            self.found = sorted(self.found + mine)[: self.k]


def descend(
    tree: CoverTree,
    upper: np.ndarray,
    lower: np.ndarray,
    members: Callable[[int, int], tuple[np.ndarray, np.ndarray]],
    windows: list[Best],
) -> int:
    """Best-first search of one anchor; returns the number of leaves verified.

    ``upper`` and ``lower`` bound the scores within each node, ``members`` gives the
    exact scores and ids of the admitted rows of a leaf.
    """
    top = max(w.most for w in windows)

    def is_open(node: int) -> bool:
        return any(upper[node] >= w.needed and lower[node] <= w.most for w in windows)

    heap = [(-min(upper[0], top), 0)]
    leaves = 0
    while heap:
        bound, node = heapq.heappop(heap)
        if -bound < min(w.needed for w in windows):
            break
        if not is_open(node):
            continue
        if tree.counts[node]:
            first = tree.children[node]
            for child in range(first, first + tree.counts[node]):
                if is_open(child):
                    heapq.heappush(heap, (-min(upper[child], top), child))
            continue
        leaves += 1
        scores, ids = members(tree.begins[node], tree.ends[node])
        for window in windows:
            window.offer(scores, ids)
    return leaves


def search(tree: CoverTree, block: dict[str, np.ndarray], k: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive, row, score, positive score): positives, or negatives once windows are given."""
    vectors, queries = products(tree.vectors, block["vectors"])
    centres, _ = products(tree.centres, block["vectors"])
    centres = np.pad(centres, ((0, 0), (0, queries.shape[1] - centres.shape[1]))).astype(queries.dtype)
    lengths = np.sqrt((block["vectors"].astype(np.float64) ** 2).sum(axis=1))
    starts = block.get("window_starts")
    for a, (anchor, label) in enumerate(zip(block["ids"].tolist(), block["labels"].tolist())):
        middle = (centres @ queries[a]).astype(np.float64)
        # Half a unit and a rounding allowance: scores are whole numbers.
        slack = lengths[a] * tree.radius * (1 + 1e-9) + 1e-9 * np.abs(middle) + 0.5

        def members(begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
            ids = tree.ids[begin:end]
            same = tree.labels[begin:end] == label
            admitted = same & (ids != anchor) if starts is None else ~same
            return vectors[begin:end][admitted] @ queries[a], ids[admitted]

        if starts is None:
            windows = {None: Best(k)}
        else:
            scores = block["positive_scores"][starts[a] : starts[a + 1]].tolist()
            windows = {s: Best(k, -(-low * s // 100), high * s // 100) for s in scores}
            windows = {s: w for s, w in windows.items() if w.least <= w.most}
        if not windows:
            continue
        descend(tree, middle + slack, middle - slack, members, list(windows.values()))
        if starts is None:
            yield from ((anchor, row, -score) for score, row in windows[None].found)
        else:
            positives = block["positives"][starts[a] : starts[a + 1]].tolist()
            for positive, score in zip(positives, scores):
                if score in windows:
                    yield from ((anchor, positive, row, -s, score) for s, row in windows[score].found)


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {
        "ids": table.column("vec_id").to_numpy(),
        "labels": table.column("label").to_numpy(),
        "vectors": matrix(table.column("vector")),
    }


def _block(number: int, arrays: dict[str, np.ndarray], name: str) -> pa.Table:
    return pa.table({name: pa.array([number], pa.int32()), f"{name}_data": pa.array([packed(**arrays)], pa.binary())})


def dealt(rows: DataFrame, name: str, parts: int) -> DataFrame:
    """Rows dealt to ``parts`` groups of about equal size by a hash of their id."""
    number = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    return rows.withColumn(name, number).repartition(min(parts, MAX_TASKS), name).groupBy(name)


def trees(rows: DataFrame, shards: int) -> DataFrame:
    """shard, shard_data: a cover tree per shard."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _block(key[0].as_py(), build(**_columns(table)), "shard")

    return dealt(rows, "shard", shards).applyInArrow(run, "shard int, shard_data binary")


def blocks(anchors: DataFrame, count: int, windows: bool) -> DataFrame:
    """block, block_data: anchors with their windows, if they have any yet."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        arrays = _columns(table)
        if windows:
            found = table.column("positives").to_pylist()
            arrays["window_starts"] = np.cumsum([0, *[len(p) for p in found]])
            arrays["positives"] = np.array([p["row_id"] for ps in found for p in ps], dtype=np.int64)
            arrays["positive_scores"] = np.array([p["score"] for ps in found for p in ps], dtype=np.int64)
        return _block(key[0].as_py(), arrays, "block")

    return dealt(anchors, "block", count).applyInArrow(run, "block int, block_data binary")


def searched(
    shards: DataFrame, shard_count: int, anchors: DataFrame, block_count: int, schema: str, windows: bool,
    k: int, low: int, high: int,
) -> DataFrame:
    """What each block of anchors finds in each shard; every pair of the two meets in a row."""
    tasks = min(shard_count * block_count, MAX_TASKS)

    def every(name: str, count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    left = shards.select("*", every("block", block_count)).repartition(tasks, "shard", "block")
    right = (
        blocks(anchors, block_count, windows)
        .select("*", every("shard", shard_count))
        .repartition(tasks, "shard", "block")
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for tree, block in zip(batch.column(0), batch.column(1)):
                found = list(search(CoverTree(unpacked(tree.as_py())), unpacked(block.as_py()), k, low, high))
                columns = list(zip(*found)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return left.join(right, ["shard", "block"]).select("shard_data", "block_data").mapInArrow(run, schema)


def first_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key by score, then id; ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    k: int = K,
    low: int = LOW,
    high: int = HIGH,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (vec_id, label, vector of whole numbers)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = stored(rows.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))), "vectors")
    total, wanted = rows.agg(
        F.count("vec_id"), F.sum(F.col("is_anchor").cast("long"))
    ).first()
    shard_count = max(1, -(-total // shard_rows))
    block_count = max(1, -(-(wanted or 0) // block_rows))
    candidates = rows.drop("is_anchor")
    anchors = candidates.filter("false") if not wanted else rows.filter("is_anchor").drop("is_anchor")
    forest = stored(trees(candidates, shard_count), "cover-trees")
    options = (k, low, high)
    positives = first_rows(
        searched(
            forest, shard_count, anchors, block_count, "vec_id bigint, row_id bigint, score bigint", False, *options
        ),
        ["vec_id"], k,
    )
    # k positives per anchor at most.
    windowed = anchors.join(
        positives.groupBy("vec_id").agg(F.collect_list(F.struct("row_id", "score")).alias("positives")), "vec_id"
    )
    windowed = stored(windowed, "anchor-windows")
    negatives = searched(
        forest, shard_count, windowed, block_count,
        "vec_id bigint, positive_id bigint, row_id bigint, score bigint, positive_score bigint", True, *options,
    )
    return first_rows(negatives, ["vec_id", "positive_id"], k).select(
        F.col("vec_id").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("row_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
