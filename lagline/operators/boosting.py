"""Gradient boosting on feature histograms, of the first and the second order.

Features are cut into bins once. A tree then needs, per depth, one pass over the rows
that sums gradient, hessian and count per (run, node, bin); the driver picks the
splits from these sums. A *run* is a parameter set with the fold it leaves out, and the
sums carry the run, so one pass serves all folds of all candidates: what grows with
their number is the work in a pass, not the number of passes.

* Leaf weight ``-G / (H + l2)``, gain ``GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)``.
* First order (``order=1``) is Spark's ``GBTClassifier``: trees of the smallest variance,
  whose gain is the one above with the count as ``H``. It fits the labels -1 and 1 by a tree
  of weight 1, then the residuals ``4 (label - p)``, and half the log-odds are the sum of a
  leaf's means times the tree weights. Spark's own trainer reads every slot of the one-hot
  vectors as a column, for each fold apart; here they are few columns in the common passes.
* Of two siblings the one with fewer rows is counted, the other is the difference.
* Growth by depth splits every node that gains. Growth by leaf (``max_leaves``) splits
  the leaf with the largest gain first, from a priority queue on the driver. Passes are
  shared there too: a pass counts every leaf that could still be among the splits to
  come, and what the queue does not reach is cut off again.
* Rows and columns are drawn per tree by hash, so a task that runs again draws the same.
* Gradients are rounded to whole multiples of ``2 ** -24``. Whole numbers add up to the
  same sum in any order, so a model depends neither on partitions nor on the runs
  it was grown with.

The rows stay where they are, packed into numpy blocks with one partition per core or
more; a pass returns one array of bounded size (runs x nodes x bins), added up by tasks
before it reaches the driver. Passes depend on each other and there are a thousand of them in a full
training, which is why they run on an RDD of blocks: planning each as a query takes
longer than the pass. The blocks are checkpointed every ``CHECKPOINT_EVERY`` trees.

The result is Spark's own ``GBTClassificationModel``, so storing, scoring and attribution
are the same as for Spark's boosted trees. Its margin is half the log-odds.

Defined results: missing numbers are filled by the encoder with the mean; unseen
categories have a slot of their own; with no rows, or rows of one class only, the
model is the constant that its labels allow.
"""

from __future__ import annotations

import heapq
import json
import math
import pickle
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagline.operators.encoding import IMPUTED
from lagline.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES, ORDER_KEY, TARGET
from lagline.session import scratch_path

MAX_BINS = 64
UNIT_BITS = 24
UNIT = float(1 << UNIT_BITS)
MIN_GAIN = 1e-6
ROWS_PER_TASK = 8_192
MOST_ROWS_PER_TASK = 2_000_000
# Rows of a block: each adds a table of all cells to a pass, however few of its rows are counted.
BLOCK_ROWS = 120_000
# Rows counted at once. Fewer than 2 ** 15, so that their hessians add up to less than
# 2 ** 37 units and a count can stand above them in one exact double.
COUNTED_ROWS = 30_000
COUNT_UNIT = float(1 << 37)
# Cells of columns that are counted together: small enough for a core's cache at each node.
JOINT_CELLS = 1_024
# Partial sums that one task adds up at most, on their way to the driver.
TREE_REDUCE_FROM = 33
CHECKPOINT_EVERY = 25
# The log-odds of a class that every row belongs to.
SURE = 16.0
# Odd multipliers of a 64-bit mixing step.
MIX_1 = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class BoostingParams:
    """Settings of one candidate. ``max_leaves`` switches to growth by leaf.

    ``bins`` is the most bins of a number that splits are taken from, as far as fewer than
    ``MAX_BINS``.
    """

    iterations: int
    rate: float
    max_depth: int
    max_leaves: int | None = None
    row_share: float = 1.0
    column_share: float = 1.0
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    seed: int = 42
    order: int = 2
    bins: int = MAX_BINS

    def weight(self, tree: int) -> float:
        """What a stored tree counts; the rate is in the leaf values of second-order trees."""
        return self.rate if self.order == 1 and tree else 1.0

    def leaf_value(self, node: Node, tree: int) -> float:
        """Step of the log-odds."""
        if self.order == 1:
            # Half the log-odds move by the mean of the labels, -2 (p - label) at p = 1/2, and
            # later of the residuals, -4 (p - label).
            step = 8.0 * self.rate if tree else 4.0
            return -(node.grad / UNIT) / node.rows * step if node.rows else 0.0
        hess = node.hess / UNIT + self.l2
        return -(node.grad / UNIT) / hess * self.rate if hess > 0 else 0.0


@dataclass(frozen=True)
class Run:
    """A parameter set and the fold it must not see (None: it sees all rows)."""

    params: BoostingParams
    fold: int | None = None


@dataclass(frozen=True)
class Layout:
    """Columns, their bins, and the splits that bins allow, in the order of vector slots.

    A numeric column with cuts ``c`` puts ``x`` into the bin of the first cut that is not
    below it. A category is a bin of its own; its split sends that category to the right.
    """

    columns: tuple[str, ...]
    cuts: tuple[tuple[float, ...] | None, ...]
    bins: tuple[int, ...]
    first_slots: tuple[int, ...]

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.bins)])

    @property
    def slots(self) -> int:
        return sum(1 if cut is not None else size for cut, size in zip(self.cuts, self.bins))

    def candidates(self) -> dict[str, np.ndarray]:
        """Per possible split: column, bin, slot, threshold, whether it is by category."""
        rows = []
        for column, (cut, size, slot) in enumerate(zip(self.cuts, self.bins, self.first_slots)):
            if cut is not None:
                rows += [(column, b, slot, value, False) for b, value in enumerate(cut)]
            else:
                rows += [(column, b, slot + b, 0.5, True) for b in range(size)]
        names = ("column", "bin", "slot", "threshold", "by_category")
        kinds = (np.int64, np.int64, np.int64, np.float64, bool)
        parts = list(zip(*rows)) or [()] * 5
        return {n: np.array(p, dtype=k) for n, p, k in zip(names, parts, kinds)}

    def of_bins(self, most: int) -> np.ndarray:
        """Per possible split, whether it is there with at most so many bins of a number.

        Cuts are quantiles, so those that stay are taken at even steps.
        """
        chosen = []
        for cut, size in zip(self.cuts, self.bins):
            if cut is None:
                chosen.append(np.ones(size, bool))
            else:
                kept = np.ones(len(cut), bool)
                if len(cut) > most - 1:
                    kept[:] = False
                    kept[[(i + 1) * (len(cut) + 1) // most - 1 for i in range(most - 1)]] = True
                chosen.append(kept)
        return np.concatenate(chosen)


@dataclass
class Node:
    """A node under construction: its sums, and its best split once it was counted."""

    depth: int
    grad: int
    hess: int
    rows: int
    gain: float = -math.inf
    split: int | None = None
    left_sums: tuple[int, int, int] | None = None
    children: tuple[int, int] | None = None
    histogram: np.ndarray | None = None


@dataclass
class Tree:
    """Nodes in order of creation, parents before children; leaf values include the rate."""

    nodes: list[Node]
    values: list[float] = field(default_factory=list)


def layout_of(
    encoded: DataFrame, indexer_sizes: list[int], cuts: dict[str, list[float]] | None = None
) -> Layout:
    """Bins of the encoded columns; cut points are values of the data, by one quantile pass."""
    names = [f"{name}{IMPUTED}" for name in NUMERIC_FEATURES]
    if cuts is None:
        steps = [i / MAX_BINS for i in range(MAX_BINS)]
        found = encoded.approxQuantile(names, steps, 1.0 / (4 * MAX_BINS))
        cuts = {name: values for name, values in zip(NUMERIC_FEATURES, found)}
    numeric = [tuple(sorted(set(cuts[name]))) for name in NUMERIC_FEATURES]
    # One more bin for what is not among the fitted categories.
    sizes = [n + 1 for n in indexer_sizes]
    firsts = len(NUMERIC_FEATURES) + np.concatenate([[0], np.cumsum(sizes)])
    return Layout(
        columns=(*names, *[f"{name}_index" for name in CATEGORICAL_FEATURES]),
        cuts=(*numeric, *[None] * len(sizes)),
        bins=(*[len(c) + 1 for c in numeric], *sizes),
        first_slots=(*range(len(numeric)), *map(int, firsts[:-1])),
    )


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX_2
    values = (values ^ (values >> np.uint64(29))) * MIX_1
    return values ^ (values >> np.uint64(32))


def _drawn(hashes: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Which rows a tree sees."""
    salt = (seed * 1_000_003 + tree + 1) * int(MIX_1) % (1 << 64)
    return _mixed(hashes ^ np.uint64(salt)) < np.uint64(min(share, 1.0) * (2.0**64 - 2048))


def drawn_slots(slots: int, share: float, seed: int, tree: int) -> np.ndarray:
    """Which vector slots a tree may split on."""
    keep = max(1, int(share * slots))
    salt = np.uint64((seed * 1_000_003 + tree + 1) * int(MIX_2) % (1 << 64))
    order = np.argsort(_mixed(np.arange(1, slots + 1, dtype=np.uint64) * MIX_1 ^ salt), kind="stable")
    chosen = np.zeros(slots, dtype=bool)
    chosen[order[:keep]] = True
    return chosen


def _regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, the last one shorter."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= rows:
            joined = pa.concat_batches(waiting)
            whole = size - size % rows
            for start in range(0, whole, rows):
                yield joined.slice(start, rows)
            waiting, size = [joined.slice(whole)], size - whole
    if size:
        yield pa.concat_batches(waiting)


def packed_blocks(
    encoded: DataFrame, layout: Layout, label: str, key: str | None, fold: str | None
) -> RDD:
    """Rows as blocks of arrays: bins, label, fold, hash of the key, and the keys themselves."""
    rows = encoded.count()
    cores = encoded.sparkSession.sparkContext.defaultParallelism
    parts = max(min(-(-rows // ROWS_PER_TASK), cores), -(-rows // MOST_ROWS_PER_TASK), 1)
    names = list(layout.columns)
    chosen = encoded.select(
        F.col(label).cast("double").alias("label"),
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
        F.xxhash64(*([key] if key else names)).alias("hash"),
        *[F.col(name).cast("double") for name in names],
        *([F.col(key).alias("key")] if key else []),
    )
    cuts = [None if cut is None else np.array(cut) for cut in layout.cuts]
    most = np.array(layout.bins) - 1
    narrow = np.uint8 if max(layout.bins) <= 256 else np.int16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _regrouped(batches, BLOCK_ROWS):
            bins = np.empty((len(names), batch.num_rows), dtype=narrow)
            for i, cut in enumerate(cuts):
                values = batch.column(3 + i).to_numpy(zero_copy_only=False)
                bins[i] = (
                    np.searchsorted(cut, values, side="left") if cut is not None
                    else np.minimum(np.nan_to_num(values, nan=most[i]), most[i])
                )
            block = {
                "bins": bins,
                "label": batch.column(0).to_numpy(zero_copy_only=False).astype(np.float32),
                "fold": batch.column(1).to_numpy().copy(),
                "hash": batch.column(2).to_numpy().view(np.uint64).copy(),
                # As Arrow bytes: every pass reads the block, none of them the keys.
                "key": batch.column(batch.num_columns - 1) if key else None,
            }
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    packed = chosen.coalesce(parts) if parts < cores else chosen.repartition(parts)
    return packed.mapInArrow(pack, "block binary").rdd.map(lambda row: pickle.loads(row["block"]))


def _summed(blocks: RDD, part, finish=None) -> RDD:
    """Sum of the arrays that ``part`` makes of each block, as one row of a fixed size.

    The partial sums of the partitions meet in tasks, so the driver receives one array per
    pass, however many partitions there are. ``finish`` turns the sums of a partition into
    what travels.
    """

    def added(found: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
        total = next(found, None)
        for own in found:
            for sums, more in zip(total, own):
                sums += more
        if total is not None:
            yield total

    def run(found: Iterator[dict]) -> Iterator[list[np.ndarray]]:
        return map(finish or list, added(map(part, found)))

    sums = blocks.mapPartitions(run)
    while sums.getNumPartitions() > 1:
        groups = -(-sums.getNumPartitions() // TREE_REDUCE_FROM)
        # Dealt by the shuffle as they are; pairing them with keys in Python takes longer.
        sums = sums.coalesce(groups, shuffle=True).mapPartitions(added)
    return sums


def _added(blocks: RDD, part, finish=None) -> list[np.ndarray] | None:
    """That row on the driver; nothing if there are no blocks."""
    found = _summed(blocks, part, finish).collect()
    return found[0] if found else None


def _in_training(block: dict, run: Run) -> np.ndarray:
    return block["fold"] != run.fold if run.fold is not None else np.ones(len(block["fold"]), bool)


def _slopes(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the logistic loss in whole units, as doubles."""
    p = np.exp(-margins)
    p += 1.0
    np.divide(1.0, p, out=p)
    grad, hess = p - label, 1.0 - p
    hess *= p
    for slope in (grad, hess):
        slope *= UNIT
        np.rint(slope, out=slope)
    return grad, hess


def _started(block: dict, bases: list[float]) -> dict:
    """Slopes follow from margins and label; a pass takes them for the rows that it counts."""
    return block | {"margins": np.repeat(np.array(bases)[:, None], len(block["label"]), axis=1)}


@dataclass(frozen=True)
class _Walk:
    """A tree as arrays, to find the node of every row; ``column`` is -1 at its leaves."""

    column: np.ndarray
    bin: np.ndarray
    by_category: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def nodes_at(self, bins: np.ndarray, wanted: set[int] | None = None) -> np.ndarray:
        """The node of every row: its leaf, or where its way towards the wanted nodes ends.

        Every split is a comparison of a whole column. Parents stand before their children,
        and only splits with a wanted node below are made.
        """
        towards = None if wanted is None else self._towards(wanted) - wanted
        kind = np.min_scalar_type(len(self.column))
        at = np.zeros(bins.shape[1], kind)
        here, right, step = np.empty(len(at), bool), np.empty(len(at), bool), np.empty_like(at)
        # The bytes of a flag are its number, which spares a conversion where nodes are bytes too.
        turns, held = (right.view(kind), here.view(kind)) if kind == np.uint8 else (right, here)
        for node, column in enumerate(self.column):
            if column < 0 or (towards is not None and node not in towards):
                continue
            compare = np.equal if self.by_category[node] else np.greater
            compare(bins[column], int(self.bin[node]), out=right)
            np.equal(at, node, out=here)
            # Siblings are neighbours, the left one first.
            np.add(turns, kind.type(self.left[node] - node), out=step)
            np.multiply(step, held, out=step)
            np.add(at, step, out=at)
        return at

    def rows_at(
        self, bins: np.ndarray, rows: np.ndarray, wanted: set[int] | None = None
    ) -> Iterator[tuple[int, np.ndarray]]:
        """Which of the rows are at each of the wanted nodes (None: at each leaf)."""
        at = self.nodes_at(bins, wanted).take(rows)
        if wanted is None:
            nodes = np.flatnonzero(self.column < 0).tolist()
        else:
            nodes = sorted(wanted)
            some = np.zeros(len(self.column), bool)
            some[nodes] = True
            chosen = np.flatnonzero(some.take(at))
            rows, at = rows.take(chosen), at.take(chosen)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(self.column)))
        for node in nodes:
            yield node, rows.take(order[ends[node - 1] if node else 0 : ends[node]])

    def _towards(self, wanted: set[int]) -> set[int]:
        """The wanted nodes and all nodes above them; parents stand before their children."""
        found = set(wanted)
        for node in range(len(self.column) - 1, -1, -1):
            if self.column[node] >= 0 and (int(self.left[node]) in found or int(self.right[node]) in found):
                found.add(node)
        return found


def _walk(nodes: list[Node], candidates: dict[str, np.ndarray]) -> _Walk:
    inner = [n.split if n.children else None for n in nodes]

    def of(name: str, missing) -> np.ndarray:
        return np.array([missing if s is None else candidates[name][s] for s in inner])

    children = [n.children or (0, 0) for n in nodes]
    return _Walk(
        of("column", -1), of("bin", 0), of("by_category", False),
        np.array([c[0] for c in children]), np.array([c[1] for c in children]),
    )


def joint_columns(bins: tuple[int, ...]) -> list[list[int]]:
    """Columns that are counted together, as one column whose cells are their combinations.

    A column goes to the first group that stays within ``JOINT_CELLS``; the sums of each
    column follow from those of its group.
    """
    groups: list[list[int]] = []
    for column in sorted(range(len(bins)), key=lambda i: -bins[i]):
        for group in groups:
            if bins[column] * math.prod(bins[i] for i in group) <= JOINT_CELLS:
                group.append(column)
                break
        else:
            groups.append([column])
    return groups


def _joint_codes(bins: np.ndarray, sizes: list[int], group: list[int]) -> np.ndarray:
    """The cell of every row in a group of columns, the last column running fastest."""
    if len(group) == 1:
        return bins[group[0]]
    codes = bins[group[0]].astype(np.uint16)
    for column in group[1:]:
        codes *= np.uint16(sizes[column])
        codes += bins[column]
    return codes


def histograms(
    blocks: RDD, layout: Layout, runs: list[Run], tree: int, walks: list[_Walk], wanted: list[list[int]]
) -> list[np.ndarray]:
    """Per run: gradient, hessian and count per (wanted node, bin), in whole numbers."""
    offsets, width, sizes = layout.offsets, int(layout.offsets[-1]), list(layout.bins)
    groups = joint_columns(layout.bins)
    cells_of = [math.prod(sizes[i] for i in group) for group in groups]
    ends = np.cumsum(cells_of).tolist()

    def part(block: dict) -> list[np.ndarray]:
        out, draws, drawn, at_root = [], {}, {}, {}
        codes = [_joint_codes(block["bins"], sizes, group) for group in groups]
        for k, (run, walk, nodes) in enumerate(zip(runs, walks, wanted)):
            total = np.zeros((3, len(nodes), ends[-1]), dtype=np.int64)
            out.append(total)
            if not nodes:
                continue
            draw = (run.params.row_share, run.params.seed) if run.params.row_share < 1.0 else None
            seen = (run.fold, draw)
            if seen not in drawn:
                chosen = _in_training(block, run)
                if draw:
                    if draw not in draws:
                        draws[draw] = _drawn(block["hash"], *draw, tree)
                    chosen = chosen & draws[draw]
                drawn[seen] = np.flatnonzero(chosen)
            if walk.column[0] < 0:
                # Runs that see the same rows have the same cells while there is only the root.
                rows = drawn[seen]
                if seen not in at_root:
                    at_root[seen] = [code.take(rows).astype(np.intp) for code in codes]
                cells = at_root[seen]
            else:
                found = list(walk.rows_at(block["bins"], drawn[seen], set(nodes)))
                places = {node: place for place, node in enumerate(nodes)}
                rows = np.concatenate([own for _, own in found])
                place = np.repeat([places[node] for node, _ in found], [len(own) for _, own in found])
                cells = (code.take(rows) + place * size for code, size in zip(codes, cells_of))
            # Sums stay below 2 ** 53, so they are exact in doubles.
            grad, hess = _slopes(block["margins"][k].take(rows), block["label"].take(rows))
            hess += COUNT_UNIT
            for own, size, end in zip(cells, cells_of, ends):
                width_of = len(nodes) * size
                total[0, :, end - size : end] = np.bincount(own, grad, width_of).reshape(-1, size)
                if run.params.order == 1:
                    counts = np.bincount(own, minlength=width_of).reshape(-1, size)
                    total[1, :, end - size : end] = counts << UNIT_BITS
                    total[2, :, end - size : end] = counts
                    continue
                for first in range(0, len(rows), COUNTED_ROWS):
                    some = slice(first, first + COUNTED_ROWS)
                    sums = np.bincount(own[some], hess[some], width_of).astype(np.int64).reshape(-1, size)
                    total[1, :, end - size : end] += sums
                    sums >>= 37
                    total[2, :, end - size : end] += sums
            if run.params.order != 1:
                total[1] -= total[2] << 37
        return out

    def by_column(totals: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for total in totals:
            sums = np.empty((3, total.shape[1], width), dtype=np.int64)
            for group, size, end in zip(groups, cells_of, ends):
                joint = total[:, :, end - size : end].reshape(3, -1, *[sizes[i] for i in group])
                for axis, column in enumerate(group):
                    others = tuple(2 + i for i in range(len(group)) if i != axis)
                    sums[:, :, offsets[column] : offsets[column + 1]] = joint.sum(axis=others)
            out.append(sums)
        return out

    found = _added(blocks, part, by_column)
    if found is None:
        return [np.zeros((3, len(nodes), width), dtype=np.int64) for nodes in wanted]
    return found


def find_split(
    node: Node, layout: Layout, candidates: dict[str, np.ndarray], allowed: np.ndarray, params: BoostingParams
) -> None:
    """The split with the largest gain among those allowed; of equal ones the first slot, then the first cut."""
    running = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(node.histogram, axis=1)], axis=1)
    begin = layout.offsets[candidates["column"]]
    at = begin + candidates["bin"]
    total = np.array([[node.grad], [node.hess], [node.rows]], dtype=np.int64)
    left = np.where(
        candidates["by_category"], total - node.histogram[:, at], running[:, at + 1] - running[:, begin]
    )
    right = total - left

    def part(sums: np.ndarray) -> np.ndarray:
        hess = sums[1] / UNIT + params.l2
        return np.divide((sums[0] / UNIT) ** 2, hess, out=np.zeros(len(hess)), where=hess > 0)

    gains = part(left) + part(right) - part(np.repeat(total, left.shape[1], axis=1))
    fits = allowed
    for side in (left, right):
        fits = fits & (side[1] >= params.min_hessian * UNIT) & (side[2] >= max(1, params.min_rows))
    gains = np.where(fits, gains, -math.inf)
    best = int(np.argmax(gains)) if len(gains) else 0
    if len(gains) and gains[best] > MIN_GAIN:
        node.gain, node.split = float(gains[best]), best
        node.left_sums = tuple(int(x) for x in left[:, best])


def splits_to_come(nodes: list[Node], params: BoostingParams) -> list[int]:
    """Leaves that growth reaches next, as far as gains are known.

    By leaf: the queue takes the largest gain first, up to the number of splits that
    ``max_leaves`` allows. Children that were not counted yet can only push others out,
    so nothing is missed.
    """
    if params.max_leaves is None:
        return [i for i, n in enumerate(nodes) if n.split is not None and not n.children]
    queue, splits, ahead = [(-nodes[0].gain, 0)], 0, []
    while queue and splits < params.max_leaves - 1:
        _, number = heapq.heappop(queue)
        node = nodes[number]
        if node.split is None:
            continue
        splits += 1
        if node.children:
            for child in node.children:
                heapq.heappush(queue, (-nodes[child].gain, child))
        else:
            ahead.append(number)
    return ahead


def cut_back(nodes: list[Node], params: BoostingParams) -> list[Node]:
    """Only the splits that the queue takes within ``max_leaves``, renumbered."""
    if params.max_leaves is None:
        return nodes
    queue, kept = [(-nodes[0].gain, 0)], set()
    while queue and len(kept) < params.max_leaves - 1:
        _, number = heapq.heappop(queue)
        if nodes[number].children:
            kept.add(number)
            for child in nodes[number].children:
                heapq.heappush(queue, (-nodes[child].gain, child))
    order, at = [0], 0
    while at < len(order):
        if order[at] in kept:
            order += nodes[order[at]].children
        at += 1
    numbers = {old: new for new, old in enumerate(order)}
    for old in order:
        children = nodes[old].children
        nodes[old].children = tuple(numbers[c] for c in children) if old in kept else None
    return [nodes[old] for old in order]


def grow_trees(blocks: RDD, layout: Layout, runs: list[Run], tree: int) -> list[Tree]:
    """The next tree of every run, one pass per depth for all of them."""
    candidates = layout.candidates()
    allowed = [
        drawn_slots(layout.slots, r.params.column_share, r.params.seed, tree)[candidates["slot"]]
        & layout.of_bins(r.params.bins)
        for r in runs
    ]
    grown: list[list[Node]] = [[] for _ in runs]
    wanted: list[list[int]] = [[0] for _ in runs]
    pairs: list[list[tuple[int, int, int]]] = [[] for _ in runs]
    root = _Walk(*(np.array([x]) for x in (-1, 0, False, 0, 0)))
    while any(wanted):
        walks = [_walk(nodes, candidates) if nodes else root for nodes in grown]
        found = histograms(blocks, layout, runs, tree, walks, wanted)
        for k, run in enumerate(runs):
            nodes = grown[k]
            if not nodes and wanted[k]:
                # Every column counts every row once.
                sums = found[k][:, 0, : layout.bins[0]].sum(axis=1)
                nodes.append(Node(0, *map(int, sums)))
            for number, histogram in zip(wanted[k], found[k].transpose(1, 0, 2)):
                nodes[number].histogram = histogram
            for parent, counted, other in pairs[k]:
                nodes[other].histogram = nodes[parent].histogram - nodes[counted].histogram
            fresh = [*wanted[k], *[other for _, _, other in pairs[k]]]
            for parent, _, _ in pairs[k]:
                nodes[parent].histogram = None
            for number in fresh:
                if nodes[number].depth < run.params.max_depth:
                    find_split(nodes[number], layout, candidates, allowed[k], run.params)
            wanted[k], pairs[k] = [], []
            for number in splits_to_come(nodes, run.params):
                node = nodes[number]
                left = node.left_sums
                right = (node.grad - left[0], node.hess - left[1], node.rows - left[2])
                node.children = (len(nodes), len(nodes) + 1)
                nodes += [Node(node.depth + 1, *left), Node(node.depth + 1, *right)]
                if node.depth + 1 < run.params.max_depth:
                    first, second = node.children if left[2] <= right[2] else node.children[::-1]
                    wanted[k].append(first)
                    pairs[k].append((number, first, second))
    trees = []
    for run, nodes in zip(runs, grown):
        kept = cut_back(nodes, run.params)
        for node in kept:
            node.histogram = None
        trees.append(Tree(kept, [run.params.leaf_value(node, tree) for node in kept]))
    return trees


def _moved(block: dict, walks: list[_Walk], values: list[np.ndarray]) -> dict:
    """Margins after one more tree; every row moves, also those left out."""
    steps = [value.take(walk.nodes_at(block["bins"])) for walk, value in zip(walks, values)]
    return block | {"margins": block["margins"] + np.array(steps)}


def base_margins(blocks: RDD, runs: list[Run]) -> list[float]:
    """Log-odds of the rows that a run sees; of the first order 0, as its first tree fits the labels."""

    def part(block: dict) -> list[np.ndarray]:
        chosen = [_in_training(block, run) for run in runs]
        return [np.array([[block["label"][c].sum(dtype=np.float64), c.sum()] for c in chosen])]

    found = _added(blocks, part)
    out = []
    for run, (late, rows) in zip(runs, found[0] if found else [(0, 0)] * len(runs)):
        share = late / rows if rows and run.params.order != 1 else 0.5
        out.append(math.log(share / (1 - share)) if 0 < share < 1 else math.copysign(SURE, share - 0.5))
    return out


@dataclass
class Boosted:
    """Grown runs: base margins, trees per run, and the blocks with their final margins."""

    layout: Layout
    runs: list[Run]
    bases: list[float]
    trees: list[list[Tree]]
    blocks: RDD

    def margins(self, spark: SparkSession, key_type: str) -> DataFrame:
        """key, label, fold, and the log-odds of every run as an array."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed in batch.column(0):
                    block = pickle.loads(packed.as_py())
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": block["key"],
                            "label": block["label"].astype(np.int32),
                            "fold": block["fold"],
                            "margins": list(block["margins"].T),
                        }
                    )

        packed = self.blocks.map(
            lambda b: (bytearray(pickle.dumps({n: b[n] for n in ("key", "label", "fold", "margins")})),)
        )
        return spark.createDataFrame(packed, "block binary").mapInArrow(
            unpack, f"key {key_type}, label int, fold int, margins array<double>"
        )


def boost(
    encoded: DataFrame,
    layout: Layout,
    runs: list[Run],
    label: str = TARGET,
    key: str | None = ORDER_KEY,
    fold: str | None = None,
) -> Boosted:
    """Grow all runs together, tree by tree."""
    context = encoded.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(encoded.sparkSession, "boosting"))
    # Blocks are bytes already: serialized storage would copy each once more per pass.
    kept = StorageLevel.MEMORY_AND_DISK_DESER
    rows = packed_blocks(encoded, layout, label, key, fold).persist(kept)
    bases = base_margins(rows, runs)
    blocks = rows.map(lambda block: _started(block, bases)).persist(kept)
    candidates = layout.candidates()
    trees: list[list[Tree]] = [[] for _ in runs]
    previous = rows
    for number in range(max(run.params.iterations for run in runs)):
        active = [k for k, run in enumerate(runs) if number < run.params.iterations]
        if len(active) == len(runs):
            grown = grow_trees(blocks, layout, runs, number)
        else:
            part = blocks.map(lambda b, a=active: b | {"margins": b["margins"][a]})
            some = iter(grow_trees(part, layout, [runs[k] for k in active], number))
            grown = [next(some) if k in active else Tree([Node(0, 0, 0, 0)], [0.0]) for k in range(len(runs))]
        previous.unpersist()  # the pass above has made and kept its successor
        for k in active:
            trees[k].append(grown[k])
        walks = [_walk(tree.nodes, candidates) for tree in grown]
        values = [np.array(tree.values) for tree in grown]
        previous = blocks
        blocks = blocks.map(lambda block, w=walks, v=values: _moved(block, w, v)).persist(kept)
        if (number + 1) % CHECKPOINT_EVERY == 0:
            blocks.checkpoint()
    return Boosted(layout, runs, bases, trees, blocks)


def first_histograms(
    encoded: DataFrame,
    layout: Layout,
    runs: list[Run],
    label: str = TARGET,
    key: str = ORDER_KEY,
    fold: str | None = None,
) -> DataFrame:
    """fold, feature, bin and the sums that the first tree of each run starts from."""
    spark = encoded.sparkSession
    rows = packed_blocks(encoded, layout, label, key, fold)
    bases = base_margins(rows, runs)
    blocks = rows.map(lambda block: _started(block, bases))
    root = _Walk(*(np.array([x]) for x in (-1, 0, False, 0, 0)))
    found = histograms(blocks, layout, runs, 0, [root] * len(runs), [[0]] * len(runs))
    features = [name.replace(IMPUTED, "").removesuffix("_index") for name in layout.columns]
    cells = [
        (run.fold, features[column], b, *[int(x) for x in sums[:, 0, layout.offsets[column] + b]])
        for run, sums in zip(runs, found)
        for column, size in enumerate(layout.bins)
        for b in range(size)
    ]
    return spark.createDataFrame(
        cells, "fold int, feature string, bin int, grad bigint, hess bigint, order_count bigint"
    )


def tree_rows(layout: Layout, tree: Tree, names: list[str]) -> list[tuple]:
    """path (L and R turns from the root), feature, threshold, gain, rows, value of every node."""
    candidates = layout.candidates()
    paths = {0: ""}
    rows = []
    for number, (node, value) in enumerate(zip(tree.nodes, tree.values)):
        feature = threshold = gain = None
        if node.children:
            for child, turn in zip(node.children, "LR"):
                paths[child] = paths[number] + turn
            feature = names[candidates["slot"][node.split]]
            threshold, gain = float(candidates["threshold"][node.split]), node.gain
        rows.append((paths[number], feature, threshold, gain, node.rows, value))
    return rows


def _written(rows: list[tuple], schema: str, spark: SparkSession, path: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)


NODE_SCHEMA = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, "
    "impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, "
    "split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def spark_model(
    spark: SparkSession, layout: Layout, run: Run, base: float, trees: list[Tree], label: str = TARGET
) -> GBTClassificationModel:
    """The trees as Spark's own model, by way of its stored form.

    Values are halved, because Spark's margin is half the log-odds, and divided by the weight
    of their tree; the base margin is part of the first tree's values.
    """
    candidates = layout.candidates()
    rows = []
    for number, tree in enumerate(trees):
        start, scale = base if number == 0 else 0.0, 2 * run.params.weight(number)
        for i, (node, value) in enumerate(zip(tree.nodes, tree.values)):
            children, split, gain = (-1, -1), (-1, [], -1), -1.0
            if node.children:
                children, gain = node.children, node.gain
                split = (
                    int(candidates["slot"][node.split]), [float(candidates["threshold"][node.split])], -1
                )
            data = (i, (start + value) / scale, 0.0, [float(node.rows), 0.0, 0.0], node.rows, gain, *children, split)
            rows.append((number, data))
    params = {
        "labelCol": label, "featuresCol": "features", "maxIter": run.params.iterations, "maxDepth": run.params.max_depth,
        "stepSize": run.params.rate, "subsamplingRate": run.params.row_share, "seed": run.params.seed,
    }
    defaults, tree_defaults = (
        {param.name: estimator.getOrDefault(param) for param in estimator.params if estimator.hasDefault(param)}
        for estimator in (GBTClassifier(), DecisionTreeRegressor())
    )

    def metadata(kind: str, prefix: str, own: dict, default: dict, **more: int) -> str:
        return json.dumps(
            {
                "class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000),
                "sparkVersion": spark.version, "uid": f"{prefix}_{uuid.uuid4().hex[:12]}",
                "paramMap": own, "defaultParamMap": default, **more,
            }
        )

    path = scratch_path(spark, "boosted-model")
    whole = metadata(
        "classification.GBTClassificationModel", "HistogramBoosting", params, defaults,
        numFeatures=layout.slots, numTrees=len(trees),
    )
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = {"labelCol": label, "featuresCol": "features", "maxDepth": run.params.max_depth}
    listed = [
        (i, metadata("regression.DecisionTreeRegressionModel", "dtr", each, tree_defaults), run.params.weight(i))
        for i in range(len(trees))
    ]
    _written(listed, "_1 int, _2 string, _3 double", spark, f"{path}/treesMetadata")
    _written(rows, NODE_SCHEMA, spark, f"{path}/data")
    return GBTClassificationModel.load(path)


class HistogramBoosting(Estimator):
    """Pipeline stage behind the preprocessing stages; fits one run on all rows."""

    def __init__(self, params: BoostingParams, label: str = TARGET, cuts: dict | None = None):
        super().__init__()
        self.settings, self.label, self.cuts = params, label, cuts

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        layout = layout_of(dataset, category_sizes(dataset), self.cuts)
        key = ORDER_KEY if ORDER_KEY in dataset.columns else None
        run = Run(self.settings)
        grown = boost(dataset, layout, [run], self.label, key)
        try:
            return spark_model(dataset.sparkSession, layout, run, grown.bases[0], grown.trees[0], self.label)
        finally:
            grown.blocks.unpersist()


class GradientBoosting(GBTClassifier):
    """Spark's boosted trees with its parameters, grown by the passes of this module."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        return HistogramBoosting(self.settings(), self.getLabelCol())._fit(dataset)

    def settings(self) -> BoostingParams:
        return BoostingParams(
            iterations=self.getMaxIter(), rate=self.getStepSize(), max_depth=self.getMaxDepth(),
            row_share=self.getSubsamplingRate(), l2=0.0, min_hessian=0.0,
            min_rows=self.getMinInstancesPerNode(), seed=self.getSeed(), order=1, bins=self.getMaxBins(),
        )


def category_sizes(encoded: DataFrame) -> list[int]:
    """Fitted categories per indexed column, out of the column's metadata."""
    sizes = []
    for name in CATEGORICAL_FEATURES:
        attributes = encoded.schema[f"{name}_index"].metadata["ml_attr"]
        # The label kept for unseen values stands last.
        sizes.append(len(attributes["vals"]) - 1)
    return sizes
