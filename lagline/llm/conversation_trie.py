"""The prefix trie of conversations, its subtree totals by time-forward processing.

A node is a distinct sequence of the first ``d`` turns (role, text) of a conversation. It
is named by its depth and two 64-bit prefix hashes, ``sum(x[i] * B ** i)`` over the SHA-256
digests of the turns. Prefix hashes add up, so a conversation of any length is numbered
and hashed in pieces: rows are range partitioned by conversation and turn, each task
hashes what it has, and only the one conversation that a task shares with the tasks
before it needs a carry (one row per task, on the driver).

Nodes are one grouped aggregate over the turns. Their totals flow from the leaves to the
root. Nodes with more than ``limit`` turns of members below them form the top; what
hangs below the top are whole subtrees, the shards, each of at most ``limit`` nodes,
however many members share a first turn. Within a shard the nodes come sorted by
descending level (Spark's external sort) and every node sends its totals to its parent
through a priority queue in the same order, which spills sorted runs to files of its
task. Then the totals of the shard roots, summed by parent, flow through the top in the
same way. The limit follows the number of turns, so the top has at most ``SHARDS`` nodes
per level; it is as deep as the longest conversation with so many turns below.

Which conversations end at a node is hashed as a stream: sorted ids are packed into texts
of ``PACK`` bytes, and the digest runs over these, so a group of copies of any size takes
little memory.

Defined results: turns are ordered by turn (null first), equal ones by role and the
digest of role and text; repeated rows are turns of their own; a null role or text is
empty; rows with a null conversation id belong to no conversation and are left out; ids
divide towards zero, as in SQL; an empty table has no members, hence no root and no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagline.llm.common import bounded_batches, stored

# Conversations that share a head: the first of every GROUP lends up to MAX_HEAD turns.
GROUP = 5
HEADS = 9
MAX_HEAD = HEADS - 1
MIN_SHARD = 10_000
SHARDS = 4_096
QUEUE = 100_000
PACK = 1 << 16
# Two odd multipliers, one per prefix hash.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
WORD = 1 << 64
EMPTY = hashlib.sha256(b"").hexdigest()

Batches = Iterator[pa.RecordBatch]


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, two numbers of the digest and the bytes of the text."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    written = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    number = [
        F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("long").alias(f"x{k + 1}")
        for k in (0, 1)
    ]
    return (
        rows.filter(F.col("conv_id").isNotNull())
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            role.alias("role"),
            F.sha2(written, 256).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
        )
        .select("*", *number)
        .repartitionByRange("conv_id", "turn", "role", "digest")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    )


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


NUMBERED = (
    "part int, conv_id bigint, is_first boolean, place bigint, "
    "p1 bigint, p2 bigint, q1 bigint, q2 bigint, bytes bigint"
)


def numbered_here(batches: Batches) -> Batches:
    """Place and prefix hashes of each turn, counted from its conversation's first row here.

    ``p`` includes the turn, ``q`` stops before it. ``is_first`` marks the conversation
    that the rows of this task begin with, which earlier tasks may share.
    """
    part = TaskContext.get().partitionId()
    opening = None
    last, count, sums = None, 0, [0, 0]
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        opening = int(conv[0]) if opening is None else opening
        if last != int(conv[0]):
            count, sums = 0, [0, 0]
        begins = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        lengths = np.diff(np.concatenate([begins, [size]]))
        place = np.arange(size) - np.repeat(begins, lengths)
        carried = lengths[0]
        columns = []
        for k, base in enumerate(BASES):
            powers = np.ones(size, dtype=np.uint64)
            np.multiply.accumulate(np.full(size - 1, base, dtype=np.uint64), out=powers[1:])
            factor = powers[place]
            factor[:carried] *= np.uint64(pow(base, count, WORD))
            terms = _unsigned(batch, f"x{k + 1}") * factor
            total = np.cumsum(terms, dtype=np.uint64)
            before = total - terms
            prefix = total - np.repeat(before[begins], lengths)
            prefix[:carried] += np.uint64(sums[k])
            columns += [prefix, prefix - terms]
        place[:carried] += count
        last, count = int(conv[-1]), int(place[-1]) + 1
        sums = [int(columns[0][-1]), int(columns[2][-1])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, part, dtype=np.int32)),
                pa.array(conv),
                pa.array(conv == opening),
                pa.array(place + 1),
                *[_signed(columns[j]) for j in (0, 2, 1, 3)],
                batch.column(batch.schema.get_field_index("bytes")),
            ],
            names=["part", "conv_id", "is_first", "place", "p1", "p2", "q1", "q2", "bytes"],
        )


def carries(parts: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """What each task's first conversation had in earlier tasks: turns and prefix hashes.

    ``parts``: per task its number, first and last conversation, and the last one's
    place and prefix hashes.
    """
    found: dict[int, tuple[int, int, int]] = {}
    conv, count, sums = None, 0, (0, 0)
    for part, first, last, place, p1, p2 in sorted(parts):
        ends = (p1 % WORD, p2 % WORD)
        if conv == first:
            found[part] = (count, *sums)
        if conv == last:
            ends = tuple(
                (s + pow(b, count, WORD) * e) % WORD for s, b, e in zip(sums, BASES, ends)
            )
            place += count
        conv, count, sums = last, place, ends
    return found


def numbered(rows: DataFrame) -> DataFrame:
    """Every turn with its place in its conversation (from 1) and its prefix hashes."""
    ordered = ordered_turns(rows).select("conv_id", "x1", "x2", "bytes")
    local = stored(ordered.mapInArrow(numbered_here, NUMBERED), "trie-turns")
    tail = F.max(F.struct("conv_id", "place", "p1", "p2")).alias("tail")
    edges = local.groupBy("part").agg(F.min("conv_id").alias("first"), tail)
    found = carries(
        [
            (r["part"], r["first"], r["tail"]["conv_id"], r["tail"]["place"], r["tail"]["p1"], r["tail"]["p2"])
            for r in edges.collect()  # one row per task
        ]
    )
    if not found:
        return local

    def run(batches: Batches) -> Batches:
        for batch in batches:
            part = batch.column(0).to_numpy()
            opening = batch.column(2).to_numpy(zero_copy_only=False)
            place = batch.column(3).to_numpy().copy()
            hashes = [_unsigned(batch, n).copy() for n in ("p1", "p2", "q1", "q2")]
            for number in np.unique(part):
                if int(number) in found:
                    rows = opening & (part == number)
                    count, *sums = found[int(number)]
                    place[rows] += count
                    for k in range(4):
                        factor = np.uint64(pow(BASES[k % 2], count, WORD))
                        hashes[k][rows] = hashes[k][rows] * factor + np.uint64(sums[k % 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(place), *map(_signed, hashes), batch.column(8)],
                names=batch.schema.names,
            )

    return local.mapInArrow(run, NUMBERED)


def conversations(turns: DataFrame) -> DataFrame:
    """Per conversation its head, what it borrows, and its rebuilt length.

    ``lent``: the turns taken from the first conversation of its group; ``b`` are the
    prefix hashes after them, ``c`` those of its own turns that they replace.
    """
    short = F.when(F.col("place") <= MAX_HEAD, F.struct("place", "p1", "p2", "q1", "q2", "bytes"))
    heads = turns.groupBy("conv_id").agg(
        F.max("place").alias("turns"), F.sort_array(F.collect_list(short)).alias("head")
    )
    lenders = heads.select(F.col("conv_id").alias("lender"), F.col("head").alias("lender_head"))
    own_last = F.least(F.col("borrows"), F.col("turns")).cast("int")

    def after(turn_list: str, count: Column, name: str) -> Column:
        return F.when(count > 0, F.element_at(turn_list, count)[name]).otherwise(F.lit(0))

    lent_count = F.size("lent")
    return (
        heads.withColumn("borrows", F.crc32(F.col("conv_id").cast("string")) % HEADS)
        .withColumn("lender", F.col("conv_id") - F.col("conv_id") % GROUP)
        .join(lenders, "lender", "left")
        .withColumn(
            "lent",
            F.filter(
                F.coalesce("lender_head", F.filter("head", lambda _: F.lit(False))),
                lambda turn: turn["place"] <= F.col("borrows"),
            ),
        )
        .select(
            "conv_id",
            "borrows",
            "lent",
            F.size("lent").cast("long").alias("lent_turns"),
            *[after("lent", lent_count, f"p{k}").alias(f"b{k}") for k in (1, 2)],
            *[after("head", own_last, f"p{k}").alias(f"c{k}") for k in (1, 2)],
            (lent_count + F.greatest(F.col("turns") - F.col("borrows"), F.lit(0))).alias("length"),
        )
    )


def _shifted(batches: Batches) -> Batches:
    """Own turns moved behind the borrowed ones: their depth and prefix hashes there."""
    back = [np.array([pow(pow(b, -1, WORD), d, WORD) for d in range(HEADS)], dtype=np.uint64) for b in BASES]
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns))
        lent, borrows, place = (column[n].to_numpy() for n in ("lent_turns", "borrows", "place"))
        hashes = []
        for name in ("p", "q"):
            for k in (1, 2):
                own = _unsigned(batch, f"{name}{k}") - _unsigned(batch, f"c{k}")
                hashes.append(_unsigned(batch, f"b{k}") + own * back[k - 1][borrows - lent])
        yield pa.RecordBatch.from_arrays(
            [column["conv_id"], pa.array(lent + place - borrows), *map(_signed, hashes), column["bytes"], column["length"]],
            names=["conv_id", "depth", "p1", "p2", "q1", "q2", "bytes", "length"],
        )


REBUILT = "conv_id bigint, depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, bytes bigint, length bigint"


def rebuilt_turns(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per turn of each rebuilt conversation: its node, its parent's node."""
    borrowed = convs.select("conv_id", "length", F.inline("lent")).select(
        "conv_id", F.col("place").alias("depth"), "p1", "p2", "q1", "q2", "bytes", "length"
    )
    own = (
        turns.join(convs.drop("lent"), "conv_id")
        .filter(F.col("place") > F.col("borrows"))
        .mapInArrow(_shifted, REBUILT)
    )
    return borrowed.unionByName(own)


class SpillingQueue:
    """A priority queue of tuples of five integers, in memory up to ``limit`` of them.

    Beyond that the queue's content is written as one sorted run; the smallest element is
    the smallest of the heap's and the runs' first ones.
    """

    FORMAT = struct.Struct("<5q")

    def __init__(self, limit: int = QUEUE):
        self.limit = limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []
        self.spilled = 0

    def _read(self, file) -> Iterator[tuple]:
        file.seek(0)
        while block := file.read(self.FORMAT.size * 1_024):
            yield from self.FORMAT.iter_unpack(block)
        file.close()

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) >= self.limit:
            file = tempfile.TemporaryFile()
            file.writelines(self.FORMAT.pack(*entry) for entry in sorted(self.heap))
            self.heap = []
            self.spilled += 1
            entries = self._read(file)
            heapq.heappush(self.runs, (next(entries), self.spilled, entries))

    def first(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        item, number, entries = self.runs[0]
        following = next(entries, None)
        if following is None:
            heapq.heappop(self.runs)
        else:
            heapq.heapreplace(self.runs, (following, number, entries))
        return item


NODE = ("conv_id", "depth", "p1", "p2", "q1", "q2", "n_convs", "bytes", "root_depth")
INCOMING = ("in_children", "in_leaves", "in_saved")
TOTALS = ("n_children", "n_leaves", "saved_tokens")


def time_forward(limit: int = QUEUE) -> Callable[[Batches], Batches]:
    """Totals of nodes that come shard by shard in reverse level order.

    A node takes the messages addressed to it from the queue (they are next, since the
    queue has the order of the nodes) and sends its own totals to its parent, unless it
    is the root of its shard.
    """

    def run(batches: Batches) -> Batches:
        queue = SpillingQueue(limit)
        for batch in batches:
            column = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns)))
            totals: tuple[list, list, list] = ([], [], [])
            for depth, p1, p2, q1, q2, members, size, root, children, leaves, saved in zip(
                *(column[n] for n in (*NODE[1:], *INCOMING))
            ):
                own = (-depth, p1, p2)
                while (message := queue.first()) is not None and message[:3] == own:
                    children += 1
                    leaves += message[3]
                    saved += message[4]
                    queue.pop()
                leaves = leaves if children else 1
                saved += (members - 1) * size
                if depth > root:
                    queue.push((1 - depth, q1, q2, leaves, saved))
                for values, value in zip(totals, (children, leaves, saved)):
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(batch.schema.get_field_index(n)) for n in NODE],
                    *[pa.array(values, pa.int64()) for values in totals],
                ],
                names=[*NODE, *TOTALS],
            )

    return run


SUMMED = ", ".join(f"{name} bigint" for name in (*NODE, *TOTALS))


def subtree_totals(nodes: DataFrame, rows: DataFrame, queue: int, min_shard: int) -> DataFrame:
    """``nodes`` with the totals of their subtrees, shards first, then the top."""
    turns = nodes.filter(F.col("depth") == 0).agg(F.max("below")).first()[0] or 0
    limit = max(min_shard, -(-turns // SHARDS))
    is_top = (F.col("below") > limit) | (F.col("depth") == 0)
    key = ["depth", "p1", "p2"]
    top = nodes.filter(is_top)
    # How far down a conversation's path the top reaches; the next node is its shard's root.
    reach = (
        rows.join(top.filter(F.col("depth") > 0).select(*key), key, "left_semi")
        .groupBy("conv_id")
        .agg(F.max("depth").alias("reach"))
    )
    roots = (
        rows.join(reach, "conv_id", "left")
        .filter(F.col("depth") == F.coalesce("reach", F.lit(0)) + 1)
        .select("conv_id", F.col("depth").alias("root_depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    )
    order = [F.desc("depth"), "p1", "p2"]
    shards = (
        nodes.join(roots, "conv_id")
        .filter(F.col("depth") >= F.col("root_depth"))
        .withColumns({name: F.lit(0).cast("long") for name in INCOMING})
        .repartition("root_depth", "s1", "s2")
        .sortWithinPartitions("root_depth", "s1", "s2", *order)
        .select(*NODE, *INCOMING)
        .mapInArrow(time_forward(queue), SUMMED)
    )
    shards = stored(shards, "trie-shards")
    messages = (
        shards.filter(F.col("depth") == F.col("root_depth"))
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
        .agg(
            F.count("depth").alias("in_children"),
            F.sum("n_leaves").alias("in_leaves"),
            F.sum("saved_tokens").alias("in_saved"),
        )
    )
    above = (
        top.join(messages, key, "left")
        .fillna(0, list(INCOMING))
        .withColumn("root_depth", F.lit(0).cast("long"))
        .repartition(1)
        .sortWithinPartitions(*order)
        .select(*NODE, *INCOMING)
        .mapInArrow(time_forward(queue), SUMMED)
    )
    return shards.unionByName(above)


def _packed(batches: Batches) -> Batches:
    """Sorted (node, id) rows as comma-joined texts of bounded size."""

    def chunk(key: tuple, ids: list[int]) -> list:
        return [*key, ids[0], ",".join(map(str, ids))]

    key, ids, size = None, [], 0
    for batch in batches:
        out = []
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (node != key or size >= PACK):
                out.append(chunk(key, ids))
                ids, size = [], 0
            key = node
            ids.append(conv)
            size += 20
        yield _chunks(out)
    if ids:
        yield _chunks([chunk(key, ids)])


def _chunks(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["depth", "p1", "p2", "first", "ids"]
    )


def _digested(batches: Batches) -> Batches:
    """One digest per node over its texts in order."""
    key, digest = None, None
    for batch in batches:
        out = []
        for *node, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append([*key, digest.hexdigest()])
                key, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        yield _digests(out)
    if key is not None:
        yield _digests([[*key, digest.hexdigest()]])


def _digests(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["depth", "p1", "p2", "ends_sha256"]
    )


def ending_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node the digest of the ids, ascending, of the conversations that end there."""
    key = ["depth", "p1", "p2"]
    zero = F.lit(0).cast("long")
    ends = (
        rows.filter(F.col("depth") == F.col("length"))
        .select(*key, "conv_id")
        .unionByName(
            convs.filter(F.col("length") == 0).select(*[zero.alias(k) for k in key], "conv_id")
        )
    )
    texts = (
        ends.repartitionByRange(*key, "conv_id")
        .sortWithinPartitions(*key, "conv_id")
        .mapInArrow(_packed, "depth bigint, p1 bigint, p2 bigint, first bigint, ids string")
    )
    return (
        texts.repartition(*key)
        .sortWithinPartitions(*key, "first")
        .select(*key, "ids")
        .mapInArrow(_digested, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")
    )


def prefix_trie(rows: DataFrame, queue: int = QUEUE, min_shard: int = MIN_SHARD) -> DataFrame:
    """All nodes of the trie over ``rows`` (conv_id, turn, role, text), rebuilt as described."""
    bounded_batches(rows.sparkSession)
    turns = numbered(rows)
    convs = stored(conversations(turns), "trie-conversations")
    rebuilt = stored(rebuilt_turns(turns, convs), "trie-rebuilt")
    zero = F.lit(0).cast("long")
    root = (
        convs.agg(
            F.min("conv_id").alias("conv_id"),
            F.count("conv_id").alias("n_convs"),
            F.sum("length").alias("below"),
        )
        .filter(F.col("n_convs") > 0)
        .select(
            *[zero.alias(name) for name in ("depth", "p1", "p2", "q1", "q2")],
            "conv_id", "n_convs", "below", zero.alias("bytes"),
        )
    )
    inner = rebuilt.groupBy("depth", "p1", "p2", "q1", "q2").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("conv_id").alias("n_convs"),
        F.sum(F.col("length") - F.col("depth")).alias("below"),
        F.max("bytes").alias("bytes"),
    )
    nodes = stored(inner.unionByName(root), "trie-nodes")
    totals = subtree_totals(nodes, rebuilt, queue, min_shard)
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("p1").alias("q1"),
        F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return (
        totals.join(parents, ["depth", "q1", "q2"], "left")
        .join(ending_digests(rebuilt, convs), ["depth", "p1", "p2"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        )
    )
