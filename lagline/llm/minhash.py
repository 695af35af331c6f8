"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (the whole text where it has fewer). A shingle's weight
is its count in the text times a damped inverse document frequency between 1 and
``1 + DAMPING``. Whatever the frequencies, a plain similarity of ``plain_bound(THRESHOLD)``
is a weighted one of ``THRESHOLD``, so copies within a hot group are not lost.
Document frequencies are those of ``2 ** SLOT_BITS`` hash slots over all documents: a
table of that size whatever the input, so it is broadcast.

Improved consistent weighted sampling draws, for each of ``BANDS * ROWS`` seeds, the
shingle with the smallest transformed weight together with its quantised weight. Two
texts draw the same with a probability equal to their weighted Jaccard similarity.
``ROWS`` draws form a band; texts that agree in a band are candidates.

No bucket's pairs are written out. In every bucket each text is paired with one
representative, the member whose own buckets are fullest (of a text and its edited
copies that is the text they come from). Pairs are verified by exact weighted Jaccard
similarity. Where a bucket still holds more than one component, its texts go through an
exact way: a prefix filter. Two texts with similarity ``t`` or more share one of the
first shingles, in order of rarity, that make up more than ``1 - t`` of the weight, so
only texts of different components that share such a shingle, and whose weight up to
there leaves enough to share, are verified. No candidate is capped or dropped.

Texts with equal words are collapsed before banding; they are one class by definition.

Defined results: a null text is empty; a text without words is a class of its own; rows
with a null id are classes of their own with a null class id and are kept; rows that
repeat an id are one text to the class (the smallest word digest speaks for it); an
empty table gives an empty result; extra columns are ignored (``survivors`` carries
them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.common import bounded_batches, stored
from lagline.llm.components import connected_components

WINDOW = 5
THRESHOLD = 0.8
# What the rarest shingle weighs more than the most frequent.
DAMPING = 0.02
BANDS = 12
ROWS = 4
SLOT_BITS = 18
RARITY_BITS = 18
# Bits of the broadcast id filter: so many an id, and no filter beyond 2 ** FILTER_BITS.
FILTER_SHARE = 16
FILTER_BITS = 27
SEED = 42
DRAW_BITS = 16
# Odd multipliers of a 64-bit mixing step.
MIX_1 = np.uint64(0x9E3779B97F4A7C15)
MIX_2 = np.uint64(0xD6E8FEB86659FD93)
MEMO_WORDS = 200_000
STRIP = 1_024


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * MIX_2
    values = (values ^ (values >> np.uint64(29))) * MIX_1
    return values ^ (values >> np.uint64(32))


class _WordNumbers(dict):
    """Words to 64-bit numbers, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        number = self[word] = xxhash.xxh64_intdigest(word)
        return number


_NUMBERS = _WordNumbers()


def split_words(text: str | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, in UTF-8."""
    return (text or "").encode("utf-8", "replace").split()


def word_numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_NUMBERS.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every shingle in the order of the text."""
    width = min(WINDOW, len(words))
    if not width:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * MIX_1 + words[k : len(words) - width + 1 + k]
        total ^= total >> np.uint64(29)
    return mixed(total)


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts."""
    return np.unique(shingle_hashes(word_numbers(words)), return_counts=True)


@lru_cache(maxsize=2)
def draws(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A pool of draws: Gamma(2,1) and its inverse, log Gamma(2,1), and uniform numbers."""
    source = np.random.Generator(np.random.PCG64(seed))
    size = 1 << DRAW_BITS
    rate = source.gamma(2.0, 1.0, size).astype(np.float32) + np.float32(1e-6)
    cost = np.log(source.gamma(2.0, 1.0, size) + 1e-12).astype(np.float32)
    shift = source.random(size, dtype=np.float32)
    return rate, np.float32(1) / rate, cost - rate * (1 - shift), shift


def samples(hashes: np.ndarray, weights: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` consistent weighted samples of a weighted set, as 64-bit numbers.

    One row per sample and one column per shingle, in strips that stay in the cache.
    """
    rate, inverse, offset, shift = draws(seed)
    seeds = mixed(np.arange(1, count + 1, dtype=np.uint64) * MIX_1 + np.uint64(seed))
    best = np.full(count, np.inf, dtype=np.float32)
    drawn = np.zeros(count, dtype=np.uint64)
    logs = np.log(weights).astype(np.float32)
    rows = np.arange(count)
    for start in range(0, len(hashes), STRIP):
        part, log = hashes[start : start + STRIP], logs[start : start + STRIP]
        keys = part[None, :] ^ seeds[:, None]
        keys *= MIX_2
        keys >>= np.uint64(64 - DRAW_BITS)
        at = keys.view(np.int64)
        level = inverse.take(at)
        level *= log
        level += shift.take(at)
        np.floor(level, out=level)
        # log of c / (y * exp(r)) with y = exp(r * (level - shift)).
        score = rate.take(at)
        score *= level
        np.subtract(offset.take(at), score, out=score)
        first = score.argmin(axis=1)
        value = score[rows, first]
        better = value < best
        token = mixed(part[first] + level[rows, first].astype(np.int64).view(np.uint64) * MIX_1)
        best[better], drawn[better] = value[better], token[better]
    return drawn


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets with sorted hashes."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low, high = np.minimum(a[1][i], b[1][j]).sum(), np.maximum(a[1][i], b[1][j]).sum()
    total = a[1].sum() - a[1][i].sum() + b[1].sum() - b[1][j].sum() + high
    return float(low / total) if total > 0 else 0.0


def _slots(hashes: np.ndarray, bits: int = SLOT_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.intp)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Documents per hash slot over all rows of (text); at most ``2 ** SLOT_BITS`` numbers."""

    def hashes(text: str | None) -> np.ndarray:
        return shingle_hashes(word_numbers(split_words(text)))

    return _slot_counts(texts.select("text"), hashes, SLOT_BITS)


def rarity(sets: DataFrame) -> np.ndarray:
    """Sets per hash slot over the rows of (hashes), in a table of ``2 ** RARITY_BITS``."""

    def hashes(packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=np.uint64)

    return _slot_counts(sets.select("hashes"), hashes, RARITY_BITS)


def _slot_counts(rows: DataFrame, hashes: Callable[..., np.ndarray], bits: int) -> np.ndarray:
    """Rows per hash slot; every row counts once in a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts[np.unique(_slots(hashes(value.as_py()), bits))] += 1
        used = np.flatnonzero(counts)
        for start in range(0, len(used), 65_536):
            part = used[start : start + 65_536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["slot", "n"]
            )

    summed = (
        rows.mapInArrow(run, "slot int, n bigint")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    out = np.zeros(1 << bits, dtype=np.int64)
    out[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return out


def damped_idf(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Above 1 (near it in every document) and up to ``1 + DAMPING`` (in one)."""
    n = max(documents, 1)
    rare = np.log1p(n / np.maximum(frequencies, 1)) / np.log1p(n)
    return (1 + DAMPING * rare).astype(np.float32)


def plain_bound(threshold: float) -> float:
    """The similarity of the counts alone from which on texts are surely near.

    At worst all that two texts share weighs 1 and all else ``1 + DAMPING``.
    """
    high = threshold * (1 + DAMPING)
    return high / (high + 1 - threshold)


def weighted(words: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their TF-IDF weights."""
    hashes, counts = shingles(words)
    return hashes, counts * idf[_slots(hashes)]


def signatures(texts: DataFrame, idf) -> DataFrame:
    """(id, digest, mark, bands) of every row of (id, text, mark) that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, digests, bands = [], [], []
            for at, value in enumerate(batch.column(1)):
                words = split_words(value.as_py())
                if not words:
                    continue
                hashes, weights = weighted(words, idf.value)
                drawn = samples(hashes, weights, BANDS * ROWS).reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    key = mixed(key * MIX_1 + drawn[:, k])
                kept.append(at)
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                bands.append(key.astype(np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    pa.array(digests, pa.binary()),
                    batch.column(2).take(rows),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat)
                    ),
                ],
                names=["id", "digest", "mark", "bands"],
            )

    return texts.mapInArrow(run, "id bigint, digest binary, mark bigint, bands array<bigint>")


def possible(texts: DataFrame, wanted: DataFrame, limit: int = FILTER_BITS) -> DataFrame:
    """Rows of (id, text, mark) without most of those whose id is not in ``wanted`` (id).

    A bit map over id hashes, ``FILTER_SHARE`` bits an id, is broadcast, so that a join by
    id does not have to move every text. It loses no wanted row. Beyond ``2 ** limit`` bits
    the rows come back as they are: what is broadcast stays below that size, and the join
    that follows moves the texts instead.
    """
    width = max(wanted.count() * FILTER_SHARE, 1 << 15).bit_length()
    if width > limit:
        return texts
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - width)
    maps = (
        wanted.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    at = F.bitmap_bit_position("slot").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return (
        texts.withColumn("slot", slot)
        .withColumn("bucket", F.bitmap_bucket_number("slot"))
        .join(F.broadcast(maps), "bucket")
        .filter(F.getbit(byte, F.pmod(at, F.lit(8))) == 1)
        .select(*texts.columns)
    )


def packed_sets(texts: DataFrame, idf) -> DataFrame:
    """(id, hashes, weights) of rows (id, text): the weighted sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [weighted(split_words(t.as_py()), idf.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h.tobytes() for h, _ in sets], pa.binary()),
                    pa.array([w.astype(np.float32).tobytes() for _, w in sets], pa.binary()),
                ],
                names=["id", "hashes", "weights"],
            )

    return texts.mapInArrow(run, "id bigint, hashes binary, weights binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) with a similarity of at least ``threshold``."""

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("id").alias(name),
            F.col("hashes").alias(f"hashes_{name}"),
            F.col("weights").alias(f"weights_{name}"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}

            def one(name: str, at: int) -> tuple[np.ndarray, np.ndarray]:
                return (
                    np.frombuffer(columns[f"hashes_{name}"][at].as_py(), dtype=np.uint64),
                    np.frombuffer(columns[f"weights_{name}"][at].as_py(), dtype=np.float32),
                )

            near = [
                similarity(one("a", i), one("b", i)) >= threshold - 1e-6 for i in range(len(batch))
            ]
            yield pa.RecordBatch.from_arrays(
                [columns["a"], columns["b"]], names=["a", "b"]
            ).filter(pa.array(near, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def prefixes(sets: DataFrame, frequencies, threshold: float) -> DataFrame:
    """(id, shingle, spent, total) of the rarest shingles up to ``1 - threshold``.

    ``spent`` is the weight of the rarer shingles of the text, ``total`` that of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, before, totals = [], [], [], []
            for at in range(len(batch)):
                hashes = np.frombuffer(batch.column(1)[at].as_py(), dtype=np.uint64)
                weights = np.frombuffer(batch.column(2)[at].as_py(), dtype=np.float32)
                order = np.lexsort((hashes, frequencies.value[_slots(hashes, RARITY_BITS)]))
                ordered = weights[order].astype(np.float64)
                total, spent = ordered.sum(), np.cumsum(ordered) - ordered
                first = spent <= (1 - threshold) * total + 1e-3
                keys.append(hashes[order[first]].astype(np.int64))
                before.append(spent[first])
                totals.append(np.full(len(keys[-1]), total))
                rows.append(np.full(len(keys[-1]), at))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.concatenate(rows))),
                        pa.array(np.concatenate(keys)),
                        pa.array(np.concatenate(before)),
                        pa.array(np.concatenate(totals)),
                    ],
                    names=["id", "shingle", "spent", "total"],
                )

    return sets.select("id", "hashes", "weights").mapInArrow(
        run, "id bigint, shingle bigint, spent double, total double"
    )


def _representatives(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of members with their bucket's representative; the shared buckets."""
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = stored(members.join(sizes, ["band", "key"]), "minhash-members")
    # A text's standing: how many texts its buckets hold together.
    standing = shared.groupBy("id").agg(F.sum("size").alias("standing"))
    ranked = shared.join(standing, "id")
    lead = ranked.groupBy("band", "key").agg(
        F.max_by("id", F.struct("standing", -F.col("id"))).alias("lead")
    )
    return (
        shared.join(lead, ["band", "key"])
        .filter("id <> lead")
        .select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        .distinct()
    ), shared


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, class_id, class_size, kept) for every row; of a class the smallest id is kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")
    )
    # The mark tells the row that speaks for a repeated id from the others.
    known = texts.filter("id is not null").withColumn("mark", F.xxhash64("text"))
    frequencies = document_frequencies(known)
    documents = known.count()
    idf = spark.sparkContext.broadcast(damped_idf(frequencies, documents))
    signed = stored(
        signatures(known, idf)
        .groupBy("id")
        .agg(F.min(F.struct("digest", "mark", "bands")).alias("s"))
        .select("id", "s.digest", "s.mark", "s.bands"),
        "minhash-signatures",
    )
    # Texts with the same words: the smallest id stands for all.
    equal = signed.groupBy("digest").agg(
        F.min("id").alias("first"), F.min_by("bands", "id").alias("bands")
    )
    members = equal.select(
        F.col("first").alias("id"), F.posexplode("bands").alias("band", "key")
    )
    star, shared = _representatives(members)
    pairs = stored(star, "minhash-pairs")
    wanted = stored(
        signed.select("id", "mark").join(shared.select("id").distinct(), "id", "left_semi"),
        "minhash-wanted",
    )
    # An inner join: a semi join would be pushed below the filter and move every text.
    chosen = possible(known, wanted).join(wanted, ["id", "mark"])
    sets = stored(
        packed_sets(chosen.dropDuplicates(["id", "mark"]).select("id", "text"), idf),
        "minhash-sets",
    )
    links = stored(verified(pairs, sets, threshold), "minhash-links")
    labels = connected_components(links)
    # Buckets that still hold several components.
    labelled = shared.join(labels, "id", "left").select(
        "band", "key", "id", F.coalesce("component", "id").alias("component")
    )
    open_buckets = labelled.groupBy("band", "key").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high")
    rest = stored(
        labelled.join(open_buckets.select("band", "key"), ["band", "key"], "left_semi")
        .select("id", "component")
        .distinct(),
        "minhash-rest",
    )
    # The order by rarity is that among these texts: what one of them has alone comes first.
    open_sets = stored(sets.join(rest.select("id"), "id", "left_semi"), "minhash-open-sets")
    rare = spark.sparkContext.broadcast(rarity(open_sets))
    keyed = stored(prefixes(open_sets, rare, threshold).join(rest, "id"), "minhash-prefixes")
    several = keyed.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high").select("shingle")
    left = keyed.join(several, "shingle", "left_semi")
    right = left.select(
        F.col("shingle").alias("other_shingle"),
        F.col("id").alias("other"),
        F.col("component").alias("other_component"),
        F.col("spent").alias("other_spent"),
        F.col("total").alias("other_total"),
    )
    # At the first shingle that two texts share, neither's rarer ones are shared, which
    # bounds what they can have in common. If that falls short at the first, it does at
    # every later one.
    common = F.least(F.col("total") - F.col("spent"), F.col("other_total") - F.col("other_spent"))
    enough = common * (1 + threshold) >= threshold * (F.col("total") + F.col("other_total")) - 1e-3
    more = (
        left.join(
            right,
            (F.col("shingle") == F.col("other_shingle"))
            & (F.col("component") < F.col("other_component"))
            & enough,
        )
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        .distinct()
    )
    more_links = stored(verified(more, sets, threshold), "minhash-more")
    if not more_links.isEmpty():
        links = links.unionByName(more_links)
        labels = connected_components(links)
    by_id = (
        signed.select("id", "digest")
        .join(equal.select("digest", "first"), "digest")
        .join(labels.select(F.col("id").alias("first"), "component"), "first", "left")
        .select("id", F.coalesce("component", "first").alias("class_id"))
    )
    rows = texts.select("id").join(by_id, "id", "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id")
    )
    sizes = rows.filter("class_id is not null").groupBy("class_id").agg(
        F.count(F.lit(1)).alias("class_size")
    )
    return rows.join(sizes, "class_id", "left").select(
        F.col("id").alias(id_col),
        "class_id",
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def survivors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` without the rows whose class has a smaller id; rows without an id stay."""
    dropped = near_classes(docs, id_col, text_col, threshold).filter("not kept").select(
        F.col(id_col).alias("__dropped")
    )
    return docs.join(dropped, F.col(f"`{id_col}`") == F.col("__dropped"), "left_anti")
