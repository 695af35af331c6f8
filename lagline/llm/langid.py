"""Language identification by n-gram filters whose slots hold a bit per language.

Fitting. Character n-grams (``LENGTHS`` symbols, within a word and its two borders) are
counted once per document over a sample of about ``SAMPLE`` labelled documents of each
language, those with the smallest hash of their id. A language's profile is its
``PROFILE`` most frequent n-grams, of those in ``SHARE`` of its documents or more, so
that a few documents with a wrong label teach nothing. All profiles share one bit-sliced Bloom filter: a
table of ``2 ** slot_bits(PROFILE)`` slots, each a row of bits with one bit per
language. An n-gram sets its language's bit in ``PROBES`` slots, so one look-up (the
``and`` of those rows) answers for all languages at once.

Identification. Every n-gram of the whole text is looked up, and each language's bits
are summed. Of ``n`` n-grams a language that holds ``t`` is expected to show
``t + (n - t) * p`` bits, where ``p`` is the false positive rate of its slice (the share
of its bits that are set, to the power ``PROBES``). Solved for ``t``, that is the
corrected count; the largest one decides, equal ones by the smaller language name. The
score is the winner's corrected share of ``n``, within 0 and 1.

What is broadcast has a bound that does not depend on the input: ``PROFILE`` fixes the
number of slots, and at most ``MAX_LANGUAGES`` languages are accepted. Only the sample is
read for fitting; identification is map-only over all rows.

Defined results: a null text or one without a letter (Unicode category L) is ``und`` with
a score of 0, as is every text if nothing was learned; equal texts get equal answers,
whatever their rows; a null language teaches nothing, an empty one is a language like
others; rows that share an id are sampled together; an empty table gives an empty
result; other columns are carried, but for columns named like the results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.llm.common import bounded_batches

UNKNOWN = "und"
LENGTHS = (2, 3, 4)
SAMPLE = 2_000
PROFILE = 20_000
SHARE = 0.02
PROBES = 3
PROBE_SHIFT = 20
MAX_LANGUAGES = 4_096
DRAWS = 1 << 40
STRIP = 1 << 18
# An odd multiplier and the shifts of a 64-bit mixing step.
MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFTS = (np.uint64(32), np.uint64(29))
MARK, LETTER = 1, 2


def slot_bits(profile: int) -> int:
    """Slots for profiles of this size: at least eight per n-gram of a language."""
    return max(10, min(PROBE_SHIFT, (8 * profile - 1).bit_length()))


@lru_cache(maxsize=1)
def letter_kinds() -> np.ndarray:
    """Per code point: letter, combining mark, or neither."""
    kind = {"L": LETTER, "M": MARK}
    return np.fromiter(
        (kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)),
        dtype=np.uint8,
        count=0x110000,
    )


def word_symbols(text: str | None) -> np.ndarray:
    """Code points of the lower-case words, one 0 before, between and after them.

    Empty for a text without a letter.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype="<u4")
    kinds = letter_kinds()[codes]
    if not (kinds == LETTER).any():
        return np.zeros(0, dtype=np.uint32)
    padded = np.zeros(len(codes) + 2, dtype=np.uint32)
    padded[1:-1] = np.where(kinds > 0, codes, 0)
    repeated = (padded[1:] == 0) & (padded[:-1] == 0)
    return padded[np.concatenate([[True], ~repeated])]


def gram_hashes(symbols: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of a few symbols that do not cross a border."""
    wide = symbols.astype(np.uint64)
    inner = symbols != 0
    found = []
    for length in LENGTHS:
        count = len(wide) - length + 1
        if count < 1:
            continue
        total = np.full(count, length, dtype=np.uint64)
        whole = np.ones(count, dtype=bool)
        for k in range(length):
            total = total * MIX + wide[k : k + count]
            total ^= total >> SHIFTS[0]
            if 0 < k < length - 1:
                whole &= inner[k : k + count]
        if length == 2:  # the border between two words stands alone in neither
            whole &= inner[:count] | inner[1 : 1 + count]
        total = total[whole] * MIX
        found.append(total ^ (total >> SHIFTS[1]))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def strips(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """N-gram hashes of a text of any length, a bounded number at a time.

    Strips are cut at borders of words where there are any, so that no n-gram is
    lost or met twice; a longer word overlaps into the next strip by its last symbols.
    """
    begin = 0
    while len(symbols) - begin > STRIP:
        borders = np.flatnonzero(symbols[begin + 1 : begin + STRIP] == 0)
        if len(borders):
            end = begin + 1 + int(borders[-1])
            yield gram_hashes(symbols[begin : end + 1])
        else:
            end = begin + STRIP
            yield from _inside(symbols, begin, end)
        begin = end
    yield gram_hashes(symbols[begin:])


def _inside(symbols: np.ndarray, begin: int, end: int) -> Iterator[np.ndarray]:
    """N-grams that start before ``end`` where no border separates them."""
    reach = max(LENGTHS) - 1
    here = gram_hashes(symbols[begin : end + reach])
    beyond = gram_hashes(symbols[end : end + reach])
    # Those that lie wholly behind ``end`` come again with the next strip.
    values, counts = np.unique(here, return_counts=True)
    places = np.searchsorted(values, beyond)
    np.subtract.at(counts, places, 1)
    yield np.repeat(values, counts)


@dataclass(frozen=True)
class LanguageFilters:
    """The fitted table: a row of language bits per slot, and each slice's fill."""

    languages: tuple[str, ...]
    table: np.ndarray
    false_rate: np.ndarray

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter contains."""
        mask = np.uint64(len(self.table) - 1)
        found = self.table[(grams & mask).astype(np.int64)]
        for probe in range(1, PROBES):
            place = (grams >> np.uint64(probe * PROBE_SHIFT)) & mask
            found = found & self.table[place.astype(np.int64)]
        counts = np.zeros(self.table.shape[1] * 8, dtype=np.int64)
        for column in range(found.shape[1]):
            # A byte holds eight languages: count byte values, then their bits.
            values = np.bincount(found[:, column], minlength=256)
            bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
            counts[column * 8 : column * 8 + 8] = values @ bits
        return counts[: len(self.languages)]

    def corrected(self, hits: np.ndarray, total: int) -> np.ndarray:
        """Counts without the expected number of false positives."""
        return (hits - total * self.false_rate) / (1.0 - self.false_rate)

    def identify(self, text: str | None) -> tuple[str, float]:
        symbols = word_symbols(text)
        if not len(symbols) or not self.languages:
            return UNKNOWN, 0.0
        hits, total = np.zeros(len(self.languages), dtype=np.int64), 0
        for grams in strips(symbols):
            hits += self.hits(grams)
            total += len(grams)
        real = self.corrected(hits, total)
        best = int(np.argmax(real))
        return self.languages[best], float(min(1.0, max(0.0, real[best] / total)))


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` documents of each language, those of the smallest id hashes.

    The share to take follows from each language's count, so nothing is sorted and no
    task sees a language as a whole. A language with fewer documents is taken whole.
    """
    known = docs.filter(F.col("lang").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("lang").alias("size")).limit(MAX_LANGUAGES + 1)
    found = sizes.collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    bounded = docs.sparkSession.createDataFrame(found, sizes.schema)
    draw = F.pmod(F.xxhash64("id"), F.lit(DRAWS)) / DRAWS
    return known.join(F.broadcast(bounded), "lang").filter(draw * F.col("size") < sample)


def gram_documents(docs: DataFrame) -> DataFrame:
    """lang, gram, documents: in how many documents an n-gram occurs, summed per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_language: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = [np.unique(g) for g in strips(word_symbols(text.as_py()))]
                by_language.setdefault(lang, []).append(np.unique(np.concatenate(parts)))
            for lang, lists in by_language.items():
                grams, documents = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(grams), pa.string()),
                        pa.array(grams.view(np.int64)),
                        pa.array(documents.astype(np.int64)),
                    ],
                    names=["lang", "gram", "documents"],
                )

    counts = docs.select("lang", "text").mapInArrow(
        run, "lang string, gram bigint, documents bigint"
    )
    return counts.groupBy("lang", "gram").agg(F.sum("documents").alias("documents"))


def profiles(counts: DataFrame, teachers: DataFrame, size: int, share: float) -> DataFrame:
    """The ``size`` most frequent n-grams of each language, ties by their hash."""
    least = teachers.groupBy("lang").agg((F.count("lang") * share).alias("least"))
    place = Window.partitionBy("lang").orderBy(F.desc("documents"), "gram")
    ranked = counts.withColumn("place", F.row_number().over(place))
    # One row per language, of which there are MAX_LANGUAGES at most.
    return (
        ranked.filter(F.col("place") <= size)
        .join(F.broadcast(least), "lang")
        .filter(F.col("documents") >= F.col("least"))
        .select("lang", "gram")
    )


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample: int = SAMPLE,
    profile: int = PROFILE,
    share: float = SHARE,
) -> LanguageFilters:
    """Filters of all languages in ``docs``; every row given may be learned from."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    teachers = sampled(rows, sample)
    grams = profiles(gram_documents(teachers), teachers, profile, share).persist()
    try:
        languages = sorted(row["lang"] for row in grams.select("lang").distinct().collect())
        return _build(grams, languages, slot_bits(profile))
    finally:
        grams.unpersist()


def _build(grams: DataFrame, languages: list[str], bits: int) -> LanguageFilters:
    """Bits are set by slot in Spark; the driver receives rows of the finished table."""
    slots, width = 1 << bits, max(1, -(-len(languages) // 8))
    spark = grams.sparkSession
    numbers = spark.createDataFrame(list(enumerate(languages)), "number int, lang string")

    def slot(probe: int) -> Column:
        place = F.shiftrightunsigned("gram", probe * PROBE_SHIFT)
        return place.bitwiseAND(F.lit(slots - 1)).cast("int")

    places = F.explode(F.array(*[slot(probe) for probe in range(PROBES)])).alias("slot")
    cells = (
        grams.join(F.broadcast(numbers), "lang")
        .select("number", places)
        .groupBy("slot", F.expr("number div 8").alias("part"))
        .agg(F.bit_or(F.expr("shiftleft(1, number % 8)")).alias("bits"))
        .collect()
    )
    table = np.zeros((slots, width), dtype=np.uint8)
    for slot_number, part, value in cells:
        table[slot_number, part] = value
    fill = np.unpackbits(table, axis=1, bitorder="little").mean(axis=0)[: len(languages)]
    return LanguageFilters(tuple(languages), table, fill**PROBES)


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` instead of the text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(filters)
    results = ("lang_pred", "score")
    carried = [f for f in docs.schema.fields if f.name not in (*results, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            answers = [own.identify(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([name for name, _ in answers], pa.string()),
                    pa.array([score for _, score in answers], pa.float64()),
                ],
                names=[*[f.name for f in carried], *results],
            )

    schema = T.StructType(
        [*carried, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return docs.select(*[f.name for f in carried], text_col).mapInArrow(run, schema)
