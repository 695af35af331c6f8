"""Token counts of sections: whole documents are encoded once, spans are attributed.

A section encoded by itself has other tokens than the same characters inside the
document. So each document is encoded whole; every token keeps its character span;
sections, given as character intervals, are joined to those spans by bisection, since
both are ordered within a document. A token that crosses a border goes by the rule:

* ``first``: to the section that holds its first character,
* ``last``: to the one that holds its last character,
* ``share``: to each in proportion to its characters there (fractions).

Sections may overlap or leave gaps; a token counts in every section that the rule
gives it. Documents are independent rows, so nothing is shuffled.

Defined results: a null text is empty and has no tokens; every section gives a row,
empty ones with 0; without given sections they are the lines, newline included, and an
empty text is one empty line; null sections give no rows; repeated rows are counted
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.llm.bpe import Encoder, encoder, read_definition
from lagline.llm.common import bounded_batches

RULES = ("first", "last", "share")
SPANS = "array<struct<begin: int, end: int>>"


def token_spans(own: Encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character of every token.

    Byte tokens may cut a character; both parts then have that character.
    """
    ids = np.frombuffer(own.encode(text), dtype="<u4").astype(np.int64)
    ends = np.cumsum(own.starts[ids + 1] - own.starts[ids])
    begins = ends - (own.starts[ids + 1] - own.starts[ids])
    if text.isascii() or not len(ids):
        return begins, ends
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[begins], character[ends - 1] + 1


def line_spans(text: str) -> list[tuple[int, int]]:
    begins = [0]
    at = text.find("\n")
    while at >= 0:
        begins.append(at + 1)
        at = text.find("\n", at + 1)
    if len(begins) > 1 and begins[-1] == len(text):
        begins.pop()
    return list(zip(begins, [*begins[1:], len(text)]))


def counts_of(
    begins: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str
) -> np.ndarray:
    """Tokens per section, sections as rows of (begin, end)."""
    low, high = sections[:, 0], sections[:, 1]
    if rule == "first":
        return np.maximum(0, np.searchsorted(begins, high) - np.searchsorted(begins, low)).astype(float)
    if rule == "last":
        last = ends - 1
        return np.maximum(0, np.searchsorted(last, high) - np.searchsorted(last, low)).astype(float)
    # Tokens up to a character, the one around it in proportion; overlapping spans of
    # a cut character are summed one by one.
    total = np.zeros(len(sections))
    width = np.maximum(ends - begins, 1)
    first, after = np.searchsorted(ends, low, "right"), np.searchsorted(begins, high)
    for i, (a, b) in enumerate(sections):
        s = slice(first[i], after[i])
        total[i] = (np.clip(np.minimum(ends[s], b) - np.maximum(begins[s], a), 0, None) / width[s]).sum()
    return total


def section_token_counts(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "first",
) -> DataFrame:
    """One row per document and section: id, section (from 0), begin, end, n_tokens, doc_tokens.

    ``sections_col`` names an array of (begin, end); ``vocabulary`` is the path of a
    byte-level BPE definition whose tokens cover the text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    bounded_batches(spark)
    definition = spark.sparkContext.broadcast(read_definition(vocabulary))
    wanted = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")]
    if sections_col is not None:
        wanted.append(F.col(f"`{sections_col}`").cast(SPANS).alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(definition.value)
        for batch in batches:
            rows, number, low, high, counts, totals = [], [], [], [], [], []
            given = batch.column(2) if sections_col is not None else None
            for at, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                spans = (
                    line_spans(text)
                    if given is None
                    else [(s["begin"], s["end"]) for s in given[at].as_py() or [] if s]
                )
                if not spans:
                    continue
                sections = np.array(spans, dtype=np.int64)
                begins, ends = token_spans(own, text)
                rows.append(np.full(len(sections), at))
                number.append(np.arange(len(sections)))
                low.append(sections[:, 0])
                high.append(sections[:, 1])
                counts.append(counts_of(begins, ends, sections, rule))
                totals.append(np.full(len(sections), len(begins)))
            if not rows:
                continue
            join = np.concatenate
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(join(rows))),
                    pa.array(join(number).astype(np.int32)),
                    pa.array(join(low)),
                    pa.array(join(high)),
                    pa.array(join(counts)),
                    pa.array(join(totals)),
                ],
                names=["id", "section", "begin", "end", "n_tokens", "doc_tokens"],
            )

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("section", T.IntegerType()),
            T.StructField("begin", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("n_tokens", T.DoubleType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )
    return docs.select(*wanted).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_sections(docs: DataFrame, sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with an array column ``sections`` from a table of (id, begin, end).

    The array of a document is in order of begin and end; its size is bounded by the
    document, not by the table.
    """
    spans = sections.groupBy(F.col(f"`{id_col}`").alias(id_col)).agg(
        F.sort_array(F.collect_list(F.struct("begin", "end"))).cast(SPANS).alias("sections")
    )
    return docs.drop("sections").join(spans, id_col, "left")
