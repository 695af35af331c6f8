"""Registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagline.llm import (
    bpe,
    conversation_trie,
    exact_dedup,
    hard_negatives,
    langid,
    minhash,
    mixing,
    quality_rules,
    sharding,
    suffix_dedup,
    token_counts,
    url_filters,
    warc,
)
from lagline.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]


WORD_VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))

# Target weights of the mixture, by path from the domain down.
MIXTURE = {
    ("web",): 4.0,
    ("books",): 3.0,
    ("code",): 2.0,
    ("forums",): 1.0,
    ("web", "en"): 5.0,
    ("web", "fr"): 2.0,
    ("books", "en"): 4.0,
    ("forums", "en"): 3.0,
    ("web", "en", "src0"): 2.0,
}
WEB_SOURCES, BOOK_SOURCES, CODE_SOURCES = 8, 13, 17

# Fixed value: of so many documents one, by the checksum of its id, teaches nothing.
HELD_OUT_EVERY = 5

# Every seventh row gets the next of ten labels, every hundredth is an anchor.
RELABELLED, LABELS, ANCHOR_EVERY = 7, 10, 100

# The derived crawl starts here; a page a minute, visited again a day later.
CRAWL_START = "2024-01-01 00:00:00"
PAGE_SECONDS = 60
REVISIT_SECONDS = 86_430


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; counts and digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, WORD_VOCABULARY).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition statistics of every document and the line-first verdict."""
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; of each the largest id stays."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, encoded once as a whole."""
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier one holds in a string of 50 bytes."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards with the source mixture of the whole table, row counts one apart at most."""
    placed = sharding.proportional_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def domain_of(source: Column) -> Column:
    """Domain by the number in a source's name: web, books, code, forums."""
    number = F.regexp_extract(source, r"^src([0-9]{1,9})$", 1)
    n = F.when(number != "", number.cast("int"))
    return (
        F.when(n < WEB_SOURCES, "web")
        .when(n < BOOK_SOURCES, "books")
        .when(n < CODE_SOURCES, "code")
        .otherwise("forums")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` mixed to MIXTURE, as many tokens as before."""
    levels = {
        "domain": domain_of(F.col("source")),
        "lang": F.col("lang"),
        "source": F.col("source"),
    }
    return mixing.mix(docs, MIXTURE, levels)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their number of copies in the mixture."""
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "copy")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl of the pages: of each a full response, and a revisit a day later.

    Validators come from the page's content, so a revisit is confirmed where the
    latest earlier response of its address had that content.
    """
    start = F.unix_timestamp(F.lit(CRAWL_START).cast("timestamp"))
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    seconds = F.col("page_id") * PAGE_SECONDS
    digest = F.sha2("html", 256)

    def record(kind: str, delay: int, number: int, block: Column, body: Column) -> DataFrame:
        return pages.select(
            (F.col("page_id") * 2 + number).alias("record_id"),
            F.lit(kind).alias("kind"),
            F.col("url").alias("target_uri"),
            F.timestamp_seconds(start + seconds + delay).alias("captured"),
            F.lit(200 if kind == "response" else 304).alias("status"),
            warc.parse_headers(block).alias("headers"),
            body.alias("payload_sha256"),
        )

    full = F.concat_ws(
        "\r\n",
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length("html").cast("string")),
        F.concat(F.lit("ETag: "), tag),
        F.concat(F.lit("Date: "), seconds.cast("string")),
        F.lit("Cache-Control: max-age=60"),
    )
    unchanged = F.concat_ws(
        "\r\n",
        F.lit("Content-Length: 0"),
        F.concat(F.lit("ETag: W/"), tag),
        F.concat(F.lit("Date: "), (seconds + REVISIT_SECONDS).cast("string")),
        F.lit("Cache-Control: max-age=600"),
        F.lit("Vary: Accept-Encoding"),
    )
    return record("response", 0, 0, full, digest).unionByName(
        record("revisit", REVISIT_SECONDS, 1, unchanged, F.lit(None).cast("string"))
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of the crawl with the response they refer to and the merged headers."""
    records = stored(crawl_records(table(spark, sf_dir, "pages")), "warc-records")
    resolved = warc.resolve_revisits(records)
    return resolved.select(
        "record_id",
        "canonical_url",
        "outcome",
        "response_id",
        "payload_sha256",
        warc.header_text(F.col("headers")).alias("headers"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page address."""
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_EVERY
    filters = langid.fit(docs.filter(remainder != 0))
    held_out = F.coalesce(remainder == 0, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", held_out, "text"), filters)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations with the totals of its subtree."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all of them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS)
    scaled = hard_negatives.scaled_rows(rows, moved.otherwise(F.col("label")))
    return hard_negatives.hard_negatives(scaled, F.col("vec_id") % ANCHOR_EVERY == 0)


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_minhash": op8_minhash,
    "op9_warc": op9_warc,
    "op10_url_filters": op10_url_filters,
    "op11_language_id": op11_language_id,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
