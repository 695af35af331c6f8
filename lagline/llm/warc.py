"""WARC revisit records resolved to the response that they confirm.

A crawler that gets "304 Not Modified" stores a revisit record without a body. Its
content is that of the latest earlier full response for the same address. This is an
as-of join by canonical URL; the validators of both sides are then compared, and the
header fields that a 304 may update replace those of the stored response.

One address may hold a large share of all records. The join therefore never gathers
an address: records are put into time slots of an address; a window over the slots
(one row each) hands the last response of earlier slots on, and a window inside a slot
does the rest. Bodies do not take part; only the number of the found response does, and
its headers are fetched by that number.

Defined results: a null address or time matches nothing (``unresolved``); a response at
the same time is not earlier; of responses at one time the largest record id counts;
a response whose body is null or whose status is not 200 is not full; rows that repeat
a response's id count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields of a stored response that a 304 may not replace.
BODY_FIELDS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
SLOT_SECONDS = 3_600
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def canonical_url(url: Column) -> Column:
    """Address without scheme, ``www.``, default port, fragment, tracking fields, last slash."""
    bare = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)
    host = F.translate(host, UPPER, UPPER.lower())
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|gclid|fbclid)=[^&]*", "$1")
    rest = F.regexp_replace(rest, r"&+", "&")
    rest = F.regexp_replace(rest, r"\?&", "?")
    rest = F.regexp_replace(rest, r"[?&]+$", "")
    rest = F.regexp_replace(rest, r"/$", "")
    return F.when(host != "", F.concat(host, rest))


def parse_headers(block: Column) -> Column:
    """HTTP header block to a map; names in lower case, of repeated names the last one."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike(r"^[^:\x00-\x20]+:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"),
            F.regexp_extract(x, r"^[^:]+:[\t ]*(.*?)[\t ]*$", 1).alias("value"),
        ),
    )
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == p["key"]
        ),
    )
    return F.map_from_entries(last)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers, replaced and added to by the fields that a 304 may carry."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*BODY_FIELDS))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def latest_before(records: DataFrame, slot_seconds: int) -> DataFrame:
    """(revisit_id, response_id) from (record_id, url, at, full, revisit); null if none."""
    slots = records.filter(F.col("url").isNotNull() & F.col("at").isNotNull()).withColumn(
        "slot", F.floor(F.unix_micros("at") / F.lit(slot_seconds * 1_000_000))
    )
    response = F.when(F.col("full"), F.struct("at", "record_id"))
    # Per slot its last response, then of all slots before; combined in the map tasks.
    per_slot = slots.groupBy("url", "slot").agg(F.max(response).alias("last"))
    before = Window.partitionBy("url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slot.select("url", "slot", F.max("last").over(before).alias("carried"))
    # Strictly earlier: the frame ends one microsecond before the row's own time.
    inside = (
        Window.partitionBy("url", "slot")
        .orderBy(F.unix_micros("at"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    own = slots.withColumn("own", F.max(response).over(inside)).filter("revisit")
    return own.join(carried, ["url", "slot"]).select(
        F.col("record_id").alias("revisit_id"),
        F.coalesce("own.record_id", "carried.record_id").alias("response_id"),
    )


def resolve_revisits(records: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row per revisit record with outcome, response and merged headers.

    ``records``: record_id, kind (``response`` or ``revisit``), target_uri, captured
    (timestamp), status, headers (map with lower-case names), payload_sha256 (null
    without a body). ``outcome``: ``confirmed`` if the entity tags agree or, where one
    side has none, the modification dates; ``changed`` if they differ;
    ``unvalidated`` if there is nothing to compare; ``unresolved`` without a response.
    """
    rows = records.select(
        "record_id",
        canonical_url(F.col("target_uri")).alias("url"),
        F.col("captured").alias("at"),
        ((F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload_sha256").isNotNull())
        .eqNullSafe(F.lit(True))
        .alias("full"),
        (F.col("kind") == "revisit").eqNullSafe(F.lit(True)).alias("revisit"),
    )
    links = latest_before(rows, slot_seconds)
    revisits = records.filter("kind = 'revisit'").select(
        F.col("record_id").alias("revisit_id"),
        "target_uri",
        canonical_url(F.col("target_uri")).alias("canonical_url"),
        "captured",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("update"),
    )
    responses = (
        records.filter("kind = 'response'")
        .select(
            F.col("record_id").alias("response_id"),
            F.col("captured").alias("response_captured"),
            F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("stored"),
            "payload_sha256",
        )
        .dropDuplicates(["response_id"])
    )
    joined = revisits.join(links.dropDuplicates(["revisit_id"]), "revisit_id", "left").join(
        responses, "response_id", "left"
    )
    tag, old_tag = _weak(F.col("update")["etag"]), _weak(F.col("stored")["etag"])
    date, old_date = F.col("update")["last-modified"], F.col("stored")["last-modified"]
    outcome = (
        F.when(F.col("stored").isNull(), "unresolved")
        .when(tag.isNotNull() & old_tag.isNotNull(), F.when(tag == old_tag, "confirmed").otherwise("changed"))
        .when(date.isNotNull() & old_date.isNotNull(), F.when(date == old_date, "confirmed").otherwise("changed"))
        .otherwise("unvalidated")
    )
    good = F.col("outcome").isin("confirmed", "unvalidated")
    return joined.withColumn("outcome", outcome).select(
        F.col("revisit_id").alias("record_id"),
        "target_uri",
        "canonical_url",
        "captured",
        "outcome",
        "response_id",
        "response_captured",
        F.when(good, F.col("payload_sha256")).alias("payload_sha256"),
        F.when(good, merged_headers(F.col("stored"), F.col("update"))).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """Headers as lines in order of their names."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
