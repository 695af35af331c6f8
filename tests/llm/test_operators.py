"""Every operator against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lagline.llm import (
    bpe,
    exact_dedup,
    induced_sort,
    minhash,
    mixing,
    quality_rules,
    queries,
    sharding,
    suffix_dedup,
    token_counts,
    url_filters,
    warc,
)
from lagline.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards pack boxes of liquor jugs".split()


def prose(seed: int, words: int) -> str:
    source = random.Random(seed)
    return " ".join(f"{source.choice(WORDS)}{source.randint(0, 99)}" for _ in range(words)) + "."


def odd_rows() -> list[tuple]:
    long_text = prose(7, 6000)
    texts = [
        (1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, prose(1, 60)), (6, prose(1, 60)),
        (7, prose(2, 80)), (7, prose(2, 80)), (8, long_text), (9, long_text + " more words at its end."),
        (10, "É" * 60 + " ß€😀 " + "é" * 60), (11, "x" * 500), (12, "x" * 300), (None, prose(1, 60)),
        (None, None), (13, "one two three four"), (14, "\n".join([prose(3, 30)] * 3)),
    ]
    return [(i, t, "en", None if i == 5 else f"src{(i or 0) % 3}", len(t or ""), 1, "y", 2) for i, t in texts]


SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "length int, body string, slot int"
)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated ids and rows, columns with clashing names."""
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")


# BPE


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{public_tokenizers.path(name)}"
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.read_definition(path))
    source = random.Random(5)
    samples = [r[1] or "" for r in odd_rows()]
    pieces = [*WORDS, "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "Σ", "İ", "é", "e\u0301", "1", "²", "\x1c", "\u3000", "😀", "\n\n", "  "]
    samples += ["".join(source.choice(pieces) for _ in range(source.randint(1, 12))) for _ in range(1500)]
    samples += [source.choice("aeot") * source.randint(1, 80) + source.choice("ab") for _ in range(300)]
    for text in samples:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert own.decode([packed]) == [library.decode(ids, skip_special_tokens=False)]


def test_a_token_pair_is_compatible_when_merging_leaves_it():
    own = bpe.Encoder(bpe.read_definition(queries.BYTE_VOCABULARY))
    tokens = {i: own.block[own.starts[i] : own.starts[i + 1]].tobytes().decode("latin-1") for i in range(2000)}
    source = random.Random(2)
    for _ in range(2000):
        a, b = source.choice(list(tokens)), source.choice(list(tokens))
        assert own.may_follow(a, b) == (own.encode_symbols(tokens[a] + tokens[b]) == [a, b])


def test_op1_on_odd_rows(odd, empty):
    ids = bpe.encode(odd.withColumn("ids", F.lit("clash")), queries.WORD_VOCABULARY)
    rows = bpe.decode(ids, queries.WORD_VOCABULARY).collect()
    assert len(rows) == len(odd_rows())
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and r["length"] == 1 for r in rows)
    assert bpe.decode(bpe.encode(empty, queries.WORD_VOCABULARY), queries.WORD_VOCABULARY).count() == 0


# Quality rules


def brute_statistics(text: str | None) -> tuple:
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered),
    )


def test_op2_statistics(odd, empty, small_docs):
    frames = [odd.select("doc_id", "text"), small_docs]
    for frame in frames:
        texts = frame.collect()
        expected = Counter((r["doc_id"], *brute_statistics(r["text"])) for r in texts)
        columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        found = quality_rules.judged(frame).select(*columns).collect()
        assert Counter(tuple(r) for r in found) == expected
    assert quality_rules.judged(empty).count() == 0


@pytest.mark.parametrize(
    ("line", "failed"),
    [
        ("A plain sentence.", None),
        ("An early end. and a cut", None),
        ("no end at all", "punctuation"),
        ("Home | About | News | Contact |", "navigation"),
        ("All rights reserved.", "boilerplate"),
        ("It&&& is%%% noise### here.", "punctuation"),
        ("ALL!! SHOUTED!! HERE!!", "punctuation"),
        ("  \t", None),
        ("", None),
    ],
)
def test_line_rules(spark, line, failed):
    frame = spark.createDataFrame([(line,)], "line string")
    assert frame.select(quality_rules.failed_rule(F.col("line"))).first()[0] == failed


def test_cleaning_takes_lines_out_and_rejects_what_loses_too_much(spark):
    good = "\n".join(prose(i, 12) for i in range(4))
    docs = spark.createDataFrame(
        [(1, good + "\nAll rights reserved."), (2, "a | b | c | d | e |\n" * 9 + prose(9, 12))],
        "doc_id long, text string",
    )
    assert [tuple(r) for r in quality_rules.clean(docs).collect()] == [(1, good)]


# Exact dedup


def test_op3_against_brute_force(odd, empty, small_docs):
    for frame in (odd.select("doc_id", "text"), small_docs):
        groups = defaultdict(list)
        rows = frame.collect()
        for r in rows:
            groups[r["text"] or ""].append(r["doc_id"])
        expected = Counter()
        for r in rows:
            ids = groups[r["text"] or ""]
            keep = max((i for i in ids if i is not None), default=None)
            digest = hashlib.sha256((r["text"] or "").encode()).hexdigest()
            expected[r["doc_id"], keep, len(ids), r["doc_id"] == keep, digest] += 1
        for options in ({}, {"slot_bits": 2}, {"prefix_chars": 1}):
            found = exact_dedup.exact_dedup(frame, **options).collect()
            assert Counter(tuple(r) for r in found) == expected
        kept = exact_dedup.survivors(frame)
        assert kept.count() == len(groups) and kept.columns == frame.columns
        assert {r["text"] or "" for r in kept.collect()} == set(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.survivors(empty).count() == 0


def test_op3_hot_group(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"),
    )
    assert exact_dedup.survivors(docs).count() == 2001
    assert exact_dedup.exact_dedup(docs).filter("group_size = 1000 AND keep_id = 2997").count() == 1000


# Token counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_op4_against_library_offsets(odd, rule):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.BYTE_VOCABULARY)
    texts = odd.select("doc_id", "text").filter("doc_id in (2, 4, 5, 10, 14)")
    found = token_counts.section_token_counts(texts, queries.BYTE_VOCABULARY, rule=rule)
    sums = {r["doc_id"]: (r["s"], r["t"]) for r in found.groupBy("doc_id").agg(
        F.sum("n_tokens").alias("s"), F.max("doc_tokens").alias("t")).collect()}
    for r in texts.collect():
        encoded = library.encode(r["text"] or "", add_special_tokens=False)
        assert sums[r["doc_id"]][1] == len(encoded.ids)
        # Lines cover the text, so whole tokens are given out once each.
        if rule != "share" or (r["text"] or "").isascii():
            assert sums[r["doc_id"]][0] == pytest.approx(len(encoded.ids))
    own = bpe.Encoder(bpe.read_definition(queries.BYTE_VOCABULARY))
    text = prose(4, 50)
    begins, ends = token_counts.token_spans(own, text)
    # The library trims leading spaces from offsets, so ends are compared.
    assert [e for _, e in library.encode(text, add_special_tokens=False).offsets] == ends.tolist()
    assert begins[0] == 0 and (begins[1:] == ends[:-1]).all()


def test_op4_border_rules_and_sections(spark, empty):
    begins, ends = np.array([0, 4, 6]), np.array([4, 6, 9])
    sections = np.array([[0, 5], [5, 9], [2, 2], [0, 9]])
    counts = {r: token_counts.counts_of(begins, ends, sections, r).tolist() for r in token_counts.RULES}
    assert counts == {"first": [2, 1, 0, 3], "last": [1, 2, 0, 3], "share": [1.5, 1.5, 0, 3]}
    docs = spark.createDataFrame([(1, "ab cd\nef", 0), (2, None, 0)], "doc_id long, text string, sections int")
    given = spark.createDataFrame([(1, 0, 5), (1, 6, 8), (2, 0, 0)], "doc_id long, begin int, end int")
    rows = token_counts.section_token_counts(
        token_counts.with_sections(docs, given), queries.BYTE_VOCABULARY, sections_col="sections"
    ).orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["begin"], r["end"]) for r in rows] == [(1, 0, 5), (1, 6, 8), (2, 0, 0)]
    assert token_counts.section_token_counts(empty, queries.BYTE_VOCABULARY).count() == 0
    assert token_counts.line_spans("a\n\nb\n") == [(0, 2), (2, 3), (3, 5)]


# Suffix sorting and repeated bytes


@pytest.mark.parametrize("memory", [600, 1 << 20])
def test_induced_sort_gives_order_and_prefixes(tmp_path, memory):
    source = random.Random(memory)
    for _ in range(150):
        letters = source.choice([1, 2, 3, 20, 256])
        text = bytes(source.randrange(letters) for _ in range(source.randint(1, 150)))
        if source.random() < 0.4:
            text = (text[:30] * 20)[: len(text) + 60]
        parts = list(induced_sort.suffix_order(np.frombuffer(text, np.uint8), str(tmp_path), memory))
        order = np.concatenate([p for p, _ in parts]).tolist()
        shared = np.concatenate([s for _, s in parts]).tolist()
        heads = [text[p : p + 50] for p in order]
        assert sorted(order) == list(range(len(text))) and heads == sorted(heads)
        for a, b, length in zip(heads, heads[1:], shared[1:]):
            common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common == length


def brute_repeats(rows: list[tuple]) -> Counter:
    first: dict[bytes, int] = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - 49):
                window = raw[i : i + 50]
                first[window] = min(first.get(window, doc), doc)
    out = Counter()
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if doc is not None and first[raw[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc, len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest()] += 1
    return out


def test_op5_against_brute_force(odd, empty, small_docs):
    for frame in (odd.select("doc_id", "text"), small_docs.limit(120)):
        rows = [tuple(r) for r in frame.collect()]
        fixed = frame.sparkSession.createDataFrame(rows, "doc_id long, text string")
        found = suffix_dedup.remove_repeats(fixed).drop("kept").collect()
        assert Counter(tuple(r) for r in found) == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("copy_ids", [1 << 20, 0])
def test_op5_copies_lose_everything(spark, monkeypatch, copy_ids):
    monkeypatch.setattr(suffix_dedup, "COPY_IDS", copy_ids)
    long, other, short = prose(1, 60), prose(2, 60), prose(3, 4)[:49]
    rows = [(doc, long) for doc in (9, 5, 7, 5, None, -(1 << 63))] + [
        (20, long), (20, long), (25, other), (30, other), (31, other[:200] + long[:200]),
        # Copies shorter than a window, empty and null texts lose nothing.
        (40, short), (41, short), (42, ""), (43, ""), (44, None), (None, other), (50, prose(4, 60)),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.remove_repeats(frame).drop("kept").collect()
    assert Counter(tuple(r) for r in found) == brute_repeats(rows)
    copies = {r["id"] for r in suffix_dedup.copied_ids(frame).collect()}
    assert copies == {5, 7, 9, 20, 30}
    # An id that also has a text of its own is no copy.
    mixed = frame.union(spark.createDataFrame([(20, other + long)], frame.schema))
    assert {r["id"] for r in suffix_dedup.copied_ids(mixed).collect()} == {5, 7, 9, 30}


def test_op5_marks_survive_the_way(tmp_path):
    numbers = np.sort(np.random.default_rng(1).integers(0, 1 << 28, 5000, dtype=np.uint32))
    for part in (numbers, numbers[:1], np.repeat(numbers[-3:], 2)):
        assert (suffix_dedup._from_planes(suffix_dedup._as_planes(part)) == part).all()


def shard_files(folder, blocks: list[bytes], places: list[list[tuple[int, int]]]) -> None:
    """One shard's files as a task of ``repeated_windows`` lays them down."""
    flat = [p for own in places for p in own]
    (folder / "0.text").write_bytes(b"".join(blocks))
    for name, values, kind in (
        ("lengths", [len(b) for b in blocks], "i4"),
        ("counts", [len(p) for p in places], "i4"),
        ("ids", [d for d, _ in flat], "i8"),
        ("starts", [s for _, s in flat], "i4"),
    ):
        np.array(values, dtype=kind).tofile(folder / f"0.{name}")


def lost_windows(runs) -> set:
    return {
        (d, s + k)
        for ids, starts, counts in runs
        for d, s, n in zip(ids.tolist(), starts.tolist(), counts.tolist())
        for k in range(n)
    }


def test_op5_shard_in_pieces_against_brute_force(tmp_path, monkeypatch):
    source = random.Random(4)
    passage = bytes(source.choices(b"abcdef", k=40))
    blocks, places = [], []
    for doc in range(400):
        inner = passage if doc % 3 else bytes(source.choices(b"ab", k=9)) + passage
        text = bytes(source.choices(b"xy", k=source.choice((3, 12)))) + inner + bytes(source.choices(b"z", k=source.randint(20, 30)))
        text = text if doc % 7 else b"q" * 70
        anchors = suffix_dedup.window_anchors(np.frombuffer(text, dtype=np.uint8))
        cuts = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), len(anchors)]
        for begin, end in zip(cuts, cuts[1:]):
            blocks.append(text[begin : end + 49])
            places.append([(d, begin) for d in range(1000 - doc, 1001 - doc + doc % 4 * 700, 700)])
    shard_files(tmp_path, blocks, places)
    least: dict[bytes, int] = {}
    every = [(d, s + k, b[k : k + 50]) for b, p in zip(blocks, places) for d, s in p for k in range(len(b) - 49)]
    for doc, _, window in every:
        least[window] = min(doc, least.get(window, doc))
    expected = {(d, at) for d, at, window in every if least[window] < d}
    assert expected and lost_windows(suffix_dedup._lost_runs(str(tmp_path), 0)) == expected
    for name, value in (("CUT_BYTES", 1), ("PIECE_WINDOWS", 64), ("STEP_BYTES", 500), ("STEP_PLACES", 7)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert lost_windows(suffix_dedup._lost_runs(str(tmp_path), 0)) == expected


def test_op5_memory_does_not_follow_the_shard(tmp_path):
    # A hot anchor: every document has other bytes around the same passage.
    count, passage = 200_000, prose(9, 30).encode()[:66]
    source = np.random.default_rng(5)
    around = source.integers(97, 123, (count, 18), dtype=np.uint8)
    text = np.concatenate([around, np.tile(np.frombuffer(passage, dtype=np.uint8), (count, 1))], axis=1)
    text.tofile(tmp_path / "0.text")
    for name, values, kind in (
        ("lengths", np.full(count, 84), "i4"), ("counts", np.ones(count), "i4"),
        ("ids", np.arange(count), "i8"), ("starts", np.zeros(count), "i4"),
    ):
        values.astype(kind).tofile(tmp_path / f"0.{name}")
    tracemalloc.start()
    # The 17 windows within the passage are those of document 0.
    lost = sum(int(c[(c >= 17)].sum() // 17) for _, _, c in suffix_dedup._lost_runs(str(tmp_path), 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lost >= count - 1 and peak < 200 << 20


# Sharding


def test_op6_law_mixture_and_slots(odd, empty, small_docs, spark):
    docs = spark.range(1003).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("t"), F.col("id")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
    )
    for frame in (odd, docs, docs.repartition(7)):
        rows = sharding.proportional_shards(frame).collect()
        counts = Counter(r["shard"] for r in rows)
        assert len(rows) == frame.count() and max(counts.values()) - min(counts.values()) <= 1
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_source = Counter((r["source"], r["shard"]) for r in rows)
    for source in {s for s, _ in by_source}:
        shares = [by_source[source, k] for k in range(8)]
        # Each source's rows are spaced evenly, so a cut splits at most one spacing at each end.
        assert max(shares) - min(shares) <= 2
    first = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.proportional_shards(docs).collect()}
    assert first == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    checks = {r["doc_id"]: r["text_crc32"] for r in sharding.proportional_shards(odd).collect()}
    assert checks[10] == zlib.crc32(odd_rows()[10][1].encode()) and checks[1] == 0
    assert sharding.proportional_shards(empty).count() == 0


# Mixing


def brute_budgets(tree: dict, weights: dict, total: float, epochs: int) -> dict:
    def capacity(node, path=()):
        if not isinstance(node, dict):
            return node * epochs
        return sum(capacity(c, (*path, k)) for k, c in node.items() if weights.get((*path, k), 1) > 0)

    out = {}

    def down(node, path, budget):
        if not isinstance(node, dict):
            out[path] = budget
            return
        left = {k: weights.get((*path, k), 1.0) for k in node if weights.get((*path, k), 1.0) > 0}
        given = {}
        while left:
            rate = budget / sum(left.values())
            full = [k for k in left if capacity(node[k], (*path, k)) <= rate * left[k] + 1e-9]
            if not full:
                given |= {k: rate * w for k, w in left.items()}
                break
            for k in full:
                given[k] = capacity(node[k], (*path, k))
                budget -= given[k]
                del left[k]
        for k, b in given.items():
            down(node[k], (*path, k), b)

    down(tree, (), min(total, capacity(tree)))
    return out


def test_op7_budgets_redistribute_among_siblings_first(spark):
    tree = {"a": {"x": {"1": 100, "2": 900}, "y": {"3": 50}}, "b": {"x": {"4": 2000}, "z": {"5": 10, "6": 0}}, "c": {"x": {"7": 5}}}
    weights = {("a",): 3.0, ("a", "y"): 5.0, ("b", "z"): 2.0, ("a", "x", "1"): 4.0, ("c",): 0.0}
    rows = [(f"={d}", f"={g}", f"={s}", n) for d, v in tree.items() for g, u in v.items() for s, n in u.items()]
    supply = spark.createDataFrame(rows, "d string, l string, s string, supply long")
    for total in (100.0, 1500.0, 4000.0, 1e9):
        found = mixing.leaf_budgets(supply, ["d", "l", "s"], weights, total, 2).collect()
        expected = {k: v for k, v in brute_budgets(tree, weights, total, 2).items()}
        assert {(r["d"][1:], r["l"][1:], r["s"][1:]): pytest.approx(r["budget"], abs=0.01) for r in found} == expected


def test_op7_rows_follow_the_budgets(spark, odd, empty):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"),
        F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 100, "tiny").otherwise("mid").alias("source"),
        F.lit("d").alias("domain"),
        F.lit("clash").alias("copy"),
    )
    mixed = mixing.mix(docs, {("d", "en", "tiny"): 1.0, ("d", "en", "hot"): 2.0}, total_tokens=6000.0, max_epochs=3)
    measured = mixed.withColumn("n", mixing.n_words()).groupBy("source").agg(F.sum("n").alias("n"), F.max("copy").alias("c"))
    found = {r["source"]: (r["n"], r["c"]) for r in measured.collect()}
    supply = {r["source"]: r["n"] for r in docs.withColumn("n", mixing.n_words()).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    tiny = supply["tiny"] * 3
    rest = 6000 - tiny
    assert found["tiny"] == (tiny, 2)
    assert rest * 2 / 3 - 8 <= found["hot"][0] <= rest * 2 / 3 and rest / 3 - 8 <= found["mid"][0] <= rest / 3
    repeats = mixed.groupBy("doc_id", "copy").count().filter("count > 1")
    assert repeats.count() == 0 and mixed.columns[:5] == docs.columns[:5]
    again = mixing.mix(docs.repartition(5), {("d", "en", "tiny"): 1.0, ("d", "en", "hot"): 2.0}, total_tokens=6000.0, max_epochs=3)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, mixed.collect()))
    assert queries.mixed(odd).columns == [*odd.columns, "copy"]
    assert queries.mixed(empty).count() == 0


# Near duplicates


def near_copy(text: str, seed: int, edits: int) -> str:
    words, source = text.split(" "), random.Random(seed)
    for _ in range(edits):
        words[source.randrange(len(words))] = f"edit{source.randint(0, 10**9)}"
    return " ".join(words)


def brute_classes(rows: dict[int, str], idf: np.ndarray) -> dict[int, int]:
    sets = {i: minhash.weighted(minhash.split_words(t), idf) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a][0]) and root(a) != root(b) and minhash.similarity(sets[a], sets[b]) >= 0.8 - 1e-6:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in rows}


def test_op8_against_all_pairs(spark, small_docs):
    base = [prose(100 + i, 150) for i in range(4)]
    texts = [near_copy(base[i % 4], i, i % 6) for i in range(120)] + [prose(500 + i, 40) for i in range(30)]
    texts += ["one two", "one two", "", "  ", "one two three"]
    for frame in (
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        small_docs,
    ):
        rows = {r["doc_id"]: r["text"] for r in frame.collect()}
        frequencies = minhash.document_frequencies(frame)
        idf = minhash.damped_idf(frequencies, len(rows))
        found = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(frame).collect()}
        assert found == brute_classes(rows, idf)


def test_op8_near_copies_of_a_text_in_a_third_of_the_rows(spark):
    hot = prose(77, 404).split(" ")
    copies = []
    for first in (20, 30):
        words = list(hot)
        # Eight words far apart: 360 of 400 shingles stay, a plain similarity of 0.818.
        for k in range(8):
            words[first + 45 * k] = f"edit{first}x{k}"
        copies.append(" ".join(words))
    texts = [" ".join(hot)] * 100 + copies + [prose(1000 + i, 60) for i in range(200)]
    sets = [{tuple(t.split(" ")[k : k + 5]) for k in range(len(t.split(" ")) - 4)} for t in (texts[0], *copies)]
    assert 0.8 <= minhash.plain_bound(0.8) < 0.804
    assert all(0.804 <= len(sets[0] & s) / len(sets[0] | s) < 0.83 for s in sets[1:])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(frame).collect()}
    assert {found[i] for i in range(102)} == {0}
    assert all(found[i] == i for i in range(102, len(texts)))


def test_op8_repeated_ids_have_one_text(spark):
    """Of the texts of an id the one with the smallest word digest speaks, wherever its rows lie."""
    base = [prose(300 + i, 120) for i in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(i, prose(900 + i, 80)) for i in range(20)]
    rows += [(100 + i, near_copy(t, i, 1)) for i, t in enumerate(base)]
    speaks = {}
    for i, text in rows:
        digest = xxhash.xxh3_128_digest(b" ".join(minhash.split_words(text)))
        speaks[i] = min(speaks.get(i, (digest, text)), (digest, text))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    idf = minhash.damped_idf(minhash.document_frequencies(frame), len(rows))
    expected = brute_classes({i: text for i, (_, text) in speaks.items()}, idf)
    assert 0 < sum(expected[100 + i] == i for i in range(20)) < 20
    for parts in (1, 3, 8):
        for order in ("doc_id", "text"):
            found = minhash.near_classes(frame.repartitionByRange(parts, order)).collect()
            assert len(found) == len(rows)
            assert {r["doc_id"]: r["class_id"] for r in found} == expected


def test_op8_id_filter_loses_no_wanted_row(spark):
    texts = spark.range(-40_000, 40_000).selectExpr("id", "concat('t', id) AS text", "id AS mark")
    wanted = texts.select("id").filter("pmod(id, 37) = 5")
    expected = {r["id"] for r in wanted.collect()}
    passed = {r["id"] for r in minhash.possible(texts, wanted).collect()}
    # One in sixteen slots is taken at most.
    assert expected <= passed and len(passed) < len(expected) + 80_000 / 12
    marked = wanted.withColumn("mark", F.col("id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = minhash.possible(texts, wanted).join(marked, ["id", "mark"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Texts meet the broadcast bit map before the exchange of the join by id.
    assert plan.index("SortMergeJoin") < plan.index("hashpartitioning(id") < plan.index("BroadcastHashJoin")
    assert minhash.possible(texts, wanted, limit=10).count() == 80_000
    assert minhash.possible(texts, wanted.limit(0)).count() == 0


def test_op8_odd_rows(odd, empty):
    rows = minhash.near_classes(odd).collect()
    assert len(rows) == len(odd_rows())
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert found[6]["class_id"] == 5 and found[9]["class_id"] == 8
    assert all(r["kept"] and r["class_id"] is None for r in rows if r["doc_id"] is None)
    assert minhash.near_classes(empty).count() == 0
    assert minhash.survivors(odd).columns == odd.columns


def test_samples_agree_as_often_as_sets_are_similar():
    source = np.random.default_rng(3)
    hits, expected = [], []
    for trial in range(40):
        shared, own = source.integers(0, 2**63, (1, 300)), source.integers(0, 2**63, (2, 40))
        sides = [np.unique(np.concatenate([shared[0], o])).astype(np.uint64) for o in own]
        sets = [(s, 1 + (s % np.uint64(97)).astype(np.float32) / 97) for s in sides]
        hits.append((minhash.samples(*sets[0], 64, trial) == minhash.samples(*sets[1], 64, trial)).mean())
        expected.append(minhash.similarity(*sets))
    assert abs(np.mean(hits) - np.mean(expected)) < 0.04


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r["id"]: r["component"] for r in connected_components(frame).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# WARC


def record(number, kind, url, seconds, headers, body=None, status=None):
    status = status or (200 if kind == "response" else 304)
    return (number, kind, url, seconds, status, headers, body)


def resolved(spark, rows, **options):
    frame = spark.createDataFrame(
        rows,
        "record_id long, kind string, target_uri string, s long, status int, "
        "headers map<string,string>, payload_sha256 string",
    ).withColumn("captured", F.timestamp_seconds("s"))
    return {r["record_id"]: r for r in warc.resolve_revisits(frame, **options).collect()}


@pytest.mark.parametrize("slot_seconds", [1, 3600])
def test_op9_as_of_validators_and_headers(spark, slot_seconds):
    url = "http://www.Example.com/a/?utm_source=x#top"
    rows = [
        record(1, "response", "https://example.com/a", 10, {"etag": '"1"', "content-type": "t", "date": "d1"}, "p1"),
        record(2, "response", url, 20, {"etag": '"2"', "date": "d2"}, "p2"),
        record(3, "response", url, 25, {"etag": '"3"'}, None),
        record(4, "response", url, 26, {"etag": '"4"'}, "p4", status=500),
        record(5, "revisit", url, 20, {"etag": 'W/"1"', "date": "d5", "content-type": "no"}),
        record(6, "revisit", url, 99, {"etag": '"1"'}),
        record(7, "revisit", url, 10, {"etag": '"1"'}),
        record(8, "revisit", None, 10, None),
        record(9, "revisit", url, 9000, None),
        record(10, "revisit", url, None, {"etag": '"2"'}),
    ]
    found = resolved(spark, rows, slot_seconds=slot_seconds)
    assert {k: (r["outcome"], r["response_id"]) for k, r in found.items()} == {
        5: ("confirmed", 1), 6: ("changed", 2), 7: ("unresolved", None), 8: ("unresolved", None),
        9: ("unvalidated", 2), 10: ("unresolved", None),
    }
    assert found[5]["headers"] == {"etag": 'W/"1"', "date": "d5", "content-type": "t"}
    assert found[5]["payload_sha256"] == "p1" and found[6]["headers"] is None


def test_op9_headers_and_empty(spark):
    block = "HTTP/1.1 200 OK\r\nETag:  \"x\" \r\nX: 1\r\nx: 2\r\nbad line\r\n"
    frame = spark.createDataFrame([(block,)], "b string")
    assert frame.select(warc.parse_headers(F.col("b"))).first()[0] == {"etag": '"x"', "x": "2"}
    assert resolved(spark, []) == {}


# URL filters


def test_op10_rules_and_odd_addresses(spark):
    urls = [
        None, "", "no scheme", "http://a.net/x", "http://A.NET", "http://example.net/en/1",
        "http://b.example.net/en", "http://notexample.net/en/1", "http://x.example.com/de/1?a=/fr/",
        "http://example.com/DE/1", "http://q.org/fr/?x", "http://xorg/fr/", "ftp://www.cheap-pills.info/a",
        "http://spam-farm.example.org/en/", "http://spam-farm.example.org/fr/", "http://x.com:80/en/#a://b.net/",
    ]
    pages = spark.createDataFrame(
        [(i, u, "h", "r", "v") for i, u in enumerate(urls)] + [(3, "http://a.net/x", "h", "r", "v")],
        "page_id long, url string, host string, rule string, verdict string",
    )
    rows = url_filters.judge_urls(pages).collect()
    assert len(rows) == len(urls) + 1
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert found == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("a.net", "/x", "net/", "block"), 4: ("a.net", "", None, "allow"),
        5: ("example.net", "/en/1", "example.net/en/", "allow"),
        6: ("b.example.net", "/en", "net/", "block"),
        7: ("notexample.net", "/en/1", "net/", "block"),
        8: ("x.example.com", "/de/1", "example.com/de/", "block"),
        9: ("example.com", "/DE/1", None, "allow"),
        10: ("q.org", "/fr/", "org/fr/", "allow"), 11: ("xorg", "/fr/", None, "allow"),
        12: ("www.cheap-pills.info", "/a", None, "block"),
        13: ("spam-farm.example.org", "/en/", None, "block"),
        14: ("spam-farm.example.org", "/fr/", "org/fr/", "allow"),
        15: ("x.com:80", "/en/", None, "allow"),
    }
    assert url_filters.judge_urls(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="without a literal token"):
        url_filters.judge_urls(pages, patterns=[url_filters.pattern_rule("x+", "block", ())])


def test_op10_rules_are_filed_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([("example",)] * 5 + [("net",)] * 3 + [("en",)] * 4, "token string")
    rules = url_filters.rule_table(spark, url_filters.HOST_RULES)
    found = {r["name"]: r["token"] for r in url_filters.rarest_token_index(rules, tokens).collect()}
    assert found["example.net/en/"] == "net" and found["org/fr/"] in ("fr", "org")


def test_op10_every_pattern_against_brute_force(spark):
    urls = [
        "http://a.example.com/signin", "http://a.example.com/signin?x", "http://a.example.com/login/",
        "http://a.example.com/signin/login", "http://a.example.com/signing", "http://a.example.com/xlogin",
        "http://xcheap-pills.com/", "http://a.9-cheap-pills.com/", "http://cheap-pills.com/", "http://cheap-pillsx.com/",
        "http://cheappills.com/", "http://spam-farm.com/", "http://xspam-farm.com/", "http://a.spam-farm.com/",
        "http://my-casino-x.com/", "http://casinox.com/", "http://free-porn.com/", "http://freeporn.com/",
        "http://a.porn-b.com/", "http://adult.com/", "http://x-adult.com/", "http://adults.com/",
        "http://a.com/?utm_source=feed", "http://a.com/?b&UTM_source=feed#x", "http://a.com/?xutm_source=feed",
    ]
    # Either part of a rule's text can be the rarer one.
    for common in ("pills/signin/spam/utm", "cheap/login/farm/feed"):
        table = urls + [f"http://b.org/{common}/x{i}" for i in range(30)]
        pages = spark.createDataFrame(list(enumerate(table)), "page_id long, url string").cache()
        for rule in url_filters.PATTERNS:
            rows = url_filters.judge_urls(pages, (), [rule]).collect()
            found = {r["page_id"] for r in rows if r["pattern"] is not None}
            assert found == {i for i, u in enumerate(table) if re.search(rule.regex, u.lower())}, rule.name
        blocked = {table[r["page_id"]] for r in url_filters.judge_urls(pages).collect() if r["verdict"] == "block"}
        assert {urls[0], urls[6]} <= blocked


# Queries and pipeline


def test_queries_have_contract_columns(spark):
    expected = {
        "op1_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op3_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op6_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op10_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    }
    for name, columns in expected.items():
        assert queries.QUERIES[name](spark, SMALL).columns[: len(columns)] == columns


def test_pipeline_stages_one_by_one(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    cleaned = corpus_pipeline.clean_lines(spark, docs, SMALL).cache()
    verdicts = {r["doc_id"] for r in quality_rules.judged(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in cleaned.collect()} == verdicts
    distinct = corpus_pipeline.drop_equal(spark, cleaned, SMALL).cache()
    assert distinct.count() == cleaned.select("text").distinct().count()
    near = corpus_pipeline.drop_near(spark, distinct, SMALL).cache()
    kept = {r["doc_id"]: r["text"] for r in distinct.collect()}
    idf = minhash.damped_idf(minhash.document_frequencies(distinct), len(kept))
    classes = brute_classes(kept, idf)
    assert {r["doc_id"] for r in near.collect()} == {i for i, c in classes.items() if i == c}
    mixed = corpus_pipeline.mix_sources(spark, near, SMALL).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(texts)
    encoded = corpus_pipeline.encode_texts(spark, mixed, SMALL)
    assert encoded.count() == mixed.count()
    for table in (odd, empty):
        rows = table
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SMALL)
        assert "n_tokens" in rows.columns
        rows.count()
