"""Language identification, the conversation trie and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import check_oracle
from lagline.llm import bpe, conversation_trie, hard_negatives, langid, queries

SMALL = "/root/testdata/sf0.001"


# Language identification

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmnéß"}


def made_text(lang: str, seed: int, words: int) -> str:
    source = random.Random(f"{lang}{seed}")
    pick = source.choice
    return " ".join("".join(pick(LETTERS[lang]) for _ in range(source.randint(2, 6))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, made_text(lang, i, 30), lang) for i in range(60) for lang in LETTERS]
    rows += [(1, None, "aa"), (2, "", "bb"), (3, " 12 !?\n", "cc"), (None, "fghij fg", "bb"), (4, "klm", None)]
    return spark.createDataFrame(
        [(i, t, lang, 7, 0.5) for i, t, lang in rows],
        "doc_id bigint, text string, lang string, hash int, score double",
    )


def test_op11_follows_exact_profiles(spark, labelled):
    """Corrected counts come near those of exact profiles; the verdicts are equal."""
    filters = langid.fit(labelled, sample=1_000, profile=500)
    assert filters.languages == tuple(LETTERS)
    exact = defaultdict(lambda: defaultdict(int))
    sizes = defaultdict(int)
    for _, text, lang, *_ in labelled.collect():
        if lang is not None:
            sizes[lang] += 1
            for gram in np.unique(langid.gram_hashes(langid.word_symbols(text))):
                exact[lang][int(gram)] += 1
    for row in langid.identify(labelled, filters).collect():
        assert row["lang_pred"] in (*LETTERS, "und") and 0.0 <= row["score"] <= 1.0
    for lang in LETTERS:
        ranked = sorted(exact[lang], key=lambda g: (-exact[lang][g], np.int64(np.uint64(g))))[:500]
        kept = {g for g in ranked if exact[lang][g] >= langid.SHARE * sizes[lang]}
        grams = langid.gram_hashes(langid.word_symbols(made_text(lang, 999, 200)))
        real = filters.corrected(filters.hits(grams), len(grams))
        true = sum(int(g) in kept for g in grams)
        assert abs(real[filters.languages.index(lang)] - true) <= 0.02 * len(grams)
        assert filters.identify(made_text(lang, 999, 200))[0] == lang


def test_op11_odd_rows(spark, labelled):
    filters = langid.fit(labelled)
    found = langid.identify(labelled, filters)
    assert found.columns == ["doc_id", "lang", "hash", "lang_pred", "score"]
    odd = found.filter(F.col("lang_pred") == "und").collect()
    assert sorted((r["doc_id"], r["score"]) for r in odd) == [(1, 0.0), (2, 0.0), (3, 0.0)]
    nothing = langid.fit(labelled.filter("false"))
    assert nothing.languages == () and nothing.identify("abc") == ("und", 0.0)
    assert langid.identify(labelled.filter("false"), filters).count() == 0
    only_null = langid.fit(labelled.filter("lang IS NULL"))
    assert only_null.identify("abc") == ("und", 0.0)


def test_op11_many_languages_and_bounds(spark, monkeypatch):
    rows = [(i, chr(0x4E00 + 40 * i) * 3 + chr(0x4E01 + 40 * i), f"l{i:02}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = langid.fit(docs)
    assert filters.table.shape[1] == 3  # more languages than one byte holds
    assert all(filters.identify(text)[0] == lang for _, text, lang in rows)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 19)
    with pytest.raises(ValueError):
        langid.fit(docs)


def test_op11_strips_count_every_gram_once(monkeypatch):
    texts = [made_text("cc", 5, 300), "x" * 1000, "ab " * 400, "y" * 129 + " " + "z" * 500]
    whole = [np.sort(langid.gram_hashes(langid.word_symbols(t))) for t in texts]
    monkeypatch.setattr(langid, "STRIP", 64)
    for text, expected in zip(texts, whole):
        parts = list(langid.strips(langid.word_symbols(text)))
        assert len(parts) > 1 and (np.sort(np.concatenate(parts)) == expected).all()


def test_op11_held_out_accuracy(spark):
    """On rows that taught nothing."""
    found = queries.op11_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL")
    assert right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert found.count() == docs.count()


# The conversation trie


def brute_trie(rows):
    """All nodes from plain lists: rows are (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, role, digest), (role, text)))
    original = {c: [t for _, t in sorted(found)] for c, found in turns.items()}
    rebuilt = {}
    for conv, own in original.items():
        h = zlib.crc32(str(conv).encode()) % 9
        lender = conv - int(np.fmod(conv, 5))
        rebuilt[conv] = original.get(lender, [])[:h] + own[h:]
    members = defaultdict(list)
    for conv, found in rebuilt.items():
        for depth in range(len(found) + 1):
            members[tuple(found[:depth])].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        size = len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = (len(members[path]) - 1) * size + sum(saved[p] for p in below)
    out = []
    for path, convs in members.items():
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(path))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            len(children[path]), leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


CONVERSATION = "conv_id bigint, turn bigint, role string, text string, depth int, bytes string"


def conversations_frame(spark, rows, partitions=3):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION)
    return frame.repartition(partitions)


def made_conversations(seed, convs, alphabet=2, longest=12):
    source = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(source.randint(1, longest)):
            text = "tü"[source.randrange(alphabet)] * (1 + turn % 3)
            rows.append((conv, turn, "user" if turn % 2 else "assistant", text))
    return rows


ODD_TURNS = [
    (3, None, "user", "first"), (3, 2, None, None), (3, 2, None, None), (3, 1, "", ""), (7, 0, "a", "b:c"),
    (7, 0, "a", "b"), (8, 0, "ab", ""), (None, 0, "user", "nobody"), (-4, 0, "user", "below"),
    (10**15, 5, "user", "far"), (11, 0, "user", "x" * 50_000), (12, 0, "user", "x" * 50_000),
]


@pytest.mark.parametrize("queue,min_shard", [(100_000, 10_000), (4, 10), (1, 1)])
def test_op12_against_brute_force(spark, queue, min_shard):
    """Also with shards of a few nodes and a queue that spills at once."""
    for rows in (ODD_TURNS, made_conversations(1, 60) + ODD_TURNS):
        found = conversation_trie.prefix_trie(conversations_frame(spark, rows), queue, min_shard)
        assert sorted(map(tuple, found.collect()), key=str) == brute_trie(rows)


def test_op12_hot_copies_and_one_long_conversation(spark):
    """A third of the conversations are copies, one conversation holds most turns."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 200) for t in range(3)]
    rows += [(1_000, t, "user", str(t % 7)) for t in range(3_000)]
    rows += made_conversations(3, 40)
    frame = conversations_frame(spark, rows, 8)
    found = conversation_trie.prefix_trie(frame, 50, 100)
    assert sorted(map(tuple, found.collect()), key=str) == brute_trie(rows)


def test_op12_carries_between_tasks():
    """Prefix hashes of a conversation cut anywhere are those of the whole."""
    digests = [random.Random(i).getrandbits(60) for i in range(10)]
    full = [sum(x * pow(b, i, 2**64) for i, x in enumerate(digests)) % 2**64 for b in conversation_trie.BASES]
    cuts = [(0, 0, 4), (1, 4, 5), (2, 5, 10)]
    parts = []
    for part, begin, end in cuts:
        sums = [
            sum(x * pow(b, i, 2**64) for i, x in enumerate(digests[begin:end])) % 2**64
            for b in conversation_trie.BASES
        ]
        parts.append((part, 5, 5, end - begin, *sums))
    parts.append((3, 5, 6, 1, 1, 1))
    assert conversation_trie.carries(parts)[3] == (10, *full)
    assert 0 not in conversation_trie.carries(parts)


def test_op12_empty(spark):
    empty = conversations_frame(spark, [])
    assert conversation_trie.prefix_trie(empty).count() == 0
    nobody = conversations_frame(spark, [(None, 1, "user", "x")])
    assert conversation_trie.prefix_trie(nobody).count() == 0


def test_op12_queue_spills_in_order():
    queue, source = conversation_trie.SpillingQueue(3), random.Random(2)
    items = [tuple(source.randint(-9, 9) for _ in range(5)) for _ in range(500)]
    out = []
    for item in items[:400]:
        queue.push(item)
    for item in items[400:]:
        out.append(queue.pop())
        queue.push(max(item, out[-1]))
    while queue.first() is not None:
        out.append(queue.pop())
    assert out == sorted(out) and len(out) == 500 and queue.spilled > 100


def test_op12_query_agrees_with_sql(spark):
    connection = check_oracle.open_tables(SMALL)
    assert check_oracle.compare(spark, SMALL, "op12_conversation_trie", connection) == ""


# Hard negatives


def brute_negatives(rows, k=5):
    """From plain (vec_id, embedding, label) rows, one per id."""
    usable = {}
    for number, vector, label in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if number is None or label is None or vector is None:
            continue
        if any(x is None or not np.isfinite(x) for x in vector):
            continue
        if number % 7 == 0:
            label = (label + 1) % 10
        whole = [int(np.floor(256.0 * float(x))) for x in vector]
        usable[number] = min(usable.get(number, (label, whole)), (label, whole))

    def score(a, b):
        return sum(x * y for x, y in zip(usable[a][1], usable[b][1]))

    out = []
    for anchor in (n for n in usable if n % 100 == 0):
        same = [n for n in usable if n != anchor and usable[n][0] == usable[anchor][0]]
        unlike = [(-score(anchor, n), n) for n in usable if usable[n][0] != usable[anchor][0]]
        for positive in sorted(same, key=lambda n: (-score(anchor, n), n))[:k]:
            p = score(anchor, positive)
            fits = sorted((s, n) for s, n in unlike if 80 * p <= -100 * s <= 100 * p)
            out += [(anchor, positive, i + 1, n, p, -s) for i, (s, n) in enumerate(fits[:k])]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("row", F.lit(1))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = hard_negatives.scaled_rows(frame, moved)
    found = hard_negatives.hard_negatives(scaled, F.col("vec_id") % 100 == 0, **options)
    return sorted(map(tuple, found.collect()))


def made_vectors(seed, count, width=6):
    """Clustered vectors, a third of them equal."""
    source = np.random.default_rng(seed)
    centres = source.normal(size=(5, width))
    rows = []
    for i in range(count):
        vector = centres[0] if i % 3 == 0 else centres[source.integers(5)] + 0.3 * source.normal(size=width)
        rows.append((i, [float(x) for x in vector.astype(np.float32)], int(source.integers(4))))
    return rows


ODD_VECTORS = [
    (700, None, 1), (800, [0.5, 0.25], None), (None, [1.0] * 6, 1), (900, [float("nan")] + [0.1] * 5, 2),
    (1000, [0.1, None, 0.3, 0.1, 0.1, 0.1], 2), (1100, [float("inf")] * 6, 3), (1200, [], 1), (1300, [0.5, 0.75], 2),
    (1301, [-0.001] * 6, 3), (1302, [0.0] * 6, 3), (1400, [1.0] * 6, 0), (1400, [0.5] * 6, 0), (1400, [0.5] * 6, 0),
]


@pytest.mark.parametrize("shard_rows,block_rows", [(4_096, 2_048), (150, 3)])
def test_op13_against_brute_force(spark, shard_rows, block_rows):
    rows = made_vectors(5, 900) + ODD_VECTORS
    assert mined(spark, rows, shard_rows=shard_rows, block_rows=block_rows) == brute_negatives(rows)


def test_op13_query_against_brute_force(spark):
    """The whole registered query on whole tables."""
    for sf_dir in (SMALL, "/root/testdata/sf0.01"):
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
        found = queries.op13_hard_negatives(spark, sf_dir)
        assert sorted(map(tuple, found.collect())) == brute_negatives(map(tuple, rows.collect()))


def test_op13_empty_and_without_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [2.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_op13_scores_beyond_doubles(spark):
    """Whole-number arithmetic where 53 bits are not enough."""
    rows = [(i, [200_000.0 + i / 256] * 6, 0 if i % 2 else 1) for i in range(0, 60)]
    rows = [(n, v, l) for n, v, l in rows if n % 7]
    rows.append((100, [200_000.0] * 6, 1))
    assert mined(spark, rows) == brute_negatives([(n, np.float32(v).tolist(), l) for n, v, l in rows])


def test_op13_descent_skips_leaves():
    """Far clusters are not verified, and every node's bound holds."""
    source = np.random.default_rng(1)
    centres = source.normal(size=(20, 8)) * 400
    vectors = np.concatenate([c + source.normal(size=(100, 8)) * 5 for c in centres]).astype(np.int32)
    arrays = hard_negatives.build(np.arange(2_000), np.zeros(2_000, np.int32), vectors)
    tree = hard_negatives.CoverTree(arrays)
    query = vectors[7].astype(np.float64)
    length = np.sqrt((query**2).sum())
    middle, slack = tree.centres @ query, length * tree.radius + 0.5
    scores = tree.vectors @ query
    for node in range(len(tree.radius)):
        here = scores[tree.begins[node] : tree.ends[node]]
        assert here.max() <= middle[node] + slack[node] and here.min() >= middle[node] - slack[node]
    best = hard_negatives.Best(5)

    def members(begin, end):
        return scores[begin:end], tree.ids[begin:end]

    leaves = hard_negatives.descend(tree, middle + slack, middle - slack, members, [best])
    assert [s for s, _ in best.found] == sorted(-scores)[:5]
    assert leaves < 0.5 * (tree.counts == 0).sum()


# Byte pair encoding against the library


def test_op1_query_against_the_library(spark):
    """Counts and digests of every row of the query."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.WORD_VOCABULARY)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for number, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, dtype="<u4").tobytes()
        expected.append((number, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, queries.op1_bpe(spark, SMALL).collect())) == sorted(expected)


@pytest.mark.parametrize("text", ["a࢛ͅ b", "Ᲊ ꟋX Ɤ", "a֮ࣟ̀x", "🇦é‍" * 50, "x" * 3_000 + "é" * 500])
def test_op1_newer_unicode_and_long_words(text):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.WORD_VOCABULARY)
    own = bpe.Encoder(bpe.read_definition(queries.WORD_VOCABULARY))
    ids = np.frombuffer(own.encode(text), dtype="<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode([own.encode(text)]) == [library.decode(ids, skip_special_tokens=False)]


def test_op1_one_long_word_takes_little_memory():
    own = bpe.Encoder(bpe.read_definition(queries.WORD_VOCABULARY))
    tracemalloc.start()
    own.encode_symbols("abcdefgh" * 25_000 + chr(ord("x") + bpe.FINAL))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 200_000
