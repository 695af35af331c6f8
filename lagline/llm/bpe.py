"""BPE encoding by longest matches and backtracking, decoding by an offset table.

Encoding. An Aho-Corasick automaton over all tokens finds, in one pass over a word,
the longest token that starts at each place; a table gives the next shorter token that
starts the same way. The encoder takes the longest one that may follow the token before
it and steps back to a shorter one where it runs into a dead end. Whether token ``b`` may follow ``a`` is a property of the pair: it holds when no
merge across the border would come before the merges that form ``a`` and ``b``. A
sequence whose neighbours all pass is exactly what the merges produce, and a place
once found dead stays dead, so the work is linear in the word, and so is the memory:
one number per byte. Pair answers are kept in a table, words in a bounded memo.

Decoding. All token strings lie in one block of bytes with an offset per token; the
texts of a run of documents are gathered from it in one step.

Spark splits the rows and moves nothing: both directions are map-only, and
``round_trip`` does both in one pass with one encoder per task.

Letters, numbers and lower case are those of Unicode 16, combining classes those of
Unicode 9, which is what the `tokenizers` library has; where Python's tables differ, the
fixed lists below say so.

Defined results: a null text encodes like an empty one, to no ids; special token
strings in a text become their ids; repeated rows and ties need no rule, since every
row stands alone; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lagline.llm.common import bounded_batches

# Letters, numbers and upper-case letters (with the distance to their
# lower case) that Unicode 16 knows and Python's tables do not, by range.
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 "
    "1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C "
    "18CFF 1E5D0-1E5ED 1E5F0"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
NEW_CAPITALS = {
    "1C89": 1, "A7CB": 0x264 - 0xA7CB, "A7CC": 1, "A7CE": 1, "A7D2": 1, "A7D4": 1, "A7DA": 1,
    "A7DC": 0x19B - 0xA7DC, "10D50-10D65": 0x20, "16EA0-16EB8": 0x1B,
}
# Combining marks that Python reorders and the library does not know as such.
UNKNOWN_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 "
    "10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 1193D-1193E "
    "11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F "
    "1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
FINAL = 256
# Words kept in each of the two halves of the memo.
MEMO_WORDS = 120_000
MEMO_LENGTH = 64
MEMO_PAIRS = 200_000
GATHER_IDS = 100_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes.

    Printable Latin-1 stands for itself, the rest is numbered from 256 upwards.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def listed(ranges: str) -> Iterator[int]:
    """Code points of a list of ranges in hexadecimal."""
    for part in ranges.split():
        first, _, last = part.partition("-")
        yield from range(int(first, 16), int(last or first, 16) + 1)


@lru_cache(maxsize=1)
def newer_kinds() -> dict[str, str]:
    """Characters of the two lists with the kind they belong to."""
    return {chr(c): "L" for c in listed(NEW_LETTERS)} | {chr(c): "N" for c in listed(NEW_NUMBERS)}


def _kind(letter: str) -> str:
    return newer_kinds().get(letter) or unicodedata.category(letter)[0]


def _ranges(belongs: Callable[[str], bool], last: int) -> str:
    """Members of a regular-expression class up to code point ``last``."""
    out, begin = [], None
    for code in range(last + 2):
        inside = code <= last and belongs(chr(code))
        if inside and begin is None:
            begin = code
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{code - 1:08x}")
            begin = None
    return "".join(out)


def _is_white(letter: str) -> bool:
    """Unicode white space, which leaves out the four ASCII separators 28 to 31."""
    return letter.isspace() and letter not in "\x1c\x1d\x1e\x1f"


@lru_cache(maxsize=8)
def splitter(words_only: bool, last: int) -> re.Pattern:
    """The vocabulary kind's splitting pattern for texts up to code point ``last``.

    Classes are written out as ranges: short ones for plain texts, all of Unicode
    only for the texts that need it.
    """
    letters = _ranges(lambda c: _kind(c) == "L", last)
    numbers = _ranges(lambda c: _kind(c) == "N", last)
    white = _ranges(_is_white, last)
    if words_only:
        return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")
    return re.compile(
        f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+"
        f"|[{white}]+(?![^{white}])|[{white}]+"
    )


BEYOND_BMP = re.compile("[\U00010000-\U0010ffff]")


def pieces(text: str, words_only: bool) -> list[str]:
    """The text cut into the pieces that merges never cross."""
    last = 0x7F if text.isascii() else 0x10FFFF if BEYOND_BMP.search(text) else 0xFFFF
    return splitter(words_only, last).findall(text)


CAPITALS = {
    code: code + distance for codes, distance in NEW_CAPITALS.items() for code in listed(codes)
}
CAPITAL = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")
# No character of these lists comes before this range, most texts have none in it.
LISTED = re.compile("[\u07fd-\U0010ffff]")
MARK = re.compile("([" + "".join(map(chr, listed(UNKNOWN_MARKS))) + "])")


def composed(text: str) -> str:
    """NFC, with marks that the library does not know as a border that nothing crosses."""
    if text.isascii():
        return text
    if LISTED.search(text) is None or MARK.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in MARK.split(text))


def lowered(text: str) -> str:
    """Lower case letter by letter; a final sigma is not treated apart."""
    if text.isascii():
        return text.lower()
    if LISTED.search(text) and CAPITAL.search(text):
        text = text.translate(CAPITALS)
    return text.replace("Σ", "σ").lower()


class Encoder:
    """One vocabulary with its automaton, pair table and word memo."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.words_only = bool(self.suffix)
        vocab = model["vocab"]
        letters = byte_letters()

        def symbols(token: str) -> str:
            """Token as Latin-1 bytes; the last one of a word is raised by 256."""
            last = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if last else token
            raw = "".join(chr(letters[c]) for c in body)
            return raw[:-1] + chr(ord(raw[-1]) + FINAL) if last else raw

        # Token pairs with their rank and, for each merged token, its two parts.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            self.parts.setdefault(whole, (a, b, rank))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special_pattern = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.automaton = ahocorasick.Automaton()
        numbers = {symbols(t): n for t, n in vocab.items() if t not in self.special}
        # Length of a token, and the longest other token that it starts with (or -1).
        self.lengths = [0] * (max(vocab.values(), default=-1) + 1)
        self.shorter = [-1] * len(self.lengths)
        for text, number in numbers.items():
            self.automaton.add_word(text, number)
            self.lengths[number] = len(text)
            starts = (numbers.get(text[:size], -1) for size in range(len(text) - 1, 0, -1))
            self.shorter[number] = next((n for n in starts if n >= 0), -1)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._offset_table(vocab, letters)

    def _offset_table(self, vocab: dict[str, int], letters: dict[str, int]) -> None:
        """Token strings in id order; a gap after each where words are not marked by bytes."""
        strings = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in vocab.items():
            strings[number] = (
                token.encode() + b" " if self.words_only else bytes(letters[c] for c in token)
            )
        for token, number in self.special.items():
            strings[number] = token.encode() + (b" " if self.words_only else b"")
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        self.block = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def _edge(self, token: int, side: int) -> Iterator[tuple[int, float]]:
        """Tokens at one border of ``token``, outermost first, with the rank that uses them up."""
        used = float("inf")
        while True:
            yield token, used
            made = self.parts.get(token)
            if made is None:
                return
            token, used = made[side], made[2]

    def may_follow(self, before: int, after: int) -> bool:
        """No merge across the border comes before the merges on either side."""
        known = self.pairs.get((before, after))
        if known is not None:
            return known
        free = True
        for x, x_used in self._edge(before, 1):
            for y, y_used in self._edge(after, 0):
                rank = self.rank.get((x, y))
                # Equal merges go from left to right.
                if rank is not None and rank < x_used and rank <= y_used:
                    free = False
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[before, after] = free
        return free

    def encode_symbols(self, text: str) -> list[int]:
        """Ids of one word given as symbols."""
        size, lengths, shorter = len(text), self.lengths, self.shorter
        longest = [-1] * size
        # Matches come by their end, so the longest from a place is the last one noted.
        for end, number in self.automaton.iter(text):
            longest[end + 1 - lengths[number]] = number
        pairs, may_follow = self.pairs, self.may_follow
        dead = bytearray(size + 1)
        chosen: list[int] = []
        place, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                end = place + lengths[token]
                if not dead[end]:
                    fits = last < 0 or pairs.get((last, token))
                    if fits or (fits is None and may_follow(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                chosen.append(token)
                if end == size:
                    return chosen
                place, last, token = end, token, longest[end]
                continue
            if not chosen:
                raise ValueError(f"no token fits {text[:100]!r}")
            dead[place] = 1
            token = chosen.pop()
            place -= lengths[token]
            last = chosen[-1] if chosen else -1
            token = shorter[token]

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit numbers."""
        ids = self.older.get(word)
        if ids is None:
            text = word.encode("utf-8", "replace").decode("latin-1")
            if self.words_only:
                text = text[:-1] + chr(ord(text[-1]) + FINAL)
            ids = np.array(self.encode_symbols(text), dtype="<u4").tobytes()
        if len(word) <= MEMO_LENGTH:
            # Words of the older half that are met again move to the newer one.
            if len(self.memo) >= MEMO_WORDS:
                self.memo, self.older = {}, self.memo
            self.memo[word] = ids
        return ids

    def _plain(self, text: str) -> list[bytes]:
        if self.words_only:
            text = lowered(composed(text))
        memo, word = self.memo, self.word
        return [memo.get(w) or word(w) for w in pieces(text, self.words_only)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        if self.special_pattern is None or "<" not in text:
            return b"".join(self._plain(text))
        out: list[bytes] = []
        for piece in self.special_pattern.split(text):
            if piece in self.special:
                out.append(np.array([self.special[piece]], dtype="<u4").tobytes())
            elif piece:
                out += self._plain(piece)
        return b"".join(out)

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of several id sequences, gathered from the block in one step."""
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
        begins = self.starts[flat]
        lengths = self.starts[flat + 1] - begins
        ends = np.cumsum(lengths)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)
        gathered = self.block[source].tobytes()
        out, at, token = [], 0, 0
        for part in ids:
            token += len(part) // 4
            end = int(ends[token - 1]) if token else 0
            raw = gathered[at : end - 1 if self.words_only and end > at else end]
            out.append(raw.decode("utf-8", "replace"))
            at = end
        return out


@lru_cache(maxsize=4)
def encoder(definition: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(definition)


def read_definition(path: str) -> str:
    """The vocabulary file, a few megabytes; it travels to the tasks as a broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*[f for f in schema.fields if f.name not in names], *fields])


def _replace(batch: pa.RecordBatch, **arrays: pa.Array) -> pa.RecordBatch:
    """The batch with these columns last, instead of any of the same name."""
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in arrays]
    names = [n for n, _ in kept] + list(arrays)
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(arrays.values()), names=names)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit numbers) and ``n_tokens``.

    ``vocabulary`` is the path of a byte-level BPE definition. Columns already named
    ``ids`` or ``n_tokens`` are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    definition = spark.sparkContext.broadcast(read_definition(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(definition.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            ids = [own.encode(t.as_py() or "") for t in texts]
            yield _replace(
                batch,
                **{
                    ids_col: pa.array(ids, pa.binary()),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                },
            )

    schema = _with(
        docs.schema, T.StructField(ids_col, T.BinaryType()), T.StructField("n_tokens", T.LongType())
    )
    return docs.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded"
) -> DataFrame:
    """``docs`` without the text, with ``ids``, ``n_tokens`` and the text the ids decode to.

    The same as ``decode(encode(docs))``, in one pass with one encoder per task. Results
    leave in runs of bounded size.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    definition = spark.sparkContext.broadcast(read_definition(vocabulary))
    results = (ids_col, "n_tokens", out_col)
    carried = [f for f in docs.schema.fields if f.name not in (*results, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(definition.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            begin, waiting, size = 0, [], 0
            for at in range(batch.num_rows):
                waiting.append(own.encode(texts[at].as_py() or ""))
                size += len(waiting[-1]) // 4
                if size >= GATHER_IDS or at == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[c.slice(begin, len(waiting)) for c in batch.columns[:-1]],
                            pa.array(waiting, pa.binary()),
                            pa.array([len(i) // 4 for i in waiting], pa.int64()),
                            pa.array(own.decode(waiting), pa.string()),
                        ],
                        names=[*[f.name for f in carried], *results],
                    )
                    begin, waiting, size = at + 1, [], 0

    schema = T.StructType(
        [
            *carried,
            T.StructField(ids_col, T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField(out_col, T.StringType()),
        ]
    )
    return docs.select(*[f.name for f in carried], text_col).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; special tokens are written out."""
    spark = rows.sparkSession
    bounded_batches(spark)
    definition = spark.sparkContext.broadcast(read_definition(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(definition.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            texts: list[str] = []
            waiting: list[bytes] = []
            size = 0
            for value in column:
                waiting.append(value.as_py() or b"")
                size += len(waiting[-1]) // 4
                if size >= GATHER_IDS:
                    texts += own.decode(waiting)
                    waiting, size = [], 0
            texts += own.decode(waiting)
            yield _replace(batch, **{out_col: pa.array(texts, pa.string())})

    return rows.mapInArrow(run, _with(rows.schema, T.StructField(out_col, T.StringType())))
