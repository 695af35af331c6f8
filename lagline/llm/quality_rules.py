"""Line-first quality rules: judge lines, remove the failing ones, then judge the document.

Base statistics are over whole texts. A line with words fails when it has no
sentence end (punctuation), is a row of separated items or a menu (navigation),
or is a short line with a stock phrase (boilerplate). Failing lines are removed.
A document is rejected when it fails the base rules or when removal takes more
than ``max_lost`` of the characters of its words.

Everything is one pass of column expressions; no row leaves its task.

Defined results: a null or empty text has no words and fails the base rules; all
counts are over the whole text; repeated rows are judged alike; an empty table
gives an empty result; extra columns are ignored (``clean`` carries them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagline.llm.common import SPACES, let, words_of

# Symbols counted as noise.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Phrases of stock lines.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "click here",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "share on facebook",
    "share on twitter",
    "skip to content",
    "powered by wordpress",
)
SENTENCE_END = r"[.!?\x{2026}\x{3002}\x{FF01}\x{FF1F}][\x22\x27)\]\x{00BB}\x{201D}\x{2019}]*([\x20\x09-\x0D]|$)"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict."""

    boilerplate: tuple[str, ...] = BOILERPLATE
    boilerplate_chars: int = 200
    separators_per_100_words: int = 30
    noise_per_100_words: int = 50
    max_lost: float = 0.5


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more.

    Windows of one text are told apart by their 64-bit hash, chained over the five
    words. A text without a repeated window, the usual case, is settled by one
    set; else equal hashes become neighbours by sorting.
    """

    def covered(starts: Column) -> Column:
        """Words covered by windows at sorted starts: gaps cut at the window length."""
        shifted = F.slice(starts, 2, F.size(starts))
        gaps = F.zip_with(
            F.slice(starts, 1, F.size(shifted)), shifted, lambda a, b: F.least(b - a, F.lit(WINDOW))
        )
        return F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)

    def repeated(grams: Column) -> Column:
        placed = F.array_sort(
            F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at")))
        )

        def starts(ordered: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                before = F.get(ordered, i - 1)["gram"]
                after = F.get(ordered, i + 1)["gram"]
                return F.coalesce(before == x["gram"], F.lit(False)) | F.coalesce(
                    after == x["gram"], F.lit(False)
                )

            return F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["at"]))

        return let(let(placed, starts), covered)

    def count(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
        )
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(
            let(
                windows,
                lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
                    repeated(g)
                ),
            )
        )

    return let(words, count).cast("long")


def failed_rule(line: Column, rules: LineRules = LineRules()) -> Column:
    """Name of the first rule that a line with words fails, null if none.

    Cheap tests stand first; word counts are only taken of lines that hold a
    separator, a noise symbol or a doubled exclamation mark.
    """
    words = F.size(words_of(line))
    barred = line.contains("|") | line.contains("\u00bb") | line.contains("\u2022")
    menu = barred & (_count(line, "|\u00bb\u2022") * 100 > words * rules.separators_per_100_words)
    noise = _count(line, SYMBOLS)
    noisy = (noise > 0) & (noise * 100 > words * rules.noise_per_100_words)
    marks = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    shouted = line.contains("!!") & (marks * 100 > words * rules.noise_per_100_words)
    ended = line.endswith(".") | line.rlike(SENTENCE_END)
    stock = (F.length(line) <= rules.boilerplate_chars) & F.lower(line).rlike(
        "|".join(rules.boilerplate)
    )
    return (
        F.when(F.length(F.btrim(line, F.lit(SPACES))) == 0, F.lit(None))
        .when(menu, F.lit("navigation"))
        .when(~ended | noisy | shouted, F.lit("punctuation"))
        .when(stock, F.lit("boilerplate"))
    )


def line_verdicts(text: Column, rules: LineRules = LineRules()) -> Column:
    """Array of (line, failed) for every line of the text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda x: F.struct(x.alias("line"), failed_rule(x, rules).alias("failed")))


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: LineRules = LineRules(),
) -> DataFrame:
    """One row per input row: statistics, verdicts and the text without failing lines."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.split(text, "\n", -1)
    by_words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )

    def line_facts(x: Column) -> Column:
        worded = F.filter(x, lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
        return F.struct(
            let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).alias("n_dup_lines"),
            F.aggregate(
                F.filter(x, lambda line: failed_rule(line, rules).isNotNull()),
                F.lit(0),
                lambda total, line: total + _word_chars(line),
            ).alias("lost_chars"),
        )

    cleaned = F.array_join(F.filter(lines, lambda x: failed_rule(x, rules).isNull()), "\n")
    facts = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        by_words.alias("w"),
        let(lines, line_facts).alias("l"),
        _word_chars(text).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        cleaned.alias("clean_text"),
    )
    n_words = F.col("w.n_words").cast("long")
    base = (n_words < 10) | (100 * F.col("w.n_repeat_words") > 20 * n_words)
    return facts.select(
        id_col,
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        base.alias("base_failed"),
        F.col("l.lost_chars").cast("long").alias("lost_chars"),
        (~base & (F.col("l.lost_chars") <= rules.max_lost * F.col("word_chars"))).alias("kept"),
        "clean_text",
    )


def clean(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: LineRules = LineRules(),
) -> DataFrame:
    """Documents that pass, all their columns, failing lines taken out of the text."""
    verdict = "__verdict"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        passes(text, rules).alias(verdict),
    ).filter(verdict)
    cleaned = F.array_join(
        F.filter(F.split(text, "\n", -1), lambda x: failed_rule(x, rules).isNull()), "\n"
    )
    return own.select(
        *[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    )


def passes(text: Column, rules: LineRules = LineRules()) -> Column:
    """Whether a non-null text passes the base rules and keeps enough after cleaning."""
    enough = let(
        words_of(text),
        lambda w: (F.size(w) >= 10) & (100 * repeated_words(w) <= 20 * F.size(w)),
    )
    lost = F.aggregate(
        F.filter(F.split(text, "\n", -1), lambda line: failed_rule(line, rules).isNotNull()),
        F.lit(0),
        lambda total, line: total + _word_chars(line),
    )
    return enough & (lost <= rules.max_lost * _word_chars(text))
