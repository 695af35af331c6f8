"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression together with literal tokens that every matching
URL must contain, one set of them per branch where it has alternatives. Running each
rule on each URL grows with the product of both. Instead every branch is filed under
one token, the one that the fewest URLs of the table contain; the tokens of a URL
fetch the rules filed under them, and only those run their expression.

Two kinds of rules: *host rules* (``net/``, ``example.com/de/``) fit a host, its
subdomains and a path prefix, and the longest fitting one decides; *patterns*
decide where no host rule fits, allow before block.

Defined results: a null URL or one without ``://`` has empty host and path and is
allowed; token counts, tokens and expressions are over the ASCII-lower-cased URL;
repeated rows each keep their own row as far as their id differs, rows that repeat
the id and the URL get the same verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKEN_BREAK = "[^a-z0-9]+"
# More rules than this are joined by shuffling instead of being broadcast.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``kind``: host or pattern; ``action``: block or allow.

    Every matching URL has all tokens of at least one of the ``branches``.
    """

    name: str
    action: str
    kind: str
    regex: str
    branches: tuple[tuple[str, ...], ...]
    on: str = "address"


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(sorted({t for t in re.split(TOKEN_BREAK, text.lower()) if t}))


def host_rule(name: str, action: str) -> Rule:
    """``host/path``: the host and its subdomains, paths that start with the path."""
    host, _, path = name.partition("/")
    # A label or path segment may be the start of a longer one at its end only
    # when the rule's path does not end in a separator.
    cut = path if path.endswith("/") or not path else path.rpartition("/")[0]
    regex = rf"^(?:[^/]*\.)?\Q{host}/{path}\E"
    return Rule(name, action, "host", regex, (_tokens(f"{host}/{cut}"),))


def pattern_rule(regex: str, action: str, *branches: Sequence[str]) -> Rule:
    """A regular expression over the lower-cased URL and the whole tokens it implies.

    A part of the expression that letters or digits can precede or follow is no whole
    token. Alternatives with tokens of their own are listed as several branches.
    """
    return Rule(regex, action, "pattern", regex, tuple(map(tuple, branches)), on="url")


# Host rules in force.
HOST_RULES = (
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
)
# Patterns for addresses that no host rule covers.
PATTERNS = (
    pattern_rule(r"://([^/?#]*\.)?[a-z0-9]*-?cheap-pills\.", "block", ("pills",)),
    pattern_rule(r"://([^/?#]*\.)?spam-farm\.", "block", ("spam", "farm")),
    pattern_rule(r"://([^/?#]*[.-])?casino[.-]", "block", ("casino",)),
    pattern_rule(r"://([^/?#]*[.-])?(free-)?porn[.-]", "block", ("porn",)),
    pattern_rule(r"://([^/?#]*[.-])?adult[.-]", "block", ("adult",)),
    pattern_rule(r"/(login|signin)(/|\?|$)", "block", ("login",), ("signin",)),
    pattern_rule(r"[?&]utm_source=feed(&|#|$)", "allow", ("utm", "source", "feed")),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``; path: from there up to ``? #``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct runs of letters and digits of the lower-cased URL."""
    parts = F.split(lower_ascii(F.coalesce(url, F.lit(""))), TOKEN_BREAK)
    return F.array_distinct(F.array_remove(parts, ""))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule and branch; ``rule_id`` numbers these."""
    filed = [(r, tokens) for r in rules for tokens in r.branches]
    return spark.createDataFrame(
        [(i, r.name, r.action, r.kind, r.regex, list(t), r.on) for i, (r, t) in enumerate(filed)],
        "rule_id int, name string, action string, kind string, regex string, "
        "tokens array<string>, target string",
    )


def rarest_token_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each branch of a rule with the token of its own that the fewest URLs contain.

    ``tokens`` has one row per URL and token. Ties go to the longer, then the
    alphabetically first token. A rule without a token would have to run on
    every URL and is refused by a failing check.
    """
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    counts = (
        tokens.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("shortness"), "token"
    )
    best = (
        wanted.join(counts, "token", "left")
        .groupBy("rule_id")
        .agg(F.min(rank).alias("best"))
        .select("rule_id", F.col("best.token").alias("token"))
    )
    return rules.drop("tokens").join(best, "rule_id")


def judge_urls(
    pages: DataFrame,
    host_rules: Sequence[Rule] = HOST_RULES,
    patterns: Sequence[Rule] = PATTERNS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, pattern."""
    rules = [*host_rules, *patterns]
    bare = [r.name for r in rules if not r.branches or not all(r.branches)]
    if bare:
        raise ValueError(f"rules without a literal token: {bare}")
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`"))
    addresses = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        host.alias("host"),
        path.alias("path"),
    )
    tokens = addresses.select(
        "url", "host", "path", F.explode(url_tokens(F.col("url"))).alias("token")
    )
    index = rarest_token_index(rule_table(spark, rules), tokens)
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    target = F.when(F.col("target") == "url", lower_ascii(F.col("url"))).otherwise(
        F.concat("host", "path")
    )
    fitting = tokens.join(index, "token").filter(F.rlike(target, F.col("regex")))
    # Per distinct URL; hot URLs combine in the map tasks.
    is_host, is_pattern = F.col("kind") == "host", F.col("kind") == "pattern"
    longest = F.when(is_host, F.struct(F.length("name").alias("l"), "name", "action"))
    first = F.when(is_pattern, F.struct("action", "name"))
    per_url = fitting.groupBy("url").agg(F.max(longest).alias("h"), F.min(first).alias("p"))
    return (
        addresses.join(per_url, "url", "left")
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("h.name").alias("rule"),
            F.coalesce("h.action", "p.action", F.lit("allow")).alias("verdict"),
            F.when(F.col("h").isNull(), F.col("p.name")).alias("pattern"),
        )
    )
