"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from lagline.llm import conversation_trie, mixing, quality_rules, queries, sharding, url_filters


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACE = r"[\x20\x09-\x0D]+"
_WORD_CHARS = rf"length(regexp_replace({{0}}, '{_SPACE}', '', 'g'))"
_WORDS = rf"list_filter(regexp_split_to_array({{0}}, '{_SPACE}'), lambda w: w <> '')"
_NOISE = "length({0}) - length(translate({0}, '#*$%&|<>', ''))"
_RULES = quality_rules.LineRules()

_OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format("t")} AS words FROM d),
starts AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5
),
grams AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS gram FROM starts),
twice AS (SELECT doc_id, gram FROM grams GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (
    SELECT g.doc_id, count(DISTINCT g.i + k.k) AS n
    FROM grams g JOIN twice USING (doc_id, gram), range(5) AS k(k) GROUP BY g.doc_id
),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
facts AS (
    SELECT doc_id, line, {_WORD_CHARS.format("line")} AS chars,
           len({_WORDS.format("line")}) AS words,
           {_NOISE.format("line")} AS noise,
           length(line) - length(translate(line, '|»•', '')) AS bars,
           (length(line) - length(replace(line, '!!', ''))) / 2 AS marks,
           regexp_matches(line, {_quoted(quality_rules.SENTENCE_END)}) AS ended,
           length(line) <= {_RULES.boilerplate_chars}
               AND regexp_matches(lower(line), {_quoted("|".join(_RULES.boilerplate))}) AS stock
    FROM lines
),
by_line AS (
    SELECT doc_id,
           count(line) FILTER (chars > 0)
               - count(DISTINCT line) FILTER (chars > 0) AS n_dup_lines,
           coalesce(sum(chars) FILTER (
               chars > 0 AND (bars * 100 > words * {_RULES.separators_per_100_words}
                   OR NOT ended
                   OR noise * 100 > words * {_RULES.noise_per_100_words}
                   OR marks * 100 > words * {_RULES.noise_per_100_words}
                   OR stock)), 0) AS lost_chars
    FROM facts GROUP BY doc_id
),
total AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_words,
           {_WORD_CHARS.format("t")}::BIGINT AS word_chars,
           ({_NOISE.format("t")})::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           lost_chars::BIGINT AS lost_chars
    FROM w LEFT JOIN covered USING (doc_id) JOIN by_line USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
           AND lost_chars <= {_RULES.max_lost} * word_chars AS kept
FROM total
"""

_OP3 = """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)
"""

# CRC-32 from its definition: a table of 256 remainders, then one step per byte.
_CRC_TABLE = """steps(n, c, k) AS (
    SELECT range, range::BIGINT, 0 FROM range(256)
    UNION ALL
    SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1
    FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS remainders FROM steps WHERE k = 8)"""
_CRC = """xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(1, strlen(t) + 1),
            lambda i: ('0x' || substr(hex(encode(t)), 2 * i - 1, 2))::BIGINT)),
        lambda c, b: xor(c // 256, remainders[xor(c % 256, b) + 1])))::BIGINT"""

_OP6 = f"""
WITH RECURSIVE {_CRC_TABLE},
texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
sums AS (SELECT t, {_CRC} AS text_crc32 FROM texts, crc),
ranked AS (
    SELECT doc_id, source, coalesce(text, '') AS t,
           row_number() OVER (PARTITION BY source ORDER BY
               ('0x' || substr(md5('{sharding.SEED}:' || doc_id), 1, 12))::BIGINT, doc_id) AS r,
           count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total
    FROM documents
),
placed AS (
    SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2.0 * n)::DOUBLE, source, r) - 1 AS place
    FROM ranked
),
cut AS (SELECT *, (place * {sharding.SHARDS}) // total AS s FROM placed)
SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, text_crc32, 'rows' AS law, s::INTEGER AS shard,
       (place - (s * total + {sharding.SHARDS - 1}) // {sharding.SHARDS})::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM cut JOIN sums USING (t)
"""

_LISTED = ", ".join(
    f"({_quoted('/'.join(path))}, {weight})" for path, weight in queries.MIXTURE.items()
)
_DOMAIN = f"""CASE WHEN n < {queries.WEB_SOURCES} THEN 'web' WHEN n < {queries.BOOK_SOURCES} THEN 'books'
    WHEN n < {queries.CODE_SOURCES} THEN 'code' ELSE 'forums' END"""


def _shared(level: int) -> str:
    """Budgets of one level of the tree from those of the level above."""
    keys = ["domain", "lang", "source"][:level]
    parents = ", ".join(keys[:-1])
    by = f"PARTITION BY {parents}" if parents else ""
    above = f"budgets{level - 1}"
    on = f"JOIN {above} p USING ({parents})" if parents else f"CROSS JOIN {above} p"
    order = f"ORDER BY capacity / weight, {keys[-1]}"
    return f"""
nodes{level} AS (
    SELECT {", ".join(keys)}, sum(capacity)::DOUBLE AS capacity,
           coalesce((SELECT w FROM listed WHERE path = concat_ws('/', {", ".join(keys)})), 1) AS weight
    FROM leaves GROUP BY {", ".join(keys)}
),
ordered{level} AS (
    SELECT n.*, p.budget AS above,
           coalesce(sum(capacity) OVER ({by} {order}
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
           sum(weight) OVER ({by} {order}
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
    FROM nodes{level} n {on}
),
flagged{level} AS (
    SELECT *, capacity * weights <= weight * (above - taken) AS is_full FROM ordered{level}
),
budgets{level} AS (
    SELECT {", ".join(keys)}, round(CASE WHEN is_full THEN capacity ELSE weight * (above
               - coalesce(sum(capacity) FILTER (is_full) OVER ({by}), 0))
               / sum(weight) FILTER (NOT is_full) OVER ({by}) END, 3) AS budget
    FROM flagged{level}
)"""


_OP7 = rf"""
WITH listed(path, w) AS (VALUES {_LISTED}),
numbered AS (
    SELECT doc_id, lang, source, try_cast(regexp_extract(source, '^src([0-9]+)$', 1) AS INTEGER) AS n,
           len({_WORDS.format("coalesce(text, '')")}) AS tokens
    FROM documents
),
d AS (SELECT *, {_DOMAIN} AS domain FROM numbered),
leaves AS (
    SELECT domain, lang, source, sum(tokens) AS supply, sum(tokens) * {mixing.MAX_EPOCHS} AS capacity
    FROM d GROUP BY ALL
),
budgets0 AS (SELECT least(sum(supply), sum(capacity))::DOUBLE AS budget FROM leaves),
{_shared(1)},
{_shared(2)},
{_shared(3)},
cut AS (
    SELECT d.*, CASE WHEN supply > 0 THEN floor(budget / supply)::BIGINT ELSE 0 END AS epochs,
           budget, supply
    FROM d JOIN leaves USING (domain, lang, source) JOIN budgets3 USING (domain, lang, source)
),
ordered AS (
    SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY
               ('0x' || substr(md5('{mixing.SEED}:' || epochs || ':' || doc_id), 1, 12))::BIGINT,
               doc_id) AS so_far
    FROM cut
),
copies AS (
    SELECT *, epochs + (so_far <= budget - epochs * supply)::BIGINT AS copies FROM ordered
)
SELECT doc_id, domain, lang, source, unnest(range(copies))::INTEGER AS copy FROM copies
"""

_URL = r"""
    CASE WHEN host <> '' THEN host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(rest, '([?&])(utm_[a-z]+|gclid|fbclid)=[^&]*', '\1', 'g'),
        '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/$', '') END"""
_OP9 = rf"""
WITH bare AS (
    SELECT page_id, html, regexp_replace(
               regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '#.*$', '') AS u
    FROM pages
),
parts AS (
    SELECT page_id, html,
           regexp_replace(regexp_replace(translate(
               regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1),
               '{url_filters.UPPER}', '{url_filters.UPPER.lower()}'), '^www\.', ''),
               ':(80|443)$', '') AS host,
           regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS rest
    FROM bare
),
named AS (
    SELECT page_id, {_URL} AS canonical_url, sha256(html) AS digest,
           '"' || substr(md5(html), 1, 16) || '"' AS tag, strlen(html) AS size,
           page_id * {queries.PAGE_SECONDS} AS seconds
    FROM parts
),
linked AS (
    SELECT r.page_id, r.canonical_url, r.tag, r.seconds, max(f.page_id) AS found
    FROM named r LEFT JOIN named f
      ON f.canonical_url = r.canonical_url
     AND f.seconds < r.seconds + {queries.REVISIT_SECONDS} AND f.digest IS NOT NULL
    GROUP BY ALL
),
judged AS (
    SELECT l.*, f.digest, f.size, CASE WHEN found IS NULL THEN 'unresolved'
           WHEN f.tag = l.tag THEN 'confirmed' ELSE 'changed' END AS outcome
    FROM linked l LEFT JOIN named f ON f.page_id = l.found
)
SELECT 2 * page_id + 1 AS record_id, canonical_url, outcome, 2 * found AS response_id,
       CASE WHEN outcome = 'confirmed' THEN digest END AS payload_sha256,
       CASE WHEN outcome = 'confirmed' THEN concat_ws(chr(10),
           'cache-control: max-age=600', 'content-length: ' || size,
           'content-type: text/html; charset=utf-8', 'date: ' || (seconds + {queries.REVISIT_SECONDS}),
           'etag: W/' || tag, 'vary: Accept-Encoding') END AS headers
FROM judged
"""

_OP10_RULES = ", ".join(
    f"({_quoted(r.name)}, {_quoted(r.action)}, {_quoted(r.name.partition('/')[0])}, "
    f"{_quoted('/' + r.name.partition('/')[2])})"
    for r in url_filters.HOST_RULES
)
_OP10_PATTERNS = ", ".join(
    f"({_quoted(r.regex)}, {_quoted(r.action)})" for r in url_filters.PATTERNS
)
_OP10 = rf"""
WITH rules(rule, action, rule_host, rule_path) AS (VALUES {_OP10_RULES}),
patterns(pattern, action) AS (VALUES {_OP10_PATTERNS}),
cut AS (
    SELECT page_id, coalesce(url, '') AS url,
           CASE WHEN contains(url, '://')
                THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
),
parts AS (
    SELECT page_id, translate(url, '{url_filters.UPPER}', '{url_filters.UPPER.lower()}') AS low,
           translate(regexp_extract(rest, '^([^/?#]*)', 1),
                     '{url_filters.UPPER}', '{url_filters.UPPER.lower()}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
),
hosted AS (
    SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
    FROM parts JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
),
matched AS (
    SELECT page_id, arg_min(pattern, (action, pattern)) AS pattern, min(action) AS action
    FROM parts JOIN patterns ON regexp_matches(low, pattern) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(h.action, m.action, 'allow') AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM parts LEFT JOIN hosted h USING (page_id) LEFT JOIN matched m USING (page_id)
"""

# A node is the list of its turns' digests, written one after the other.
_OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, strlen(coalesce(text, ''))::BIGINT AS bytes,
           sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
           turn
    FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (
    SELECT conv_id, digest, bytes,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS place
    FROM turns
),
sizes AS (SELECT conv_id, count(*) AS n, conv_id::VARCHAR AS t FROM placed GROUP BY conv_id),
convs AS (
    SELECT s.conv_id, s.conv_id - s.conv_id % {conversation_trie.GROUP} AS lender,
           {_CRC} % {conversation_trie.HEADS} AS h
    FROM sizes s, crc
),
lent AS (SELECT c.*, least(h, coalesce(n, 0)) AS borrowed FROM convs c LEFT JOIN sizes s ON s.conv_id = lender),
rebuilt AS (
    SELECT l.conv_id, place AS depth, digest, bytes FROM lent l JOIN placed p ON p.conv_id = lender AND place <= borrowed
    UNION ALL
    SELECT l.conv_id, borrowed + place - h, digest, bytes
    FROM lent l JOIN placed p ON p.conv_id = l.conv_id AND place > h
),
prefixes AS (
    SELECT conv_id, depth, bytes,
           string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key,
           count(*) OVER (PARTITION BY conv_id) AS length
    FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, 0, '', (SELECT count(*) FROM rebuilt r WHERE r.conv_id = l.conv_id) FROM lent l
),
nodes AS (
    SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
    FROM prefixes GROUP BY key, depth
),
children AS (SELECT left(key, 64 * (depth::INTEGER - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
above AS (
    SELECT left(key, 64 * unnest(range(depth::INTEGER + 1))::INTEGER) AS key,
           (n_children = 0)::BIGINT AS is_leaf, (n_convs - 1) * bytes AS saved
    FROM counted
),
summed AS (SELECT key, sum(is_leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY key)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens,
       c.ends_sha256
FROM counted c JOIN summed USING (key) LEFT JOIN nodes p ON c.depth > 0 AND p.key = left(c.key, 64 * (c.depth::INTEGER - 1))
"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": _OP2,
    "op3_exact_dedup": _OP3,
    "op6_sharding": _OP6,
    "op7_mixing": _OP7,
    "op9_warc": _OP9,
    "op10_url_filters": _OP10,
    "op12_conversation_trie": _OP12,
}
