"""DuckDB SQL of the queries that SQL can express."""

from seqtrail.llm import chat
from seqtrail.llm.quality_rules import ERROR, MIN_WORDS, RISK, RULES, path_levels

ORACLES: dict[str, str] = {}

ORACLES["op1_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLES["op5_url_filter"] = r"""
WITH u AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS raw,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.action,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS place
  FROM h JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.place = 1
"""


def _quality_sql() -> str:
    scores = ", ".join(f"coalesce(({score}) * 1e0, 0) AS s_{name}" for name, (score, _) in RULES.items())
    levels = path_levels()
    rejected = " UNION ALL ".join(
        f"SELECT stratum, {at} AS level, count(*) FILTER ({' OR '.join(f's_{name} > {c!r} * 1e0' for name, c in level.items())}) AS rejected"
        " FROM holdout GROUP BY stratum"
        for at, level in enumerate(levels)
    )
    over = " OR ".join(
        f"level = {at} AND ({' OR '.join(f's_{name} > {c!r} * 1e0' for name, c in level.items())})" for at, level in enumerate(levels)
    )
    return rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM windows
  JOIN (SELECT doc_id, a, b, c FROM windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, a, b, c)
  CROSS JOIN (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
base AS MATERIALIZED (
  SELECT doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
counts AS MATERIALIZED (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {scores} FROM base),
holdout AS MATERIALIZED (
  SELECT * FROM counts WHERE NOT base_failed
    AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1)),
sizes AS MATERIALIZED (SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM holdout GROUP BY stratum),
terms AS (
  SELECT stratum, n, strata, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({RISK!r})
    + (n - k) * ln(1 - {RISK!r})) AS p
  FROM (SELECT *, unnest(range(0, CAST(floor(n * {RISK!r}) AS BIGINT) + 1)) AS k FROM sizes)),
allowed AS MATERIALIZED (
  SELECT stratum, max(k) AS allowed FROM (
    SELECT *, sum(p) OVER (PARTITION BY stratum ORDER BY k) AS below FROM terms)
  WHERE below <= {ERROR!r} / strata GROUP BY stratum),
best AS MATERIALIZED (
  SELECT stratum, max(level) AS level FROM ({rejected}) JOIN allowed USING (stratum)
  WHERE rejected <= allowed GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({over}, false) AS kept
FROM counts LEFT JOIN best USING (stratum)
"""


ORACLES["op3_quality_rules"] = _quality_sql()


def _chat_sql() -> str:
    template = chat.Template()
    escaped = r"replace(text, '\', '\\')"
    for control in template.controls:
        escaped = rf"replace({escaped}, '{control}', '{control[0]}\{control[1:]}')"
    role = escaped.replace("(text,", "(role,")
    opening = " ".join(f"WHEN '{name}' THEN {len(mark)}" for name, mark in template.openings)
    marks = len(template.role_open) + len(template.role_close)
    trained = ", ".join(f"'{name}'" for name in template.trained)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length({escaped}) AS chars, role IN ({trained}) AS trained,
    CASE role {opening} ELSE {marks} + length({role}) END AS opening,
    lag(role) OVER (PARTITION BY conv_id {order}) IS DISTINCT FROM role AS first
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (trained), '')) AS loss_sha256,
  CAST({len(template.begin)} + sum(chars + CASE WHEN first THEN opening + {len(template.end)} ELSE {len(template.joint)} END) AS BIGINT)
    AS formatted_chars
FROM e GROUP BY conv_id
"""


ORACLES["op11_chat"] = _chat_sql()


# CRC-32 of a decimal number, bit by bit: SQL has no function for it.
CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END,
      xor(crc, byte)), 4294967295), 4294967295)"""

ORACLES["op12_prefix_trie"] = rf"""
WITH o AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS MATERIALIZED (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, {CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
rebuilt AS MATERIALIZED (
  SELECT c, strlen(text) AS size, sha256(role || chr(31) || text) AS turn, row_number() OVER (PARTITION BY c ORDER BY part, place) AS depth
  FROM (
    SELECT c, 0 AS part, place, role, text FROM ids JOIN o ON o.conv_id = base AND place <= h
    UNION ALL SELECT c, 1, place, role, text FROM ids JOIN o ON o.conv_id = c AND place > h)),
paths AS MATERIALIZED (
  SELECT c, depth, size, sha256(string_agg(turn, '') OVER w) AS node,
    count(*) OVER (PARTITION BY c) = depth AS last
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY depth)
  UNION ALL SELECT c, 0, 0, 'root', c NOT IN (SELECT c FROM rebuilt) FROM ids),
nodes AS MATERIALIZED (
  SELECT node, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n, any_value(size) AS size,
    count(*) = count(*) FILTER (last) AS leaf, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends
  FROM paths GROUP BY node),
steps AS MATERIALIZED (SELECT DISTINCT b.node, a.node AS parent FROM paths a JOIN paths b ON a.c = b.c AND b.depth = a.depth + 1),
below AS (
  SELECT top, count(*) FILTER (leaf) AS n_leaves, sum((n - 1) * size) AS saved
  FROM (SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.c = b.c AND b.depth >= a.depth) JOIN nodes USING (node)
  GROUP BY top)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n AS n_convs,
  (SELECT count(*) FROM steps s WHERE s.parent = v.node) AS n_children,
  n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN below ON top = v.node LEFT JOIN steps USING (node) LEFT JOIN nodes p ON p.node = steps.parent
"""


def _terms_sql(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"regexp_extract_all(translate({text}, '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLES["op13_lexical_search"] = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, {_terms_sql("text")} AS terms FROM documents WHERE text IS NOT NULL),
held AS MATERIALIZED (SELECT doc, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
sizes AS (SELECT count(*) AS docs, sum(n) AS words FROM held),
p AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY doc, term),
q AS MATERIALIZED (
  SELECT item, item_id, term, count(*) AS repeats
  FROM (SELECT row_number() OVER () AS item, item_id, unnest({_terms_sql("text")}) AS term FROM benchmark) GROUP BY ALL),
w AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), sizes),
m AS (SELECT doc, doc_id, 75 + (25 * n * docs) // CAST(words AS BIGINT) AS m FROM held, sizes),
scores AS (
  SELECT item, item_id, doc_id, doc, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, doc) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
