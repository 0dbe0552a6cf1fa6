"""DuckDB SQL for the operators that SQL expresses; the others are tested against
brute force."""

from __future__ import annotations

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN payload_bytes >= 100 AND d.page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND d.page_id > first_id THEN CAST(first_id AS BIGINT) END AS refers_to
FROM d JOIN f USING (payload_digest)
"""

# Every control string inside a role or text gets a sign in front.
_CHAT = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(role, '(␛*(?:</?s>|\[/?INST\]|<</?SYS>>))', '␛\1', 'g'))
            + length(regexp_replace(text, '(␛*(?:</?s>|\[/?INST\]|<</?SYS>>))', '␛\1', 'g')) AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(length(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(17 + chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

# Dated entries to intervals, and every capture against the intervals at its time.
_URLS = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, url, TIMESTAMP '2023-01-01 00:00:00' + to_minutes(CAST(page_id * 7919 % 1051200 AS BIGINT)) AS fetched,
         lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM pages),
labels_of AS (SELECT rid, string_split(host, '.') AS l FROM p WHERE host <> ''),
asked AS (
  SELECT rid, array_to_string(l[i:], '.') AS key FROM (SELECT rid, l, unnest(range(1, greatest(1, len(l) - 1) + 1)) AS i FROM labels_of)
  UNION SELECT rid, host || '/' || segment FROM p WHERE host <> '' AND segment <> ''),
keys AS (SELECT key, length(key) * 31 + ascii(key) * 17 + ascii(substring(key, length(key) - 1, 1)) * 7 AS s FROM (SELECT DISTINCT key FROM asked)),
entries AS (
  SELECT CASE WHEN s % 2 = 0 THEN 'adult' ELSE 'malware' END AS category, key, CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END AS action,
         TIMESTAMP '2023-01-01 00:00:00' + to_minutes(CAST((s * 613 + k * 175200) % 1051200 AS BIGINT)) AS listed_at
  FROM (SELECT key, s, unnest(range(0, 6)) AS k FROM keys WHERE s % 3 = 0)),
once AS (SELECT category, key, listed_at, max(action) AS action FROM entries GROUP BY ALL),
changes AS (
  SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY category, key ORDER BY listed_at) AS was FROM once) WHERE was IS NULL OR was <> action),
spans AS (SELECT *, lead(listed_at) OVER (PARTITION BY category, key ORDER BY listed_at) AS until FROM changes),
hits AS (
  SELECT rid, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
  FROM asked JOIN p USING (rid) JOIN spans USING (key)
  WHERE spans.action = 'add' AND fetched >= listed_at AND (until IS NULL OR fetched < until) GROUP BY rid)
SELECT page_id, url, strftime(fetched, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(categories, '') AS categories, categories IS NOT NULL AS blocked
FROM p LEFT JOIN hits USING (rid)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _decontaminate(size: int = 13) -> str:
    """Windows of an item by length (a short item has one), against the runs of as many words of each document."""
    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    run = lambda n: " || ' ' || ".join(["word", *[f"w{k}" for k in range(1, n)]])
    leads = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, size))
    found = " UNION ".join(f"SELECT rid, p, {n} AS n, item_id FROM runs JOIN windows ON windows.n = {n} AND key = {run(n)}" for n in range(1, size + 1))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS l FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS l FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(l[s:s + n - 1], ' ') AS key
  FROM (SELECT item_id, l, least({size}, len(l)) AS n, unnest(range(1, len(l) - least({size}, len(l)) + 2)) AS s FROM b WHERE len(l) > 0)),
words AS (SELECT rid, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM d),
runs AS MATERIALIZED (SELECT rid, p, word, {leads} FROM words WINDOW o AS (PARTITION BY rid ORDER BY p)),
found AS MATERIALIZED ({found}),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def _quality(window: int = 8) -> str:
    """The base counts, and lines in more than 10 and 5 % of a host's distinct texts, removed but at their first holder."""
    blank = r"[^\x20\x09-\x0D]+"
    run = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, window)]])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{blank}') AS l FROM documents),
words AS (SELECT rid, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p FROM d),
runs AS (SELECT rid, p, {run} AS key FROM words WINDOW o AS (PARTITION BY rid ORDER BY p)),
twice AS (SELECT rid, p, CASE WHEN key IS NOT NULL AND count(*) OVER (PARTITION BY rid, key) > 1 THEN 1 ELSE 0 END AS r FROM runs),
covered AS (SELECT rid, max(r) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS c FROM twice),
repeats AS (SELECT rid, sum(c) AS n FROM covered GROUP BY rid),
chars AS (SELECT rid, sum(length(word)) AS n FROM words GROUP BY rid),
lines AS (
  SELECT rid, line, array_to_string(ws, ' ') AS norm, len(ws) AS n
  FROM (SELECT rid, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{blank}') AS ws
        FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)) WHERE len(ws) > 0),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT text) + CAST(max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS size FROM d GROUP BY source),
held AS (SELECT source, norm, count(DISTINCT t) AS n, min(doc_id) AS first_id FROM lines JOIN d USING (rid) GROUP BY source, norm),
frequent AS (SELECT h.source, norm, first_id FROM held h JOIN hosts s ON h.source IS NOT DISTINCT FROM s.source WHERE n > 10 AND n * 100 > size * 5),
gone AS (
  SELECT rid, sum(lines.n) AS n FROM lines JOIN d USING (rid) JOIN frequent f ON f.norm = lines.norm AND f.source IS NOT DISTINCT FROM d.source
  WHERE d.doc_id IS DISTINCT FROM first_id GROUP BY rid),
s AS (
  SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(chars.n, 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed
  FROM d LEFT JOIN repeats USING (rid) LEFT JOIN chars USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN gone USING (rid))
SELECT * EXCLUDE (removed), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT 100 * (n_words - removed) < 30 * n_words AS kept
FROM s
"""


# CRC-32 of UTF-8 bytes: the table of 256 steps, and one step a byte.
_CRC_TABLE = """
steps(i, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8)"""


def _crc(text: str) -> str:
    code = lambda at: f"(strpos('0123456789ABCDEF', substr(h, {at}, 1)) - 1)"
    read = f"list_transform(range(1, length(h), 2), lambda i: CAST({code('CAST(i AS INTEGER)')} * 16 + {code('CAST(i AS INTEGER) + 1')} AS BIGINT))"
    return (f"(SELECT xor(list_reduce(list_concat([4294967295], {read}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) "
            f"FROM (SELECT hex(encode({text})) AS h) x, tab)")


def _trie(family: int = 5, most: int = 9) -> str:
    """Conversations rebuilt, prefixes as joined turns, and the sums of a subtree over the ancestors of its nodes."""
    return f"""
WITH RECURSIVE {_CRC_TABLE},
t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS place, octet_length(encode(text)) AS bytes,
         md5(length(role) || ':' || role || text) AS turn_key FROM t),
convs AS (SELECT c, c - (c % {family} + {family}) % {family} AS base, {_crc("CAST(c AS VARCHAR)")} % {most} AS h FROM (SELECT DISTINCT c FROM own)),
made AS (
  SELECT convs.c, 1 AS part, place, bytes, turn_key FROM convs JOIN own ON own.c = base AND place <= h
  UNION ALL SELECT c, 2, place, bytes, turn_key FROM own JOIN convs USING (c) WHERE place > h),
steps_of AS (
  SELECT c, row_number() OVER o AS d, bytes, string_agg(turn_key, ',') OVER (PARTITION BY c ORDER BY part, place ROWS UNBOUNDED PRECEDING) AS key
  FROM made WINDOW o AS (PARTITION BY c ORDER BY part, place)
  UNION ALL SELECT c, 0, 0, '' FROM convs),
ends AS (SELECT c, max(d) AS d FROM steps_of GROUP BY c),
nodes AS (
  SELECT steps_of.d, key, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends.d = steps_of.d) AS ids,
         count(*) FILTER (WHERE ends.d = steps_of.d) AS n_ends
  FROM steps_of JOIN ends USING (c) GROUP BY steps_of.d, key),
paths AS (
  SELECT a.d AS d, a.key AS key, n.d AS under, n.n_convs, n.bytes, n.n_ends FROM nodes n JOIN steps_of a ON a.c = n.conv_id AND a.d <= n.d),
sums AS (
  SELECT d, key, count(*) FILTER (WHERE under = d + 1) AS n_children, count(*) FILTER (WHERE n_ends = n_convs) AS n_leaves,
         sum(CASE WHEN under > 0 THEN (n_convs - 1) * bytes ELSE 0 END) AS saved
  FROM paths GROUP BY d, key)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.key = n.key
LEFT JOIN steps_of u ON u.c = n.conv_id AND u.d = n.d - 1 LEFT JOIN nodes p ON p.d = u.d AND p.key = u.key
"""


def _resample(buckets: int = 10_000, seed: int = 2024, percent: int = 10, least: int = 20) -> str:
    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS l FROM documents),
raw AS (SELECT rid, unnest(l) AS w FROM d),
target AS (SELECT unnest({words}) AS w FROM benchmark),
codes AS MATERIALIZED (SELECT w, {_crc("w")} % {buckets} AS b FROM (SELECT w FROM raw UNION SELECT w FROM target)),
s AS (SELECT b, count(*) AS n FROM raw JOIN codes USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM target JOIN codes USING (w) GROUP BY b),
sizes AS (SELECT (SELECT count(*) FROM raw) AS s_all, (SELECT count(*) FROM target) AS t_all),
gains AS (
  SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(s_all + {buckets} AS DOUBLE)) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST(t_all + {buckets} AS DOUBLE)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (b) CROSS JOIN sizes),
weights AS (SELECT rid, sum(gain) AS weight FROM raw JOIN codes USING (w) JOIN gains USING (b) GROUP BY rid),
noise AS (
  SELECT rid, list_reduce(list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', substr(hash, CAST(i AS INTEGER), 1)) - 1 AS BIGINT)), lambda a, x: a * 16 + x) AS h
  FROM (SELECT rid, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM d)),
scored AS (
  SELECT rid, doc_id, CAST(len(l) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (rid) JOIN noise USING (rid)),
ranks AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE n_features >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * (SELECT count(*) FROM ranks) // 100 THEN place END AS rank
FROM scored LEFT JOIN ranks USING (rid)
"""


ORACLES = {"op3_url_filter": _URLS, "op4_decontaminate": _decontaminate(), "op7_warc": _WARC, "op9_chat_format": _CHAT, "op10_quality_rules": _quality(),
           "op11_prefix_trie": _trie(), "op13_resample": _resample()}
