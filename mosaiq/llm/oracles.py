"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from mosaiq.llm.quality import NAVIGATION, PHRASES, SEPARATORS, STOPS, TERMINAL, LineRules
from mosaiq.llm.sharding import BUCKETS

_RULES = LineRules()
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = "[#*$%&|<>]"
_WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_TERMINAL = TERMINAL.replace("'", "''")

QUALITY = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM docs),
placed AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) > 2),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM placed),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(3) r(k) WHERE n > 1 GROUP BY doc_id),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM words),
measured AS (
    SELECT *, trim(line, {_WS}) AS bare, len(regexp_extract_all(line, '{_WORD}')) AS n, length(line) - length(regexp_replace(line, '{_SYMBOL}', '', 'g')) AS symbols,
           row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS copy,
           contains('{STOPS}', right(trim(line, {_WS}), 1)) AS stopped, regexp_extract_all(line, '(?i){PHRASES}') AS found FROM each
),
lost AS (
    SELECT doc_id, sum(n) AS n FROM measured
    WHERE copy > 1 OR (NOT contains('{_TERMINAL}', right(bare, 1)) AND n < {_RULES.short_line}) OR (symbols > 0 AND symbols >= {_RULES.symbols_per_word} * n)
       OR (n <= {_RULES.boilerplate_words} AND (regexp_matches(bare, '(?i){NAVIGATION}') OR (NOT stopped AND NOT contains(bare, '«') AND len(regexp_extract_all(bare, '{SEPARATORS}')) > 1)
           OR len(found) > 1 OR (len(found) = 1 AND (2 * len(regexp_extract_all(found[1], '{_WORD}')) >= n OR (n <= {_RULES.call_words} AND NOT stopped)))))
    GROUP BY doc_id
),
base AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '{_SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS lost_words
    FROM words LEFT JOIN covered c USING (doc_id) LEFT JOIN lost l USING (doc_id)
),
judged AS (SELECT *, n_words < {_RULES.min_words} OR n_repeat_words > {_RULES.most_repeated} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, NOT base_failed AND lost_words <= {_RULES.most_lost} * n_words AS kept FROM judged
"""

_HASH = "CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', {})), 1, 15) AS BIGINT)"


def _shard(n: int) -> str:
    return f"(SELECT arg_min(s, (-ln(({_HASH.format('s')} + 0.5) / {float(1 << 60)!r}), s)) FROM range({n}) r(s))"


SHARDING = f"""
WITH table_of AS (SELECT list(list_reduce(list_concat([n], range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY n) AS crcs FROM range(256) r(n)),
rows_ AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
bytes AS (SELECT doc_id, t, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM rows_),
sums AS (
    SELECT doc_id, CAST(len(b) + 8 AS BIGINT) AS size,
           CAST(xor(list_reduce(list_concat([4294967295], b), lambda a, x: xor(a // 256, crcs[CAST(xor(a % 256, x) + 1 AS INTEGER)])), 4294967295) AS BIGINT) AS text_crc32
    FROM bytes, table_of
),
placed AS (SELECT *, CAST({_shard(24)} AS INTEGER) AS shard, CAST({_shard(25)} AS INTEGER) AS grown_shard, {_HASH.format("'bucket'")} % {BUCKETS} AS bucket FROM sums)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed
"""

_ESCAPED = r"\\|<\||</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"

CHAT = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
    UNION ALL SELECT -7, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn, role, said)) AS turns_sha256,
       CAST(coalesce(sum(length(said)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(said, '' ORDER BY turn, role, said) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(said) + len(regexp_extract_all(role, '{_ESCAPED}')) + len(regexp_extract_all(said, '{_ESCAPED}'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM words
),
sizes AS (SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs p JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * p.n >= 85 * (a.n + b.n - p.n)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id, coalesce(any_value(many), 0) AS n_links
FROM reach JOIN sizes USING (doc_id) LEFT JOIN (SELECT u AS doc_id, count(*) AS many FROM edges GROUP BY 1) USING (doc_id) GROUP BY doc_id
"""

FILTER_AUDIT = rf"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (
    SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failing
    FROM docs d LEFT JOIN marks m ON d.doc_id = m.doc_id
),
counts AS (SELECT part, failing, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, failing),
letters(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit <> b.bit AND a.bit <> c.bit AND a.bit <> d.bit AND a.bit <> e.bit AND b.bit <> c.bit AND b.bit <> d.bit AND b.bit <> e.bit AND c.bit <> d.bit AND c.bit <> e.bit AND d.bit <> e.bit
),
steps AS (SELECT filter_order, k AS step, bits[k] AS bit, list_sum(bits[1:k]) - bits[k] AS gone FROM orders, range(1, 6) r(k)),
told AS (
    SELECT part, filter_order, step, bit, sum(CASE WHEN failing & (gone + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN failing & bit > 0 AND failing & gone = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN failing & bit > 0 AND failing & gone > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failing = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN failing & bit > 0 AND failing & gone = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failing & bit > 0 AND failing & gone = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM told
"""

ORACLES: dict[str, str] = {
    "op5_chat": CHAT.strip(),
    "op7_ngram_join": NGRAM_JOIN.strip(),
    "op9_quality_rules": QUALITY.strip(),
    "op10_sharding": SHARDING.strip(),
    "op13_filter_audit": FILTER_AUDIT.strip(),
}
