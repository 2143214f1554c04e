"""DuckDB SQL for the queries whose rows SQL can give."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"

DECONTAMINATION = """
WITH folded AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS text
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i)
  WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS text
  FROM folded, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), found AS (SELECT r, i, n, item_id FROM starts JOIN windows USING (n, text)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY r),
named AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

LONG_PASSAGES = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
  SELECT r, doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h
  FROM split, unnest(range(1, len(w) - 48)) AS t(i) WHERE doc_id IS NOT NULL
), firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT r, p FROM windows JOIN firsts USING (h), unnest(range(i, i + 50)) AS t(p) WHERE first < doc_id
), lists AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT r, p, w[p] AS word FROM split, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
"""

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5('mix-' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3 * source_size AS cap,
    ((SELECT sum(source_size) FROM sources) - coalesce(sum(3 * source_size) OVER earlier, 0))::DOUBLE / sum(w) OVER later AS level,
    row_number() OVER (ORDER BY 3.0 * source_size / w, source) AS k
  FROM sources
  WINDOW earlier AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    later AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), cut AS (SELECT coalesce(min(k), (SELECT max(k) + 1 FROM levels)) AS k FROM levels WHERE w * level <= cap),
targets AS (
  SELECT source, source_size,
    CASE WHEN k < (SELECT k FROM cut) THEN cap::DOUBLE ELSE w * (SELECT level FROM levels WHERE k = (SELECT k FROM cut)) END AS target
  FROM levels
), spans AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM sized
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE
    (round(target)::BIGINT // source_size) * size + greatest(0, least(b + size, round(target)::BIGINT % source_size) - b)
  END::BIGINT AS taken
FROM spans JOIN targets ON spans.source IS NOT DISTINCT FROM targets.source
"""

QUALITY = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents
), sizes AS (SELECT unnest([3, 10, 51]) AS n),
windows AS (
  SELECT r, n, i, sha256(array_to_string(w[i : i + n - 1], ' ')) AS h FROM split, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), twice AS (SELECT r, n, h FROM windows GROUP BY r, n, h HAVING count(*) > 1),
again AS (SELECT r, n, i FROM windows SEMI JOIN twice USING (r, n, h)),
marked AS (SELECT r, n, count(DISTINCT p) AS c FROM again, unnest(range(i, i + n)) AS t(p) GROUP BY r, n),
wide AS (
  SELECT r, coalesce(sum(c) FILTER (n = 3), 0) AS c3, coalesce(sum(c) FILTER (n = 10), 0) AS c10, count(*) FILTER (n = 51) AS c51
  FROM marked GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM split, unnest(string_split(text, chr(10))) AS t(line)
  WHERE regexp_matches(line, '{WORD}') GROUP BY r
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c3, 0)::BIGINT AS n_repeat_words, coalesce(c10, 0)::BIGINT AS n_covered,
    coalesce(c51, 0) > 0 AS long_repeat
  FROM split LEFT JOIN wide USING (r) LEFT JOIN lines USING (r)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, base_failed,
  NOT base_failed AND NOT long_repeat AND 100 * n_covered <= 20 * n_words AS kept
FROM failed
"""

_HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Patterns of the production rule set as regular expressions on the lower-cased url.
_PATTERNS = [
    ("block", r"^.*\.casino-.*$"),
    ("block", r"^.*/casino-.*$"),
    *[("block", rf"^.*(?:[^a-z0-9]|^|$){word}(?:[^a-z0-9]|^|$).*$") for word in ("poker", "viagra", "xxx", "porn")],
    ("block", r"^.*/cart/.*$"),
    ("block", r"^.*/login(?:[^a-z0-9]|^|$).*$"),
    ("block", r"^.*/wp-admin/.*$"),
    ("block", r"^.*(?:[^a-z0-9]|^|$)sessionid=.*$"),
    ("allow", r"^.*\.casino-history\..*$"),
]

URLS = f"""
WITH rests AS (
  SELECT row_number() OVER () AS r, page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT r, page_id, lower(url) AS plain,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
), rules AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in _HOST_RULES)}) AS t(action, h, p)),
patterns AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{x}')" for a, x in _PATTERNS)}) AS t(action, regex)),
hosts AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
), others AS (
  SELECT r, min(action) AS action FROM parts JOIN patterns ON regexp_matches(plain, regex, 's') GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(hosts.action, others.action, 'allow') AS verdict
FROM parts LEFT JOIN hosts USING (r) LEFT JOIN others USING (r)
"""

CHAT = """
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t
), sized AS (
  SELECT *, row_number() OVER turns - 1 AS n,
    4 + len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]{1,4}')) AS tokens,
    length(regexp_replace(text, '([<\\[])(\\\\*)(\\||/?s>|/?INST\\])', '\\1\\2\\\\\\3', 'g')) + length(role) + 24 AS chars
  FROM raw WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), heads AS (SELECT conv_id, tokens AS s_tokens, chars AS s_chars FROM sized WHERE n = 0 AND role = 'system'),
placed AS (
  SELECT sized.*, coalesce(s_tokens, 0) AS s_tokens, n = 0 AND role = 'system' AS sys, greatest((512 - coalesce(s_tokens, 0)) // 2, 64) AS stride,
    coalesce(sum(CASE WHEN n = 0 AND role = 'system' THEN 0 ELSE tokens END) OVER (
      PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized LEFT JOIN heads USING (conv_id)
), ends AS (SELECT *, CASE WHEN sys THEN 0 ELSE start + tokens END AS stop FROM placed),
cells AS (
  SELECT *, start // stride AS cell, stop > (start // stride + 1) * stride + stride // 2 AS alone FROM ends
), spans AS (
  SELECT conv_id, cell, alone, min(n) AS first, min(start) AS low, max(stop) AS high, max(s_tokens) AS s_tokens
  FROM cells GROUP BY ALL
), past AS (
  SELECT conv_id, sum(chars) AS chars FROM spans JOIN cells c USING (conv_id)
  WHERE NOT sys AND stop <= low AND c.start >= low - greatest(0, least(128, 512 - spans.s_tokens - (high - low))) GROUP BY conv_id
), again AS (SELECT conv_id, count(*) * any_value(s_chars) AS chars FROM spans JOIN heads USING (conv_id) WHERE first > 0 GROUP BY conv_id),
whole AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (whole.chars + coalesce(past.chars, 0) + coalesce(again.chars, 0))::BIGINT AS formatted_chars
FROM whole LEFT JOIN past USING (conv_id) LEFT JOIN again USING (conv_id)
"""

ORACLE = {
    "op2_decontamination": DECONTAMINATION,
    "op3_chat_windows": CHAT,
    "op5_mixing": MIXING,
    "op6_repetition": QUALITY,
    "op7_debruijn": LONG_PASSAGES,
    "op8_sparse_suffix": LONG_PASSAGES,
    "op10_url_rules": URLS,
}
