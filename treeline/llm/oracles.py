"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
r AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, r.k IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.k = r.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) > 8),
h AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS x FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  length(regexp_replace(t, '[\x20\x09-\x0D!-@\[-`{-~]', '', 'g'))::BIGINT AS n_letters,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i-1]))::BIGINT AS n_same_next
  FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
  + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 4 ELSE 0 END + CASE WHEN 4 * n_symbols > n_words THEN 8 ELSE 0 END
  + CASE WHEN n_words > 0 AND (2 * word_chars < 3 * n_words OR word_chars > 40 * n_words) THEN 16 ELSE 0 END
  + CASE WHEN 10 * n_letters < 3 * word_chars THEN 32 ELSE 0 END
  + CASE WHEN 100 * n_same_next > 30 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""

OP1 = r"""
WITH lo AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lo),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
s AS (SELECT item_id, ws, least(13, len(ws)) AS l, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS x FROM s),
g AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS x
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM s) WHERE len(ws) >= l)),
m AS (SELECT DISTINCT g.doc_id, g.l, g.i, win.item_id FROM g JOIN win ON g.x = win.x AND g.l = win.l),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: kind, expression, group, least length: the fixed values of the secret scan, for RE2.
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("cloud", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("url_login", r"[A-Za-z][A-Za-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@", 0, 0),
)


def _secrets_sql() -> str:
    parts = []
    for i, (kind, pattern, group, least) in enumerate(SECRETS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {i} AS k, '{kind}' AS kind, unnest(f) AS m, unnest(v) AS v, unnest(range(1, len(f) + 1)) AS j, f, g "
            f"FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS f, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM d)"
        )
    lengths = " ".join(f"WHEN {i} THEN {x[3]}" for i, x in enumerate(SECRETS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, k, kind, v, length(m) AS n, length(array_to_string(g[1:j], '')) + length(array_to_string(f[1:j-1], '')) AS a FROM r),
x AS (SELECT doc_id, k, a, kind || ':' || a || ':' || (a + n) AS w FROM s WHERE length(v) >= CASE k {lengths} END),
y AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(w, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(w, ',' ORDER BY a, k) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN y USING (doc_id)
"""


OP6 = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM c),
f AS (SELECT *, length(regexp_replace(r, '(\\|</?s>|\[/?INST\])', '\\\1', 'g')) + length(regexp_replace(t, '(\\|</?s>|\[/?INST\])', '\\\1', 'g')) AS n FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(n + length('<s>[INST][/INST]</s>'))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS o FROM p),
x AS (SELECT *, [('0x' || s[5*k+1:5*k+5])::BIGINT for k in range(8)] AS q FROM b)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> o THEN o END AS refers_to
FROM x
"""


SQL = {"op6_chat_format": OP6, "op8_warc": OP8, "op5_secret_scan": _secrets_sql(), "op1_decontaminate": OP1, "op3_line_dedup": OP3, "op9_quality_rules": OP9}
