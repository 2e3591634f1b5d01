"""DuckDB SQL for the queries that SQL can express. None of it shares code with the operators."""

_W = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
n AS (SELECT doc_id, length(x) AS points, sha256(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""

HOST_RULES = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, source, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM d),
one AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT doc_id, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS g FROM one WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(ws) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.dup, 0) AS n_dup_lines,
         coalesce(dup.n, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 50 * n_words AS f1,
         100 * n_dup_lines > 50 * n_lines AS f2, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS f3 FROM m),
host AS (SELECT source, count(*) AS n, unnest([0, 1, 2, 3]) AS rule, unnest([count_if(base_failed), count_if(f1), count_if(f2), count_if(f3)]) AS f FROM f GROUP BY source),
pool AS (SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q, count(*) / sum(n) AS hn FROM host GROUP BY rule),
prior AS (SELECT rule, m, least(greatest(m * (1 - m) / greatest(q - m * m - hn * m * (1 - m), 1e-12) - 1, 1), 1e6) AS s FROM pool),
verdict AS (SELECT source, max((f + m * s) / (n + s)) AS rate FROM host JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rate > 0.5 AND NOT (rate > 0.25 AND (f1 OR f2 OR f3)) AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""

LINE_SUFFIXES = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
w AS (SELECT doc_id, i, line, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
pairs AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.i),
content AS (SELECT doc_id, s, e, array_to_string(ls[s:e], chr(10)) AS c FROM pairs JOIN d USING (doc_id)),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY c, e - s ORDER BY doc_id, s) AS k FROM content) WHERE k > 1),
gone AS (SELECT DISTINCT w.doc_id, w.i, length(w.line) AS chars FROM w JOIN later ON w.doc_id = later.doc_id AND w.i BETWEEN s AND e),
per AS (SELECT doc_id, count(*) AS k, sum(chars) AS c, list(i - 1 ORDER BY i) AS deleted FROM gone GROUP BY doc_id),
whole AS (SELECT doc_id, count(*) AS n_lines, sum(length(line)) + count(*) - 1 AS n_chars FROM l GROUP BY doc_id)
SELECT doc_id, n_lines, coalesce(k, 0) AS n_deleted, CASE WHEN coalesce(k, 0) = n_lines THEN 0 ELSE n_chars - coalesce(c, 0) - coalesce(k, 0) END AS n_chars, coalesce(deleted, []) AS deleted
FROM whole LEFT JOIN per USING (doc_id)
"""

PREFIX_TRIE = r"""
WITH tb AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
cv AS (SELECT DISTINCT conv_id AS c FROM conversations),
hs AS MATERIALIZED (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::INT + 1])), 4294967295) % 9 AS h FROM cv, tb),
nt AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS b FROM conversations),
rb AS (SELECT c, 0 AS own, i, d, b FROM hs JOIN nt ON nt.conv_id = base AND i <= h UNION ALL SELECT c, 1, i, d, b FROM hs JOIN nt ON nt.conv_id = c AND i > h),
px AS MATERIALIZED (SELECT c, row_number() OVER w AS depth, md5(string_agg(d, '') OVER w) AS p, b FROM rb WINDOW w AS (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING) UNION ALL SELECT c, 0, 'root', 0 FROM cv),
le AS (SELECT c, max(depth) AS m FROM px GROUP BY c),
nd AS MATERIALIZED (SELECT p, min(c) AS conv_id, depth, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = m), '')) AS ends_sha256 FROM px JOIN le USING (c) GROUP BY p, depth),
up AS (SELECT nd.p, x.p AS parent FROM nd JOIN px x ON x.c = nd.conv_id AND x.depth = nd.depth - 1),
kids AS (SELECT parent AS p, count(*) AS n_children FROM up GROUP BY parent),
sub AS (SELECT x.p, count(*) FILTER (kids.p IS NULL) AS n_leaves, sum((nd.n_convs - 1) * nd.b)::BIGINT AS saved_tokens FROM nd LEFT JOIN kids USING (p) JOIN px x ON x.c = nd.conv_id AND x.depth <= nd.depth GROUP BY x.p)
SELECT nd.conv_id, nd.depth, par.conv_id AS parent_conv_id, nd.n_convs, coalesce(kids.n_children, 0) AS n_children, n_leaves, saved_tokens, nd.ends_sha256
FROM nd JOIN sub USING (p) LEFT JOIN kids USING (p) LEFT JOIN up USING (p) LEFT JOIN nd par ON par.p = up.parent
"""

SQL = {
    "op4_line_suffixes": LINE_SUFFIXES,
    "op3_exact_dedup": EXACT_DEDUP,
    "op9_host_rules": HOST_RULES,
    "op11_prefix_trie": PREFIX_TRIE,
}
