"""Queries over texts: preparation, segmentation, content identity, reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fingerprint import BASES, MODULUS
from ..functions.tables import stage
from ..operators import forest, identity, leaves, text
from .registering import query, table

LB = 256
_WS = r"' ', chr(9), chr(10), chr(11), chr(12), chr(13)"
_TOKENS = r"regexp_extract_all(coalesce(text, ''), ' ?[^ \t\n\r\f\v]+|[ \t\n\r\f\v]')"


def docs(spark, sf):
    return table(spark, sf, "documents")


def _pow(i: str, base: int, bits: int = 21) -> str:
    """x^i mod p in SQL, by the bits of i."""
    out, square = "1::BIGINT", base
    for k in range(bits):
        out = f"({out} * CASE WHEN (({i}) >> {k}) & 1 = 1 THEN {square} ELSE 1 END % {MODULUS}) % {MODULUS}".replace(f"END % {MODULUS})", "END)")
        square = square * square % MODULUS
    return out


#: A row for each byte with its share in both lanes, each byte standing at i.
_BYTES = f"""h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
pw AS MATERIALIZED (SELECT i, {_pow('i', BASES[0])} AS w1, {_pow('i', BASES[1])} AS w2 FROM range(0, 140000) r(i)),
lf AS (SELECT doc_id, n, o, substr(h, o * {2 * LB} + 1, {2 * LB}) AS lh FROM h, unnest(range((n + {LB - 1}) // {LB})) u(o)),
b AS (SELECT doc_id, o * {LB} + j AS i, n, ('0x' || substr(lh, 2 * j + 1, 2))::BIGINT + 1 AS v FROM lf, unnest(range(length(lh) // 2)) w(j))"""
_SUM = lambda w: f"(sum(v * {w}) % {MODULUS})::BIGINT"

_LONE = f"""ch AS (SELECT doc_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).') AS cs FROM documents)),
of AS (SELECT doc_id, c, sum(strlen(c)) OVER w - strlen(c) AS boff, lag(c) OVER w AS p, lead(c) OVER w AS q FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
lone AS MATERIALIZED (SELECT doc_id, boff::BIGINT AS boff FROM of WHERE c = ' ' AND p NOT IN ({_WS}) AND q NOT IN ({_WS})),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n FROM documents)"""
_CUTS = lambda targets: f"""WITH RECURSIVE {_LONE},
cut(doc_id, target, s) AS (SELECT doc_id, target, 0::BIGINT FROM d, (SELECT unnest({targets}) AS target)
  UNION ALL SELECT c.doc_id, c.target, min(l.boff) FROM cut c JOIN d ON d.doc_id = c.doc_id JOIN lone l ON l.doc_id = c.doc_id AND l.boff >= c.s + c.target WHERE c.s + c.target < d.n GROUP BY c.doc_id, c.target, c.s)"""  # noqa: E731


_LEAF_TOKENS = f"""lv AS (SELECT doc_id, target, s, coalesce(lead(s) OVER (PARTITION BY target, doc_id ORDER BY s), n) AS e FROM cut JOIN d USING (doc_id)),
lt AS (SELECT doc_id, target, count(*) AS n_leaves, flatten(list({_TOKENS} ORDER BY s)) AS b FROM (SELECT lv.doc_id, target, s, decode(unhex(substr(hex(encode(coalesce(text, ''))), 2 * s::INT + 1, 2 * (e - s)::INT))) AS text FROM lv JOIN documents USING (doc_id)) GROUP BY doc_id, target),
wt AS (SELECT doc_id, {_TOKENS} AS a FROM documents),
cmp AS (SELECT doc_id, target, n_leaves, len(a) AS whole_tok, len(b) AS chunked_tok, list_filter(range(greatest(len(a), len(b))), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1]) AS bad FROM lt JOIN wt USING (doc_id))"""


@query("leaves_fixed", f"WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents) SELECT doc_id, o AS ord, o * {LB} AS byte_start, substr(h, o * {2 * LB} + 1, {2 * LB}) AS leaf, length(substr(h, o * {2 * LB} + 1, {2 * LB})) // 2 AS n FROM d, unnest(range(greatest(1, (n + {LB - 1}) // {LB}))) u(o)")
def _(spark, sf):
    return leaves.leaves_fixed(docs(spark, sf), LB).withColumn("leaf", F.hex("leaf"))


@query("leaves_aligned", f"{_CUTS('[256]')} SELECT doc_id, row_number() OVER w - 1 AS ord, s AS byte_start, coalesce(lead(s) OVER w, n) - s AS n, substr(hex(encode(text)), 2 * s::INT + 1, 2 * (coalesce(lead(s) OVER w, n) - s)::INT) AS leaf FROM cut JOIN d USING (doc_id) JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY s)")
def _(spark, sf):
    return leaves.leaves_aligned(docs(spark, sf), LB).withColumn("leaf", F.hex(F.encode("leaf", "UTF-8")))


@query("leaf_utf8_valid", f"WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents), l AS (SELECT doc_id, substr(h, o * {2 * LB} + 1, 1) IN ('8', '9', 'A', 'B') OR substr(h, (o + 1) * {2 * LB} + 1, 1) IN ('8', '9', 'A', 'B') AS bad FROM d, unnest(range(greatest(1, (n + {LB - 1}) // {LB}))) u(o)) SELECT doc_id, count(*) AS n_leaves, count_if(bad) AS invalid FROM l GROUP BY doc_id")
def _(spark, sf):
    rows = leaves.leaves_fixed(docs(spark, sf), LB)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_leaves"), F.count_if(~F.is_valid_utf8(F.col("leaf").cast("string"))).alias("invalid"))


@query("tokenize_leaves", f"WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents) SELECT doc_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS token FROM t")
def _(spark, sf):
    return leaves.leaf_token_rows(docs(spark, sf), LB)


@query("identity_report", f"{_CUTS('[256]')}, {_LEAF_TOKENS} SELECT doc_id, len(bad) = 0 AS exact_match, n_leaves, whole_tok, chunked_tok, bad[1] AS first_divergence, len(bad) AS divergent_positions, 0 AS invalid_leaves FROM cmp")
def _(spark, sf):
    return leaves.identity_report(docs(spark, sf), leaves.aligned(F.col("text"), LB))


@query("identity_report_blind", f"""WITH t AS (SELECT doc_id, text, {_TOKENS} AS a FROM documents), p AS (SELECT doc_id, o, substr(text, o * 256 + 1, 256) AS text FROM t, unnest(range((length(text) + 255) // 256)) u(o)),
q AS (SELECT doc_id, count(*) AS n_leaves, flatten(list({_TOKENS} ORDER BY o)) AS b FROM p GROUP BY doc_id), e AS (SELECT doc_id, n_leaves, a, b, unnest(range(greatest(len(a), len(b)))) AS i FROM t JOIN q USING (doc_id))
SELECT doc_id, count_if(a[i + 1] IS DISTINCT FROM b[i + 1]) = 0 AS exact_match, any_value(n_leaves) AS n_leaves, any_value(len(a)) AS whole_tok, any_value(len(b)) AS chunked_tok, min(i) FILTER (a[i + 1] IS DISTINCT FROM b[i + 1]) AS first_divergence, count_if(a[i + 1] IS DISTINCT FROM b[i + 1]) AS divergent_positions, 0 AS invalid_leaves FROM e GROUP BY doc_id""")
def _(spark, sf):
    """Control: blind cuts break the token stream, and the report must say so."""
    pieces = F.transform(text.fixed_pieces(F.col("text"), 256), lambda x: F.struct(x.alias("leaf")))
    return leaves.identity_report(docs(spark, sf), pieces).filter("n_leaves > 0")


@query("leaf_size_sweep", f"{_CUTS('[128, 256, 512]')}, {_LEAF_TOKENS} SELECT target, count(*) AS n_docs, sum(n_leaves)::BIGINT AS n_leaves, count_if(len(bad) = 0) AS exact_docs FROM cmp GROUP BY target")
def _(spark, sf):
    return leaves.size_sweep(docs(spark, sf), [128, 256, 512])


@query("leaf_fingerprint", f"WITH {_BYTES} SELECT doc_id, b.i // {LB} AS ord, {_SUM('w1')} AS fp1, {_SUM('w2')} AS fp2 FROM b JOIN pw ON pw.i = b.i % {LB} GROUP BY doc_id, b.i // {LB}")
def _(spark, sf):
    return identity.fingerprint_leaves(leaves.leaves_fixed(docs(spark, sf), LB, empty_leaf=False)).select("doc_id", "ord", "fp1", "fp2")


@query("doc_fingerprint", f"WITH {_BYTES} SELECT doc_id, any_value(n) AS n, {_SUM('w1')} AS fp1, {_SUM('w2')} AS fp2 FROM b JOIN pw USING (i) GROUP BY doc_id")
def _(spark, sf):
    return identity.doc_fingerprint(identity.fingerprint_leaves(leaves.leaves_fixed(docs(spark, sf), LB, empty_leaf=False)))


@query("prefix_fingerprint", f"WITH {_BYTES}, l AS (SELECT doc_id, b.i // {LB} AS ord, count(*) AS n, sum(v * w1 % {MODULUS}) AS s1, sum(v * w2 % {MODULUS}) AS s2 FROM b JOIN pw USING (i) GROUP BY doc_id, b.i // {LB}) SELECT doc_id, ord, (sum(n) OVER w)::BIGINT AS n_bytes, (sum(s1) OVER w % {MODULUS})::BIGINT AS fp1, (sum(s2) OVER w % {MODULUS})::BIGINT AS fp2 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def _(spark, sf):
    return identity.prefix_fingerprint(identity.fingerprint_leaves(leaves.leaves_fixed(docs(spark, sf), LB, empty_leaf=False)))


@query("range_fingerprint", f"WITH {_BYTES} SELECT doc_id, n // 3 AS a, 2 * n // 3 AS b, {_SUM('w1')} AS fp1, {_SUM('w2')} AS fp2 FROM b JOIN pw ON pw.i = b.i - n // 3 WHERE b.i >= n // 3 AND b.i < 2 * n // 3 GROUP BY doc_id, n")
def _(spark, sf):
    d = docs(spark, sf)
    n = F.octet_length("text").cast("long")
    ranges = d.select("doc_id", F.floor(n / 3).alias("a"), F.floor(2 * n / 3).alias("b")).filter("a < b")
    return identity.range_fingerprint(d, ranges).drop("n")


_LCP = "(SELECT coalesce(min(i), least(length(x.h), length(y.h)) // 2) FROM range(least(length(x.h), length(y.h)) // 2) r(i) WHERE substr(x.h, 2 * i + 1, 2) <> substr(y.h, 2 * i + 1, 2))"
_H = "h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"


@query("lcp_pairs", f"WITH {_H} SELECT x.doc_id AS a_id, y.doc_id AS b_id, {_LCP} AS lcp FROM h x JOIN h y ON y.doc_id = x.doc_id + 1")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", leaves.content(F.col("text")).alias("data"))
    pairs = d.select(F.col("doc_id").alias("a_id"), F.col("data").alias("a")).join(d.select(F.col("doc_id").alias("b_id"), (F.col("doc_id") - 1).alias("a_id"), F.col("data").alias("b")), "a_id")
    return identity.lcp_pairs(pairs).select("a_id", "b_id", "lcp")


@query("lcp_all_pairs", f"WITH {_H} SELECT x.doc_id AS a_id, y.doc_id AS b_id, {_LCP} AS lcp FROM h x JOIN h y ON x.doc_id < y.doc_id AND substr(x.h, 1, {2 * LB}) = substr(y.h, 1, {2 * LB}) WHERE length(x.h) >= {2 * LB}")
def _(spark, sf):
    return identity.lcp_all_pairs(docs(spark, sf), LB)


#: Classes of the forest from pairs: a class is a shared prefix at which some pair parts.
_FOREST = f"""WITH {_H}, pr AS (SELECT {_LCP} AS n_bytes, x.h FROM h x JOIN h y ON x.doc_id < y.doc_id AND substr(x.h, 1, {2 * LB}) = substr(y.h, 1, {2 * LB}) WHERE length(x.h) >= {2 * LB}),
cl AS (SELECT DISTINCT n_bytes, substr(h, 1, 2 * n_bytes) AS pre FROM pr),
mb AS (SELECT n_bytes, pre, doc_id FROM cl JOIN h ON length(h) >= 2 * n_bytes AND substr(h, 1, 2 * n_bytes) = pre),
cs AS (SELECT n_bytes, pre, min(doc_id) AS first_id, count(*) AS n_docs FROM mb GROUP BY n_bytes, pre)"""


@query("lcp_forest", f"{_FOREST} SELECT c.n_bytes, c.first_id, any_value(c.n_docs) AS n_docs, max(p.n_bytes) AS parent_bytes, arg_max(p.first_id, p.n_bytes) AS parent_id FROM cs c LEFT JOIN cs p ON p.n_bytes < c.n_bytes AND substr(c.pre, 1, 2 * p.n_bytes) = p.pre GROUP BY c.n_bytes, c.first_id")
def _(spark, sf):
    return forest.lcp_forest(docs(spark, sf), LB)[0]


@query("lcp_forest_members", f"{_FOREST} SELECT doc_id, max(n_bytes) AS n_bytes, arg_max(first_id, n_bytes) AS first_id FROM mb JOIN cs USING (n_bytes, pre) GROUP BY doc_id")
def _(spark, sf):
    return forest.lcp_forest(docs(spark, sf), LB)[1]


@query("lcp_forest_pairs", f"WITH {_H} SELECT x.doc_id AS a_id, y.doc_id AS b_id, CASE WHEN {_LCP} >= {LB} THEN {_LCP} ELSE 0 END AS lcp FROM h x JOIN h y ON y.doc_id = x.doc_id + 1 UNION ALL SELECT x.doc_id, y.doc_id, CASE WHEN {_LCP} >= {LB} THEN {_LCP} ELSE 0 END FROM h x JOIN h y ON y.doc_id <> x.doc_id + 1 AND x.doc_id < y.doc_id AND substr(x.h, 1, {2 * LB}) = substr(y.h, 1, {2 * LB}) WHERE length(x.h) >= {2 * LB}")
def _(spark, sf):
    """All neighbours by id, asked for as pairs; and all other pairs that the forest expands to."""
    d = docs(spark, sf)
    classes, members = forest.lcp_forest(d, LB)
    near = d.select(F.col("doc_id").alias("a_id")).join(d.select(F.col("doc_id").alias("b_id"), (F.col("doc_id") - 1).alias("a_id")), "a_id")
    return forest.lcp_of(near, classes, members).unionByName(forest.expand(classes, members).filter("b_id <> a_id + 1"))


@query("prefix_classes", f"WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT doc_id, o AS ord, least(n, (o + 1) * {LB}) AS n_bytes, substr(h, 1, 2 * (o + 1) * {LB}) AS pre FROM d, unnest(range(greatest(1, (n + {LB - 1}) // {LB}))) u(o)) SELECT ord, n_bytes, count(*) AS n_docs, min(doc_id) AS first_id FROM p GROUP BY ord, n_bytes, pre HAVING count(*) > 1")
def _(spark, sf):
    return identity.prefix_classes(docs(spark, sf), LB).drop("fp1", "fp2")


_LCP_H = lambda x: f"coalesce((SELECT coalesce(min(i), least(length(h), length({x})) // 2) FROM range(least(length(h), length({x})) // 2) r(i) WHERE substr(h, 2 * i + 1, 2) <> substr({x}, 2 * i + 1, 2)), 0)"


@query("match_prefix", f"WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, doc_id % 2 = 0 AS c FROM documents), o AS (SELECT doc_id, h, c, coalesce(last_value(CASE WHEN c THEN h END IGNORE NULLS) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS lo, coalesce(first_value(CASE WHEN c THEN h END IGNORE NULLS) OVER (ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') AS hi FROM h), q AS (SELECT doc_id, h, greatest({_LCP_H('lo')}, {_LCP_H('hi')})::BIGINT AS lcp FROM o WHERE NOT c) SELECT q.doc_id, lcp, min(k.doc_id) AS cached_id FROM q JOIN h k ON k.c AND substr(k.h, 1, 2 * lcp) = substr(q.h, 1, 2 * lcp) GROUP BY q.doc_id, lcp")
def _(spark, sf):
    """Every other document asks for its longest prefix among the others."""
    d = docs(spark, sf)
    return identity.match_prefix(d.filter("doc_id % 2 = 1"), d.filter("doc_id % 2 = 0"), LB)


_SEQ = "s AS (SELECT l_orderkey AS id, list(l_quantity::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS t FROM lineitem GROUP BY l_orderkey)"
_LCPT = "(SELECT coalesce(min(i), least(len(x.t), len(y.t))) FROM range(least(len(x.t), len(y.t))) r(i) WHERE x.t[i + 1] <> y.t[i + 1])"


def sequences(spark, sf):
    """Orders as token sequences."""
    li = table(spark, sf, "lineitem")
    rows = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")))).alias("s"))
    return rows.select("id", F.transform("s", lambda x: x["q"]).alias("t"))


def neighbours(spark, sf):
    s = stage(sequences(spark, sf), "sequences")
    return s.select("id", F.col("t").alias("a")).join(s.select((F.col("id") - 1).alias("id"), F.col("t").alias("b")), "id")


_CODES = "coalesce(list_aggregate(list_transform(t, lambda x: printf('%02X%02X%02X%02X', x & 255, (x >> 8) & 255, (x >> 16) & 255, (x >> 24) & 255)), 'string_agg', ''), '')"


@query("lcp_tokens", f"WITH {_SEQ} SELECT x.id, {_LCPT} AS lcp FROM s x JOIN s y ON y.id = x.id + 1")
def _(spark, sf):
    return neighbours(spark, sf).select("id", identity.lcp_array(F.col("a"), F.col("b")).alias("lcp"))


@query("one_vs_many", f"WITH {_SEQ} SELECT y.id, {_LCPT} AS lcp FROM s x JOIN s y ON x.id = (SELECT min(id) FROM s)")
def _(spark, sf):
    s = sequences(spark, sf)
    one = s.agg(F.min_by("t", "id").alias("q"))  # one query, one row
    return s.join(F.broadcast(one)).select("id", identity.lcp_array(F.col("q"), F.col("t")).alias("lcp"))


@query("identify_arms", f"WITH {_SEQ}, c AS (SELECT x.id, {_LCPT} AS scan, x.h AS h, y.h AS g FROM (SELECT id, t, {_CODES} AS h FROM s) x JOIN (SELECT id, t, {_CODES} AS h FROM s) y ON y.id = x.id + 1), z AS (SELECT id, scan, (SELECT coalesce(min(i), least(length(h), length(g))) FROM range(least(length(h), length(g))) r(i) WHERE substr(h, i + 1, 1) <> substr(g, i + 1, 1)) // 8 AS by_bytes FROM c) SELECT id, scan, by_bytes, scan = by_bytes AS agree FROM z")
def _(spark, sf):
    by = text.token_offset(identity.lcp_bytes(text.encode_tokens(F.col("a")), text.encode_tokens(F.col("b"))))
    return neighbours(spark, sf).select("id", identity.lcp_array(F.col("a"), F.col("b")).alias("scan"), by.alias("by_bytes")).withColumn("agree", F.col("scan") == F.col("by_bytes"))


@query("correctness_gate", f"WITH {_SEQ}, c AS (SELECT x.id, {_LCPT} AS scan, x.h AS h, y.h AS g FROM (SELECT id, t, {_CODES} AS h FROM s) x JOIN (SELECT id, t, {_CODES} AS h FROM s) y ON y.id = x.id + 1) SELECT id % 10 AS part, count(*) AS n_checks, count_if(scan <> (SELECT coalesce(min(i), least(length(h), length(g))) FROM range(least(length(h), length(g))) r(i) WHERE substr(h, i + 1, 1) <> substr(g, i + 1, 1)) // 8) AS mismatches FROM c GROUP BY 1")
def _(spark, sf):
    by = text.token_offset(identity.lcp_bytes(text.encode_tokens(F.col("a")), text.encode_tokens(F.col("b"))))
    rows = neighbours(spark, sf).select((F.col("id") % 10).alias("part"), identity.lcp_array(F.col("a"), F.col("b")).alias("scan"), by.alias("by_bytes"))
    return identity.correctness_gate(rows, ["part"], "scan", "by_bytes")


@query("negative_control", f"WITH {_SEQ}, w AS (SELECT id, len(t) AS n, unnest(['first', 'middle', 'last']) AS place, unnest([0, len(t) // 2, len(t) - 1]) AS pos, t FROM s), b AS (SELECT *, list_transform(t, lambda x, i: CASE WHEN i = pos + 1 THEN x + 1 ELSE x END) AS u FROM w), f AS (SELECT *, (SELECT coalesce(min(i), n) FROM range(n) r(i) WHERE t[i + 1] <> u[i + 1]) AS found FROM b) SELECT id, place, n AS lcp, pos, found, found = pos AS detected FROM f")
def _(spark, sf):
    s = sequences(spark, sf).withColumn("lcp", F.size("t").cast("long"))
    at = F.explode(F.create_map(F.lit("first"), F.lit(0).cast("long"), F.lit("middle"), F.floor(F.col("lcp") / 2), F.lit("last"), F.col("lcp") - 1)).alias("place", "at")
    return identity.negative_control(s.select("id", "t", "lcp", at), "t", "t", "lcp", F.col("at")).select("id", "place", "lcp", "pos", "found", "detected")


@query("controlled_pair", "WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, unnest([0.0, 0.5, 0.99]) AS f FROM documents) SELECT doc_id, f::DOUBLE AS f, floor(f * n)::BIGINT AS expected, floor(f * n)::BIGINT AS lcp FROM d WHERE n > 0")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", leaves.content(F.col("text")).alias("a"), F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.99))).alias("f")).filter(F.octet_length("a") > 0)
    at = F.floor(F.col("f").cast("decimal(4,2)") * F.octet_length("a")).cast("long")
    d = d.withColumn("expected", at)
    flipped = F.unhex(F.lpad(F.hex(F.lit(255) - F.conv(F.hex(F.substring("a", (F.col("expected") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")), 2, "0"))
    b = F.concat(F.substring("a", F.lit(1), F.col("expected").cast("int")), flipped, F.substring("a", (F.col("expected") + 2).cast("int"), F.octet_length("a")))
    return identity.lcp_pairs(d.withColumn("b", b)).select("doc_id", "f", "expected", "lcp")


@query("shared_prefix_requests", f"WITH {_SEQ} SELECT id, q, len(t) AS oracle_lcp, len(t) AS lcp, len(t) + 1 AS n_tokens FROM s, range(0, 3) r(q)")
def _(spark, sf):
    """One cached sequence, several queries that share it and then differ from each other."""
    s = sequences(spark, sf).select("id", "t", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("q"))
    asked = F.concat("t", F.array((F.col("q") + 1_000_000).cast("long")))
    return s.select("id", "q", F.size("t").alias("oracle_lcp"), identity.lcp_array(F.col("t"), asked).alias("lcp"), F.size(asked).alias("n_tokens"))


_CONV = "c AS (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id HAVING count(*) >= 4), t AS (SELECT conv_id, 2 + ((conv_id * 7919 + 42 * 104729) % 1000003) % (n_turns - 2) AS t FROM c)"
_PAIR = f"{_CONV}, r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role || ': ' || text || chr(10) || chr(10) AS line FROM conversations), p AS (SELECT conv_id, t.t, string_agg(line, '' ORDER BY k) FILTER (k <= t.t) AS cached_text, string_agg(line, '' ORDER BY k) FILTER (k <= t.t + 1) AS query_text FROM r JOIN t USING (conv_id) GROUP BY conv_id, t.t)"


def reuse(spark, sf):
    """A row for each sampled conversation: tokens cached, tokens asked, their LCP."""
    turns = table(spark, sf, "conversations")
    t = text.sample_pairs(turns).select("conv_id", F.col("t").alias("want"))
    ranked = turns.withColumn("k", F.row_number().over(text.Window.partitionBy("conv_id").orderBy("turn"))).join(t, "conv_id").filter("k <= want + 1")
    heard = ranked.groupBy("conv_id", "want").agg(F.sort_array(F.collect_list(F.struct("k", "role", "text"))).alias("s"))
    rows = heard.select("conv_id", "want", text.render(F.slice("s", F.lit(1), F.col("want").cast("int"))).alias("cached_text"), text.render(F.col("s")).alias("query_text"))
    tok = lambda c: leaves.tokens(F.col(c))
    rows = rows.select("conv_id", F.col("want").alias("t"), tok("cached_text").alias("a"), tok("query_text").alias("b"))
    return rows.select("conv_id", "t", F.size("a").alias("cached_len"), F.size("b").alias("query_len"), identity.lcp_array(F.col("a"), F.col("b")).alias("lcp"))


_REUSE = f"{_PAIR}, e AS (SELECT conv_id, t, regexp_extract_all(cached_text, ' ?[^ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]') AS a, regexp_extract_all(query_text, ' ?[^ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]') AS b FROM p), z AS (SELECT conv_id, t, len(a) AS cached_len, len(b) AS query_len, (SELECT coalesce(min(i), least(len(a), len(b))) FROM range(least(len(a), len(b))) r(i) WHERE a[i + 1] <> b[i + 1]) AS lcp FROM e)"


@query("reuse_pairs", f"WITH {_REUSE} SELECT * FROM z")
def _(spark, sf):
    return reuse(spark, sf)


@query("reuse_summary", f"WITH {_REUSE} SELECT conv_id % 4 AS dataset, count(*) AS n, sum(cached_len)::BIGINT AS cached_tokens, avg(lcp) AS lcp_mean, min(lcp) AS lcp_min, max(lcp) AS lcp_max, median(lcp) AS lcp_median FROM z GROUP BY 1")
def _(spark, sf):
    return reuse(spark, sf).groupBy((F.col("conv_id") % 4).alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.sum("cached_len").alias("cached_tokens"), F.avg("lcp").alias("lcp_mean"), F.min("lcp").alias("lcp_min"), F.max("lcp").alias("lcp_max"), F.median("lcp").alias("lcp_median"))


@query("prefix_dedup", f"WITH d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT source, doc_id, o, substr(h, 1, 2 * (o + 1) * {LB}) AS pre, length(substr(h, 2 * o * {LB} + 1, {2 * LB})) // 2 AS k FROM d, unnest(range(greatest(1, (n + {LB - 1}) // {LB}))) u(o)), u AS (SELECT source, pre, o, any_value(k) AS k, count(*) AS c FROM p GROUP BY source, pre, o) SELECT source, sum(k * c)::BIGINT AS redundant_bytes, sum(k)::BIGINT AS deduplicated_bytes, sum(c)::BIGINT AS n_refs, count(*) AS n_blocks FROM u GROUP BY source")
def _(spark, sf):
    """A shared prefix is stored once: blocks are shared where the whole prefix is equal."""
    rows = leaves.leaves_fixed(docs(spark, sf), LB, keys=("doc_id", "source"))
    hashed = identity.fingerprint_leaves(rows)
    chain = identity.prefix_fingerprint(hashed, ("doc_id", "source")).join(hashed.select("doc_id", "ord", "n"), ["doc_id", "ord"])
    blocks = chain.groupBy("source", "ord", "n_bytes", "fp1", "fp2").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("k"))
    return blocks.groupBy("source").agg(F.sum(F.col("k") * F.col("c")).alias("redundant_bytes"), F.sum("k").cast("long").alias("deduplicated_bytes"), F.sum("c").alias("n_refs"), F.count(F.lit(1)).alias("n_blocks"))


@query("exact_dup_groups", "SELECT any_value(strlen(t)) AS n, min(doc_id) AS first_id, count(*) AS n_docs, count(DISTINCT t) = 1 AS verified FROM (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k FROM documents) GROUP BY k HAVING count(*) > 1")
def _(spark, sf):
    return identity.exact_dup_groups(docs(spark, sf), LB).drop("fp1", "fp2")


# --- text preparation ---


@query("strip_boilerplate", r"SELECT doc_id, md5(regexp_replace(regexp_replace(CASE WHEN regexp_matches(x, '(?s)\*\*\* START[^\n]*\n.*?\*\*\* END') THEN regexp_extract(x, '(?s)\*\*\* START[^\n]*\n(.*?)\*\*\* END', 1) ELSE x END, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '')) AS body FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'front' || chr(10) || '*** START OF TEXT ***' || chr(10) || text || chr(10) || '*** END OF TEXT ***' WHEN doc_id % 3 = 1 THEN '*** START ' || text ELSE text END AS x FROM documents)")
def _(spark, sf):
    t = F.col("text")
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("front\n*** START OF TEXT ***\n"), t, F.lit("\n*** END OF TEXT ***"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("*** START "), t)).otherwise(t)
    return docs(spark, sf).select("doc_id", F.md5(text.strip_boilerplate(marked, r"\*\*\* START", r"\*\*\* END")).alias("body"))


@query("chunk_fixed_chars", "SELECT doc_id, o AS ord, substr(text, o * 512 + 1, 512) AS piece FROM documents, unnest(range((length(text) + 511) // 512)) u(o)")
def _(spark, sf):
    return text.chunk_fixed_chars(docs(spark, sf), 512)


@query("seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY ((doc_id + 1) % 2147483647 * (1103515245 + 2 * 42) + 42) % 2147483647, doc_id) - 1 AS place FROM documents")
def _(spark, sf):
    return text.seeded_shuffle(docs(spark, sf).select("doc_id"), "doc_id", 42)


@query("provenance", "SELECT source, sum(strlen(text))::BIGINT AS n_bytes, count(*) AS n_docs, (sum(('0x' || left(sha256(text), 8))::BIGINT) % 4294967296)::BIGINT AS content_sum FROM documents GROUP BY source")
def _(spark, sf):
    return text.provenance(docs(spark, sf), ["source"])


@query("render_turns", "SELECT conv_id, count(*) AS n_turns, string_agg(role || ': ' || text || chr(10) || chr(10), '' ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return text.render_turns(table(spark, sf, "conversations"))


@query("rolling_context", "SELECT conv_id, turn AS t, coalesce(string_agg(role || ': ' || text || chr(10) || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS cached_text, string_agg(role || ': ' || text || chr(10) || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS query_text FROM conversations")
def _(spark, sf):
    return text.rolling_context(table(spark, sf, "conversations"))


@query("read_conversations", "SELECT conv_id, turn, role, text, n_turns FROM conversations JOIN (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id HAVING count(*) >= 4) USING (conv_id)")
def _(spark, sf):
    return text.read_conversations(table(spark, sf, "conversations"))


@query("sample_pairs", f"WITH {_CONV} SELECT conv_id, n_turns, (conv_id * 7919 + 42 * 104729) % 1000003 AS mark, t FROM c JOIN t USING (conv_id)")
def _(spark, sf):
    return text.sample_pairs(table(spark, sf, "conversations"))


@query("encode_tokens", f"WITH {_SEQ} SELECT id, list_aggregate(list_transform(t, lambda x: printf('%02X%02X%02X%02X', x & 255, (x >> 8) & 255, (x >> 16) & 255, (x >> 24) & 255)), 'string_agg', '') AS bytes FROM s")
def _(spark, sf):
    return sequences(spark, sf).select("id", F.hex(text.encode_tokens(F.col("t"))).alias("bytes"))


@query("decode_tokens", f"WITH {_SEQ} SELECT id, t AS tokens FROM s")
def _(spark, sf):
    return sequences(spark, sf).select("id", text.decode_tokens(text.encode_tokens(F.col("t"))).alias("tokens"))


@query("token_offset", "SELECT doc_id, n_chars, n_chars // 4 AS token FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", "n_chars", text.token_offset(F.col("n_chars")).alias("token"))


@query("utf8_offsets", "WITH c AS (SELECT doc_id, generate_subscripts(cs, 1) - 1 AS i, unnest(cs) AS c FROM (SELECT doc_id, list_append(regexp_extract_all(text, '(?s).'), '') AS cs FROM documents)) SELECT doc_id, i, coalesce(sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte FROM c")
def _(spark, sf):
    return text.utf8_offsets(docs(spark, sf))


#: Responses: an order's lines as moves, prose and blanks.
_LINE = "CASE l_linenumber % 4 WHEN 0 THEN 'I think this is right.' WHEN 3 THEN '' ELSE '  ' || q || ' + ' || l_linenumber || ' = ' || (q + l_linenumber) || ' (remaining: ' || (q % 3) || ', ' || (q % 2) || ' 24)' END"


def responses(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("q", (F.col("l_quantity").cast("long") % 4).cast("string"))
    n, q = F.col("l_linenumber"), F.col("q")
    move = F.concat(F.lit("  "), q, F.lit(" + "), n.cast("string"), F.lit(" = "), (q.cast("long") + n).cast("string"), F.lit(" (remaining: "), (q.cast("long") % 3).cast("string"), F.lit(", "), (q.cast("long") % 2).cast("string"), F.lit(" 24)"))
    line = F.when(n % 4 == 0, "I think this is right.").when(n % 4 == 3, "").otherwise(move)
    rows = li.groupBy(F.col("l_orderkey").alias("response_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", line.alias("line")))).alias("s"))
    return rows.select("response_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("text"))


@query("parse_moves", f"WITH l AS (SELECT l_orderkey AS response_id, l_linenumber, l_partkey, l_suppkey, (l_quantity::BIGINT % 4) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT % 4) - 1 AS pos FROM lineitem), m AS (SELECT response_id, pos, q || ' + ' || l_linenumber || ' = ' || (q + l_linenumber) || ' (remaining: ' || (q % 3) || ' ' || (q % 2) || ' 24)' AS thought, [(q % 3)::VARCHAR, (q % 2)::VARCHAR, '24'] AS remaining FROM l WHERE l_linenumber % 4 IN (1, 2)) SELECT response_id, thought, min(pos) AS pos, any_value(remaining) AS remaining FROM m GROUP BY response_id, thought")
def _(spark, sf):
    return text.parse_moves(responses(spark, sf))


@query("parse_numbers", r"SELECT event_id, list_filter(string_split_regex(replace(props, ':', ' , '), '[\s,]+'), lambda x: x <> '') AS numbers FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", text.parse_numbers(F.replace(F.col("props"), F.lit(":"), F.lit(" , "))).alias("numbers"))


_VALUE = "CASE l_linenumber % 4 WHEN 0 THEN 'I am Sure of it, not likely' WHEN 1 THEN 'this is LIKELY' WHEN 2 THEN 'impossible! sure?' ELSE 'surely not' END"


@query("parse_value", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'sure' WHEN 1 THEN 'likely' WHEN 2 THEN 'impossible' ELSE 'unparsed' END AS label, CASE l_linenumber % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS score FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("said", F.expr(_VALUE))
    return li.select("l_orderkey", "l_linenumber", text.parse_value(F.col("said")).alias("v")).select("l_orderkey", "l_linenumber", "v.label", "v.score")


@query("is_goal", "SELECT l_orderkey, l_linenumber, l_quantity = 24 OR (l_quantity * 2 = 48 AND l_linenumber % 2 = 0) AS goal FROM lineitem")
def _(spark, sf):
    q = F.col("l_quantity").cast("long")
    shown = F.when(F.col("l_linenumber") % 2 == 0, F.concat((q * 2).cast("string"), F.lit("/2"))).when(F.col("l_linenumber") % 3 == 0, F.concat(q.cast("string"), F.lit(".0"))).otherwise(q.cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.is_goal(F.array(shown)).alias("goal"))


@query("request_metrics", "SELECT event_id AS request_id, CASE WHEN event_id % 3 < 2 THEN user_id % 5 END AS prompt_tokens, CASE WHEN event_id % 3 < 2 THEN user_id % 3 END AS completion_tokens, CASE WHEN event_id % 3 < 2 THEN user_id % 4 END AS cached_tokens, CASE WHEN event_id % 3 < 2 THEN 1.5::DOUBLE END AS e2e_latency, CASE WHEN event_id % 3 < 2 THEN 'stop' END AS finish_reason FROM events")
def _(spark, sf):
    """Request records in two shapes, and some that are empty."""
    ev = table(spark, sf, "events")
    ids = lambda n: F.array_repeat(F.lit(7), n.cast("int"))
    u = F.col("user_id")
    one = F.to_json(F.struct(F.col("event_id").alias("request_id"), ids(u % 5).alias("prompt_token_ids"), F.array(F.struct(ids(u % 3).alias("token_ids"), F.lit("stop").alias("finish_reason"))).alias("outputs"), (u % 4).alias("num_cached_tokens"), F.struct(F.lit(2.0).alias("arrival_time"), F.lit(3.5).alias("finished_time")).alias("metrics")))
    two = F.to_json(F.struct(F.col("event_id").alias("request_id"), F.struct((u % 5).alias("prompt_tokens"), (u % 3).alias("completion_tokens"), (u % 4).alias("cached_tokens"), F.lit(1.5).alias("e2e_latency"), F.struct(F.lit("stop").alias("type")).alias("finish_reason")).alias("meta_info")))
    none = F.to_json(F.struct(F.col("event_id").alias("request_id")))
    k = F.col("event_id") % 3
    return text.request_metrics(ev.select(F.when(k == 0, one).when(k == 1, two).otherwise(none).alias("record")))


@query("corpus_slice", "WITH d AS (SELECT doc_id, CASE WHEN strlen(text) > 0 THEN repeat(text, (300 + strlen(text) - 1) // strlen(text)) ELSE '' END AS x FROM documents), c AS (SELECT doc_id, x, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT doc_id, x, regexp_extract_all(left(x, 300), '(?s).') AS cs FROM d)), k AS (SELECT doc_id, x, i, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM c) SELECT doc_id, left(any_value(x), max(i) FILTER (b <= 300)::INT) AS slice FROM k GROUP BY doc_id")
def _(spark, sf):
    return text.corpus_slice(docs(spark, sf), 300)
