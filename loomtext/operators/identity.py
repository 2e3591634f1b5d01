"""Content identity: fingerprints of leaves, documents, prefixes and ranges; longest common prefixes; reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprint import BASES, LANES, MODULUS, leaf_hash, power
from ..functions.tables import BROADCAST_BYTES, bloom, let, measured_bytes, scan, stage
from .leaves import content, leaves_fixed

LEAF = 256


def fingerprint_leaves(leaves: DataFrame) -> DataFrame:
    """leaves with fp1, fp2: one Arrow pass over the bytes."""
    return leaves.withColumn("_h", leaf_hash(F.col("leaf"))).withColumns({x: F.col(f"_h.{x}") for x in LANES}).drop("_h")


def placed(start: Column, fp: str, lane: int) -> Column:
    """The leaf's share in the document's fingerprint."""
    return F.col(fp) * power(start, BASES[lane]) % MODULUS


def doc_fingerprint(hashed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, n, fp1, fp2): composed from leaves, so independent of how the text was cut."""
    sums = [(F.sum(placed(F.col("byte_start"), x, k)) % MODULUS).alias(x) for k, x in enumerate(LANES)]
    return hashed.groupBy(*keys).agg(F.sum("n").alias("n"), *sums)


def prefix_fingerprint(hashed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, ord, n_bytes, fp1, fp2): fingerprint of every prefix that ends with a leaf; a document of very many leaves is
    many tasks (see scan)."""
    weighted = hashed.select(*keys, "ord", "n", *[placed(F.col("byte_start"), x, k).alias(f"_{x}") for k, x in enumerate(LANES)])
    sums = scan(weighted, list(keys), "ord", {"n_bytes": "n"} | {x: f"_{x}" for x in LANES})
    return sums.select(*keys, "ord", "n_bytes", *[(F.col(x) % MODULUS).alias(x) for x in LANES])


def range_fingerprint(docs: DataFrame, ranges: DataFrame, size: int = LEAF, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For ranges(key, a, b): fingerprint of the bytes [a, b), as if they stood at the start.

    Whole leaves inside come from the leaf table; the two partial ones are cut out and hashed alone.
    """
    leaves = leaves_fixed(docs, size, text, (key,)).join(ranges, key).filter((F.col("byte_start") < F.col("b")) & (F.col("byte_start") + F.col("n") > F.col("a")))
    lo, hi = F.greatest("a", "byte_start"), F.least("b", F.col("byte_start") + F.col("n"))
    part = leaves.select(key, "a", "b", F.substring("leaf", (lo - F.col("byte_start") + 1).cast("int"), (hi - lo).cast("int")).alias("leaf"), (lo - F.col("a")).alias("byte_start"), (hi - lo).alias("n"))
    return doc_fingerprint(fingerprint_leaves(part), (key, "a", "b"))


def lcp_bytes(a: Column, b: Column, size: int = LEAF) -> Column:
    """Exact longest common prefix of two byte strings: first block that differs, first 16 bytes in it, first byte in those.
    No place behind the end of the shorter one is looked at."""

    def of(x):
        n = F.least(F.octet_length(x["a"]), F.octet_length(x["b"]))

        def first(at, width, last):
            differs = lambda i: F.substring(x["a"], i + 1, F.lit(width)) != F.substring(x["b"], i + 1, F.lit(width))
            return F.get(F.filter(F.sequence(at, last, F.lit(width)), differs), F.lit(0))

        byte = lambda j: F.coalesce(first(j, 1, F.least(n, j + 15)), n)
        inner = lambda k: let(first(k, 16, F.least(n, k + size - 1)), byte)
        return let(first(F.lit(0), size, n), lambda k: F.when(k.isNull(), n).otherwise(inner(k)))

    return let(F.struct(a.alias("a"), b.alias("b")), of).cast("long")


def lcp_array(a: Column, b: Column) -> Column:
    """Longest common prefix of two arrays without nulls."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    return let(F.array_position(same, F.lit(False)), lambda p: F.when(p > 0, p - 1).otherwise(n.cast("long")))


def lcp_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with lcp: exact byte LCP of two binary columns; 0 if either is empty. Narrow."""
    return pairs.withColumn("lcp", lcp_bytes(F.col(a), F.col(b)))


def lcp_all_pairs(docs: DataFrame, size: int = LEAF, text: str = "text", group: str | None = None) -> DataFrame:
    """(a_id, b_id, lcp) for all pairs of documents that share at least one full leaf (within a group, if given).

    Prefix fingerprints meet on (group, ord, fp1, fp2), but only where prefixes part: a prefix whose documents all go on
    to one and the same next prefix takes no part, and two documents meet at the last one that they share, once. The
    bytes of the one leaf after it give the rest. Bytes are then verified: a pair whose matched part differs (a
    collision) is compared in full. The output has a row for each pair, so use `prefix_classes` where thousands share a
    beginning.
    """
    keys = ("doc_id",) if group is None else ("doc_id", group)
    hashed = fingerprint_leaves(leaves_fixed(docs, size, text, keys))
    on = ["ord", *LANES] + ([group] if group else [])
    full = prefix_fingerprint(hashed, keys).filter(F.col("n_bytes") == (F.col("ord") + 1) * size)
    after = F.lead(F.struct(*LANES)).over(Window.partitionBy(*keys).orderBy("ord"))
    full = stage(full.select("doc_id", *on, after.alias("next")), "prefixes")
    parts = full.groupBy(*on).agg(F.count(F.lit(1)).alias("c"), F.count("next").alias("k"), F.min("next").alias("a"), F.max("next").alias("b"))
    parts = parts.filter("c > 1 and (k < c or a <> b)").select(*on)
    full = full.join(parts, on, "left_semi")
    met = full.select(F.col("doc_id").alias("a_id"), F.col("next").alias("na"), *on).join(full.select(F.col("doc_id").alias("b_id"), F.col("next").alias("nb"), *on), on)
    met = met.filter(F.col("a_id") < F.col("b_id")).filter(F.col("na").isNull() | F.col("nb").isNull() | (F.col("na") != F.col("nb")))
    deepest = met.groupBy("a_id", "b_id").agg((F.max("ord") + 1).alias("k"))  # one row a pair but for collisions
    data = lambda x: docs.select(F.col("doc_id").alias(f"{x}_id"), content(F.col(text)).alias(x))
    both = deepest.join(data("a"), "a_id").join(data("b"), "b_id")
    known = F.col("k") * size
    part = lambda x, at, n: F.substring(F.col(x), at.cast("int"), n)
    rest = lcp_bytes(part("a", known + 1, F.lit(size)), part("b", known + 1, F.lit(size)), size)
    verified = part("a", F.lit(1), known.cast("int")) == part("b", F.lit(1), known.cast("int"))
    return both.select("a_id", "b_id", F.when(verified, known + rest).otherwise(lcp_bytes(F.col("a"), F.col("b"), size)).alias("lcp"))


def prefix_classes(docs: DataFrame, size: int = LEAF, text: str = "text") -> DataFrame:
    """Shared prefixes without pairs: (ord, fp1, fp2, n_docs, first_id) of each leaf-boundary prefix of several documents."""
    prefixes = prefix_fingerprint(fingerprint_leaves(leaves_fixed(docs, size, text)))
    return prefixes.groupBy("ord", "n_bytes", *LANES).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_id")).filter("n_docs > 1")


def full_prefixes(docs: DataFrame, size: int = LEAF, text: str = "text") -> DataFrame:
    """(doc_id, k, fp1, fp2): fingerprints of the first k full leaves, k from 1."""
    prefixes = prefix_fingerprint(fingerprint_leaves(leaves_fixed(docs, size, text)))
    return prefixes.filter(F.col("n_bytes") == (F.col("ord") + 1) * size).select("doc_id", (F.col("ord") + 1).alias("k"), *LANES)


def cached_leaves(cache: DataFrame, size: int = LEAF, text: str = "text") -> DataFrame:
    """(doc_id, k, fp1, fp2, data): the leaf after the first k full leaves with their fingerprint, from k = 0; staged."""
    return stage(_next_leaf(cache, full_prefixes(cache, size, text), size, text, every=True), "cached-leaves")


def match_prefix(queries: DataFrame, cache: DataFrame, size: int = LEAF, text: str = "text", leaves: DataFrame | None = None) -> DataFrame:
    """For each query document the cached one with the longest common prefix: (doc_id, cached_id, lcp).

    Every query has a row; what shares nothing has lcp 0 and the smallest id of the cache (null if that is empty), and of
    entries with equal prefixes the smallest id is given. Two steps, each linear in the rows of both sides:

    1. Fingerprints of the first k full leaves meet; the deepest is the query's class (k = 0 where none meets).
    2. Within the class the leaf after it is matched as bytes: prefixes of it meet at multiples of 16 bytes, and then at
       each byte behind the longest of those. Cached prefixes are first reduced to the smallest id, so a beginning that
       all entries share costs one row, and no table of pairs exists.

    Only keys that were measured are broadcast (see _met). All other joins are hinted to merge: the planner takes a staged
    table for as small as its files, and would broadcast what compresses well or is multiplied after it.

    `leaves` is the cache as cached_leaves gives it, if it is at hand; the cache itself is then not read.
    """
    leaves = cached_leaves(cache, size, text) if leaves is None else leaves
    mine = stage(full_prefixes(queries, size, text), "asked-prefixes")
    key = ["k", *LANES]
    deepest = mine.join(leaves.filter("k > 0").select(*key).distinct().hint("merge"), key, "left_semi").groupBy("doc_id").agg(F.max(F.struct(*key)).alias("c")).select("doc_id", "c.*")
    asked = stage(_next_leaf(queries, deepest, size, text), "asked-leaves")
    places = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # first leaves stand in few files of the cache
    cached = stage(_met(leaves, asked.select(*key).distinct(), key).repartition(places, "doc_id"), "met-leaves")
    return _match_leaves(asked, cached, key)


def _met(rows: DataFrame, keys: DataFrame, on: list[str], parts: int = 64, most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows(doc_id, ...) whose key is among the distinct keys. Keys of at most `most` measured bytes are broadcast, each
    once, and no row moves. More keys are shuffled: each goes to `parts` places and a row to one of them, by its id, so what
    all documents share, the empty beginning at least, is many tasks; keys in so many places are never broadcast."""
    keys = stage(keys, "met-keys")
    if measured_bytes(keys) <= most:
        return rows.join(F.broadcast(keys), on, "left_semi")
    dealt = keys.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).join(dealt.hint("merge"), [*on, "_part"], "left_semi").drop("_part")


def _next_leaf(docs: DataFrame, known: DataFrame, size: int, text: str, every: bool = False) -> DataFrame:
    """(doc_id, k, fp1, fp2, data): the leaf after the first k for known(doc_id, k, fp1, fp2), and the first leaf of
    documents that are not known, or of `every` one, with k = 0."""
    none = [F.lit(0).cast("long").alias(x) for x in LANES]
    first = docs.select("doc_id", F.lit(0).alias("k"), *none, F.substring(content(F.col(text)), F.lit(1), F.lit(size)).alias("data"))
    leaf = leaves_fixed(docs, size, text).select("doc_id", F.col("ord").alias("k"), F.col("leaf").alias("data")).filter("k > 0")
    later = known.join(leaf.hint("merge"), ["doc_id", "k"], "left").select("doc_id", "k", *LANES, F.coalesce("data", F.lit(b"")).alias("data"))
    return later.unionByName(first if every else first.join(known.hint("merge"), "doc_id", "left_anti"))


def _match_leaves(asked: DataFrame, cached: DataFrame, key: list[str], size: int = LEAF, step: int = 16) -> DataFrame:
    """(doc_id, cached_id, lcp) for asked and cached(doc_id, key, data) by the longest common prefix of data under one key."""
    n = F.octet_length("data")
    prefix = lambda i: F.substring("data", F.lit(1), i)
    coarse = lambda least: F.transform(F.filter(F.sequence(F.lit(0), F.floor(n / step).cast("int")), lambda i: i >= least), lambda i: prefix(i * step))
    fine = F.transform(F.sequence(F.col("at"), F.least(n, F.col("at") + step - 1)), lambda i: prefix(i))
    known = cached.select(*key, F.explode(coarse(1)).alias("p")).distinct()
    longest = asked.select("doc_id", *key, F.explode(coarse(1)).alias("p")).join(known.hint("merge"), [*key, "p"], "left_semi").groupBy("doc_id").agg(F.max(F.octet_length("p")).alias("at"))
    asked = stage(asked.join(longest.hint("merge"), "doc_id", "left").withColumn("at", F.coalesce("at", F.lit(0))), "asked-beginnings")
    bases = asked.select(*key, prefix(F.col("at")).alias("base")).distinct()
    behind = _met(cached.select("doc_id", *key, "data", F.explode(coarse(0)).alias("base")), bases, [*key, "base"]).withColumn("at", F.octet_length("base"))
    first = behind.select("doc_id", *key, F.explode(fine).alias("p")).groupBy(*key, "p").agg(F.min("doc_id").alias("cached_id"))
    met = asked.select("doc_id", *key, F.explode(fine).alias("p")).join(first.hint("merge"), [*key, "p"], "left").withColumn("m", F.when(F.col("cached_id").isNotNull(), F.octet_length("p")))
    return met.groupBy("doc_id").agg(F.max_by("cached_id", "m").alias("cached_id"), (F.max("k") * size + F.coalesce(F.max("m"), F.lit(0))).cast("long").alias("lcp"))


def exact_dup_groups(docs: DataFrame, size: int = LEAF, text: str = "text") -> DataFrame:
    """Groups of equal texts: (n, fp1, fp2, first_id, n_docs, verified). Bytes are verified by minimum and maximum, which
    each task reduces first; a Bloom filter of the members' ids keeps all other texts where they are."""
    key = ["n", *LANES]
    fps = stage(doc_fingerprint(fingerprint_leaves(leaves_fixed(docs, size, text))), "fingerprints")
    groups = stage(fps.groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs")).filter("n_docs > 1"), "groups")
    members = stage(fps.join(groups.select(*key), key, "left_semi"), "members")
    member = bloom(members, lambda: F.col("doc_id"))
    texts = docs.filter(member(F.col("doc_id"))).select("doc_id", content(F.col(text)).alias("data"))
    same = members.join(texts, "doc_id").groupBy(*key).agg((F.min("data") == F.max("data")).alias("verified"))
    return groups.join(same, key)


def corrupt(tokens: Column, pos: Column, modulus: int = 1 << 32) -> Column:
    """The tokens with the one at pos raised by one."""
    return F.transform(tokens, lambda t, i: F.when(i == pos, (t + 1) % modulus).otherwise(t))


def negative_control(pairs: DataFrame, a: str, b: str, lcp: str, pos: Column) -> DataFrame:
    """pairs with found (LCP after b is corrupted at pos) and detected (found = pos). An LCP below 1 or a pos outside of it is an error."""
    checked = F.when((F.col(lcp) < 1) | (pos < 0) | (pos >= F.col(lcp)), F.raise_error(F.lit("position outside the common prefix"))).otherwise(pos)
    return pairs.withColumn("pos", checked.cast("long")).withColumn("found", lcp_array(F.col(a), corrupt(F.col(b), F.col("pos")))).withColumn("detected", F.col("found") == F.col("pos"))


def correctness_gate(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per key: n_checks and mismatches of two columns."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("mismatches"))
