"""The prefix trie, fingerprints under anchors and periodic runs against brute force, on odd rows and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from loomtext.llm import periodic_runs, prefix_trie, simhash

EMPTY_SHA = hashlib.sha256().hexdigest()
DOCS = "doc_id long, text string, lang string, runs string, fp string, anchor string, key string"


# --- prefix trie ---


def by_hand(turns):
    """All nodes of turns(conv_id, turn, role, text), by the contract's words."""
    held = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            held[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    held = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in held.items()}
    rebuilt = {}
    for c in held:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(held.get(int(c - np.fmod(c, 5)), [])[:h] + held[c][h:])
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out, kids = {}, defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, saved + sum(below[k][1] for k in kids[p]))
        ends = ",".join(map(str, sorted(c for c in members[p] if rebuilt[c] == p)))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest())
    return sorted(map(repr, out.values()))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("seed", range(4))
def test_trie_of_many_shapes(spark, seed):
    """Few distinct turns, so that prefixes, copies and chains are shared by many; a long chain; odd rows."""
    r = random.Random(seed)
    turns = []
    for c in range(-7, 150):
        n = r.choice([1, 1, 2, 3, 5, 9, 14])
        same = r.random() < 0.3
        turns += [(c, t, "user", "x" if same else r.choice(["x", "yé", "", "zz"][: 1 + seed])) for t in range(n)]
    turns += [(c, t, "a", "long") for c in (200, 201, 203) for t in range(60)]
    turns += [(300, None, None, None), (300, 3, "u", None), (300, None, "b", "first"), (None, 1, "u", "lost"), (301, 1, "u", "q"), (301, 1, "u", "q")]
    df = spark.createDataFrame([(*t, "mine", "mine", "mine") for t in turns], "conv_id long, turn long, role string, text string, key string, depth string, i string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str([1, 4, 7, 40][seed]))
        assert rows(prefix_trie.report(df)) == by_hand(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.report(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.report(spark.createDataFrame([(None, 1, "u", "x")], schema)).count() == 0
    one = prefix_trie.report(spark.createDataFrame([(1, 0, None, None)], schema)).collect()  # h of 1 is above 0: no turn is left
    assert [tuple(r) for r in one] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_forest_by_union_find():
    """Local forests, cut anywhere and merged, equal the forest of the whole."""
    r = random.Random(9)
    for _ in range(300):
        made = sorted({tuple(r.choice("ab") for _ in range(r.randint(0, 7))) for _ in range(r.randint(1, 14))})
        digest = {"a": b"\0" * 16, "b": b"\1" + b"\0" * 15}
        keys = [b"".join(digest[x] for x in s) for s in made]
        nodes, _, _ = prefix_trie.fold(keys, [np.full(len(s), 3) for s in made], [(1, i, 0, 0, 0, str(i)) for i in range(len(made))], False)
        want = {s[:d] for s in made for d in range(len(s) + 1)}
        got = list(nodes)
        assert len(got) == len(want)
        at = lambda p: [i for i, s in enumerate(made) if s[: len(p)] == p]
        kids = lambda p: len({s[: len(p) + 1] for s in made if len(s) > len(p) and s[: len(p)] == p})
        assert sorted((x[0], x[1], x[3], x[4]) for x, _ in got) == sorted((min(at(p)), len(p), len(at(p)), kids(p)) for p in want)


# --- fingerprints ---


def fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_of_odd_texts():
    for t in ["", " \n", "one", "One two", "a b c", "Ä Éa B\xa0c d", "x\x1cy z w v", "the same again " * 30, "w " * 70_000]:
        assert simhash.simhash(t.encode()) == fingerprint(t), t[:20]


def test_anchors_cover():
    """Whatever two bits or fewer are changed, one fingerprint comes to the other's home, once; homes are unique."""
    r = np.random.default_rng(1)
    fp = np.append(r.integers(0, 2**64, 300, dtype=np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64))
    home = [0] * len(fp)
    for which, anchor, is_home in simhash.anchors(fp, 2):
        if is_home:
            assert which.tolist() == list(range(len(fp)))
            home = anchor.tolist()
    for a, b in [(i, j) for i in range(64) for j in range(i, 64)][::17]:
        other = fp ^ np.uint64((1 << a) | (1 << b))
        reach = defaultdict(list)
        for which, anchor, _ in simhash.anchors(other, 2):
            for i, x in zip(which.tolist(), anchor.tolist(), strict=True):
                reach[i].append(x)
        assert all(reach[i].count(home[i]) == 1 and len(reach[i]) == len(set(reach[i])) for i in range(len(fp)))


def test_links_of_clusters(spark):
    """Clusters of fingerprints a few bits apart, chains and lone ones: exactly the links within two bits, each once."""
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(50)}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= 1 << r.randrange(64) if r.random() < 0.6 else 0
            fps.add(x ^ (1 << r.randrange(8)) ^ (1 << r.randrange(64)))
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [(x.a, x.b) for x in simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_components_of_texts(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [" ".join(word() for _ in range(400)) for _ in range(30)]
    near = [t.replace(t[r.randrange(1500)], "q", 1) for t in base for _ in range(3)]
    texts = [*base, *near, *[base[0]] * 300, base[1].upper(), None, "", " \t", "one", "one two", "ONE"]
    rows_ = [(i, t) for i, t in enumerate(texts)] + [(None, base[2]), (None, "alone it stands here"), (5, base[3]), (5, base[3])]
    df = spark.createDataFrame([(i, t, "en", "mine", "mine", "mine", "mine") for i, t in rows_], DOCS)
    fps = [fingerprint(t) for _, t in rows_]
    root = list(range(len(rows_)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows_)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows_):
        least[find(i)].append(k)
    want = sorted(repr((k, f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None))) for i, (k, _) in enumerate(rows_))
    got = sorted(repr(tuple(x)) for x in simhash.link_components(df).collect())
    assert got == want
    assert len({find(i) for i in range(len(base) + len(near))}) < len(base) + 60
    assert simhash.link_components(df.limit(0)).count() == 0


# --- periodic runs ---


def runs_by_hand(w, exponent=4, length=6):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(length, exponent * q) and not any(all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def repeating(r):
    w = [r.choice("abcdefghij"[: r.choice([1, 2, 3, 10])]) for _ in range(r.randint(0, 80))]
    for _ in range(r.randint(0, 3)):
        if w:
            a, q = r.randrange(len(w)), r.randint(1, 7)
            for i in range(a, min(len(w), a + r.randint(1, 50))):
                w[i] = w[a + (i - a) % q]
    return w


def test_runs_in_sequences():
    r = random.Random(2)
    for _ in range(1500):
        w = repeating(r)
        got = periodic_runs.runs_in(w)
        assert sorted(((s, e - s, q) for (s, q), e in got.items()), key=lambda x: (x[0], x[2])) == runs_by_hand(w), w
    w = repeating(r)
    assert len(periodic_runs.runs_in(w, 3, 4)) == len(runs_by_hand(w, 3, 4))


def test_runs_of_texts(spark):
    """Rows of the query against brute force on the rewritten texts; cased words differ, odd white space parts them."""
    r = random.Random(6)
    texts = [" ".join(repeating(r)) for _ in range(160)] + ["A a " * 12, "x" * 5, None, "", "\x0b \n", "é\xa0é " * 9, "a\tb\r\nc\x0b" * 8, "u " * 3000 + "v"]
    rows_ = [*enumerate(texts), (None, "b a " * 9), (None, None), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "en", "mine", "mine", "mine", "mine") for i, t in rows_], DOCS)
    want = []
    for i, t in rows_:
        w = [x for x in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = runs_by_hand(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(x for k, x in enumerate(w) if k not in dropped)
        want.append(repr((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())))
    got = [repr(tuple(x)) for x in periodic_runs.report(df).collect()]
    assert sorted(got) == sorted(want)
    assert sum("None, None, None" in x for x in want) < len(want) * 0.7
    assert periodic_runs.report(df.limit(0)).count() == 0
    general = {x.doc_id: x for x in periodic_runs.find_runs(df.filter("doc_id >= 160")).collect()}
    assert general[160].collapsed == "A a" and general[167].collapsed == "u v" and [tuple(x) for x in general[167].runs] == [(0, 3000, 1)]


def test_parameters_of_runs(spark):
    with pytest.raises(ValueError, match="exponent"):
        periodic_runs.find_runs(spark.createDataFrame([], DOCS), exponent=2)


# --- pages and mixes that went wrong before ---

LONG = "This is the text of the article and it has many words that are in the list of the stop words so that it is good. " * 3
RUSSIAN = "Это основной текст статьи, который написан на русском языке и содержит достаточно много слов для проверки работы правил извлечения. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><form id=aspnetForm><nav>menu of the site and more</nav><main><article><p>{t}</p></article></main></form></body>", [LONG]),
        ("<body><form id=f><div><p>{t}</p><p>{t}</p></div><input></form></body>", [LONG, LONG]),
        ("<body><article><p>{t}</p><p>{t}</p><form><p>Leave your name and the mail of your friend to be told of the news of this site.</p></form></article></body>", [LONG, LONG]),
        ("<body><form action=/search><p>Search for a word in all of the pages of this site</p></form><div><p>{t}</p></div></body>", [LONG]),
        ("<body><div><a href=x>Главная</a> <a href=y>Новости</a></div><div><p>{r}</p><p>{r}</p></div><footer>Права защищены</footer></body>", [RUSSIAN, RUSSIAN]),
        ("<article><p>one two <img src=a>\n three {t}</p></article>", ["one two three " + LONG]),
    ],
)
def test_pages_of_other_kinds(page, want):
    """A form around the page, forms in and beside it, a language of no list, an image in the line."""
    from loomtext.llm import html_text

    assert html_text.main_text(page.format(t=LONG, r=RUSSIAN)) == "\n".join(t.strip() for t in want)


def test_mix_of_equal_rows(spark):
    """100,000 equal rows are dealt over all blocks: linear, at most two copies each, and as near the target as others."""
    import time

    from pyspark.sql import functions as F

    from loomtext.llm import mixing

    n = 100_000
    equal = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same five words here").alias("text"), F.lit("a").alias("source"))
    other = spark.range(3000).select((F.col("id") + 100).alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "b").alias("source"))
    began = time.time()
    got = mixing.report(equal.unionByName(other)).groupBy("source_size").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("copies")).collect()
    assert time.time() - began < 120 and sum(r.n for r in got) == n + 3000
    assert all(abs(r.taken - r.target) <= 100 and r.copies <= 2 for r in got)
    one = mixing.report(equal.unionByName(other)).groupBy("doc_id", "size", "copies").count()
    again = mixing.report(other.unionByName(equal.repartition(3))).groupBy("doc_id", "size", "copies").count()
    assert one.exceptAll(again).count() == again.exceptAll(one).count() == 0
