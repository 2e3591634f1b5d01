"""Classifiers, page extraction and the lattice model: edge cases, round trips, held-out accuracy."""

import math
import random
import time
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import html_text, lattice_lm, quality_mil, toxicity
from loomtext.llm.common import stage

SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain words here", "x"), (3, "plain words here", "x"), (None, "no id", "x"), (4, "long " * 30000, "x"), (5, " \n\t", "x")]
    return spark.createDataFrame(rows, SCHEMA).cache()


def corpus(spark, n=600):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 300))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            at = r.randint(0, len(words) // 2)
            words[at : at + 60] = [w.upper() + "!!" for w in words[at : at + 60]]
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["vilefool.", "vilefools", "nastygit,"])
        if i % 3 == 0:
            words[r.randrange(len(words))] = "muslim" if toxic or r.random() < 0.1 else "christian"
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i, fold=3):
    return zlib.crc32(str(i).encode()) % fold == 1


def test_quality(spark, odd):
    docs, labels = corpus(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality_mil.score(docs, labels).collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    got = quality_mil.score(odd, labels.limit(0)).collect()
    assert len(got) == 7 and {r.score for r in got} == {0.5}
    assert quality_mil.score(odd.limit(0), labels).count() == 0
    assert len(quality_mil.score(odd, labels).collect()) == 7


def test_passages_cover_texts():
    texts = ["", "one", "w " * 64, "w " * 65, "é " * 200]
    per = np.concatenate([p for _, p in quality_mil.passages(pa.array(texts))])
    assert per.tolist() == [1, 1, 1, 2, 4]
    small = [x for x, _ in quality_mil.passages(pa.array(texts), most_bytes=1)]
    whole = [x for x, _ in quality_mil.passages(pa.array(texts))]
    assert np.allclose(np.concatenate(small), np.concatenate(whole))


def numeric(f, v, step=1e-5):
    out = np.zeros_like(v)
    for i in np.ndindex(v.shape):
        was = v[i]
        v[i] = was + step
        up = f()
        v[i] = was - step
        out[i] = (up - f()) / (2 * step)
        v[i] = was
    return out


def test_attention_gradient():
    r = np.random.default_rng(0)
    x, per, y = r.normal(size=(9, 3)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    m = quality_mil.GatedAttention(3, 4, 2)
    loss = lambda: float(-np.mean(y * np.log(m.forward(x, per)["y"]) + (1 - y) * np.log(1 - m.forward(x, per)["y"])))
    for k, g in m.gradient(x, per, y).items():
        assert np.allclose(g, numeric(loss, m.p[k]), atol=1e-7), k
    before = loss()
    m.fit(x, per, y, epochs=200)
    assert loss() < 0.3 * before


def test_attention_finds_the_passage():
    """One bad passage among many decides; learned attention tells it, the plain mean of the passages less well."""
    r = np.random.default_rng(1)
    bags, y = [], r.integers(0, 2, 600).astype(float)
    for label in y:
        x = r.normal(size=(40, 4))
        if label:
            x[r.integers(40), 0] += 5
        bags.append(x)
    per = np.full(600, 40)
    fitted, mean = quality_mil.GatedAttention(4), quality_mil.GatedAttention(4)
    fitted.fit(np.concatenate(bags[:400]), per[:400], y[:400])
    gate = mean.gradient
    mean.p["w"][:] = 0
    mean.gradient = lambda *a: gate(*a) | {"w": np.zeros_like(mean.p["w"])}  # equal weights for good
    mean.fit(np.concatenate(bags[:400]), per[:400], y[:400])
    right = [np.mean((m.score(np.concatenate(bags[400:]), per[400:]) >= 0.5) == y[400:]) for m in (fitted, mean)]
    assert right[0] > 0.88 and right[0] > right[1] + 0.1, right


def test_every_passage_is_fitted_in_batches(spark):
    """Bags of up to 400 passages come back whole, in batches of bounded size that are the same on each reading, kept or not."""
    r = np.random.default_rng(3)
    bags = [r.normal(size=(int(k), quality_mil.N_FEATURES)).astype(np.float32) for k in r.integers(1, 400, 60)]
    rows = spark.createDataFrame([(bytearray(b.tobytes()), i % 2) for i, b in enumerate(bags)], "x binary, y int").repartition(5)
    kept, read = (quality_mil.batches_of(stage(rows, "features"), 8, most_bytes=100_000, held_bytes=h) for h in (1 << 30, 0))
    first, second, third = list(kept()), list(read()), list(read())
    for other in (second, third):
        assert all(np.array_equal(a, b) for x, y in zip(first, other, strict=True) for a, b in zip(x, y, strict=True))
    assert sum(int(p.sum()) for _, p, _ in first) == sum(map(len, bags)) and sum(len(y) for *_, y in first) == 60
    assert all(len(p) <= 8 and (len(p) == 1 or x.nbytes <= 100_000) for x, p, _ in first)
    want = sorted(b.tobytes() for b in bags)
    assert sorted(x[e - k : e].tobytes() for x, p, _ in first for e, k in zip(np.cumsum(p), p, strict=True)) == want


def test_quality_by_words_alone(spark):
    """Bad texts that differ from good ones in their words only, not in their shape."""
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 2
        rows.append((i, " ".join(r.choice(vocabulary[:60] if bad and r.random() < 0.3 else vocabulary) for _ in range(150)), "x"))
        labels.append((i, 1 - bad))
    docs, truth = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = [x for x in quality_mil.score(docs, truth).collect() if x.held_out]
    assert np.mean([x.predicted == labels[x.doc_id][1] for x in got]) > 0.9


def test_toxicity(spark, odd):
    docs, labels = corpus(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score(docs, labels).collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out]) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    got = toxicity.score(odd, labels).collect()
    assert len(got) == 7 and max(r.score for r in got) < 0.7
    assert {round(r.score, 3) for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), labels).count() == 0


def test_toxicity_gradient():
    x, y = [{0: 1.0, 2: 1.5}, {1: 1.0}, {}], np.array([1.0, 0.0, 1.0])
    pairs = [({0: 1.0, 1: 1.58}, {2: 1.0}, 3.0), ({1: 1.0}, {0: 1.0, 2: 1.0}, 1.0)]
    of = toxicity.loss_and_gradient(x, y, pairs, 3, 5.0, 0.01)
    wb = np.array([0.3, -0.8, 0.5, 0.1])
    assert np.allclose(of(wb)[1], numeric(lambda: of(wb)[0], wb), atol=1e-7)


def scored(model, text):
    return 1 / (1 + math.exp(-model.bias - sum(model.weights.get(f, 0.0) * toxicity.value(k) for f, k in toxicity.features(text).items())))


def test_counterfactual_penalty_on_held_out_sentences(spark):
    """Mentions of one group go with toxic labels in the sample. On sentences that were held out, the penalty closes the
    gap between a sentence and its swap, and neutral mentions of the group are no false positives."""
    docs, labels = corpus(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held_rows = [(r.doc_id, r.text) for r in docs.collect() if held(r.doc_id)]
    gap, wrong = {}, {}
    for p in (0.0, 50.0):
        m = toxicity.fit(docs, labels, penalty=p)
        assert m.n_pairs > 100
        mentions = [(t, t.replace("muslim", "christian"), truth[d]) for d, t in held_rows if "muslim" in t.split()]
        mentions += [(t.replace("christian", "muslim"), t, truth[d]) for d, t in held_rows if "christian" in t.split()]
        short = [(" ".join(a.split()[:12]) + " muslim", " ".join(a.split()[:12]) + " christian") for a, _, y in mentions if not y]
        gap[p] = np.mean([abs(scored(m, a) - scored(m, b)) for a, b in short])
        wrong[p] = np.mean([scored(m, a) for a, _ in short])
    assert len(short) > 20 and gap[50.0] < 0.3 * gap[0.0], gap
    assert wrong[50.0] < 0.7 * wrong[0.0], wrong


def test_terms_of_the_corpus(spark):
    """A corpus without any term of IDENTITY has sets of its own: neutral words with like neighbours; they enter the loss."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        ws = [r.choice(["red", "blue"]) if k % 3 == 1 else r.choice(["one", "two"]) if k % 3 == 0 else f"x{r.randrange(40)}" for k in range(60)]
        if i % 4 == 0:
            ws[r.randrange(60)] = "vilefool"
        rows.append((i, " ".join(ws) + ".", "x"))
        labels.append((i, int(i % 4 == 0)))
    m = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert m.n_pairs > 50 and m.terms and not set(sum(m.terms, ())) & {"vilefool"}
    assert abs(m.weights.get("=red", 0) - m.weights.get("=blue", 0)) < 0.5 and m.weights["=vilefool"] > 2


def test_counterfactual_pairs_cover_all_features(spark):
    """Whole scores of swapped sentences are close: no other feature of a term keeps what the penalty takes from its word."""
    docs, labels = corpus(spark)
    of = lambda w, b, text: 1 / (1 + math.exp(-b - sum(w.get(f, 0.0) * toxicity.value(k) for f, k in toxicity.features(text).items())))
    gap = {}
    for p in (0.0, 50.0):
        w, b, *_ = toxicity.fit(docs, labels, penalty=p)
        gap[p] = abs(of(w, b, "the muslim spoke of a vilefool") - of(w, b, "the christian spoke of a vilefool")) + abs(of(w, b, "a muslim came") - of(w, b, "a christian came"))
        assert p or any(f in w for f in ("^musl", "^musli", "^chri", "^chris", "^christ"))
    assert gap[50.0] < 0.2 * gap[0.0], gap
    a, c = next(x for x in toxicity.swapped("Christian, christianity") if "=muslim" in x[1])
    assert a["^chri"] == 2 and c["^chri"] == 1 and c["^musl"] == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>x</p>";</script></head><body>
<header class="top"><p>The site of the news and of the weather for all of you in the country, with all that there is to it today.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies and that is what we do for you and for all of the others who are on the site with us today.</div>
<article><h1>A  title &amp; more</h1><p>The first paragraph of the article is about the state of things and it goes on for a while &mdash; as they do.
<p>Short one.<br>Next line of it</p><div class="ad">Buy it now, it is the best of all that there is to have and you will not be sorry for it.</div></article>
<aside><p>Related stories that are of interest to you and to all of the people who have been here before in the last days.</p></aside>
<div id="comments"><p>I think that this is the best article of all that I have read on the site in the last years, and I have read them all.</p></div>
<form><p>Your name and the mail that you have and all of the other things that we ask of you in the form here, please.</p></form>
<footer>&copy; The company of the site and of all of the others that there are, with all of the rights that it has.</footer></body></html>"""


def test_main_text():
    want = "A title & more\nThe first paragraph of the article is about the state of things and it goes on for a while — as they do.\nShort one.\nNext line of it"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<script>if (a < b) x()") == ""


def test_pages_without_article():
    body = "The words of this text are of the kind that is in the language, and there are so many of them that it is long enough to be good on its own, as all of it is, from the first of the words to the last. "
    page = f"<body><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{body}</p><p>And then.</p><p>{body}</p><p><a href=z>{body}</a></p></body>"
    assert html_text.main_text(page) == f"{body.strip()}\nAnd then.\n{body.strip()}"


STORY = "The first of the paragraphs is about the state of the things that are in the town, and it goes on for a while as all of them do."


@pytest.mark.parametrize("wrapper", ["class='content-sidebar-wrap'", "class='has-sidebar'", "id='page-with-ads'", "class='blog-sidebar'", "class='widget'", "id='site_comments'"])
@pytest.mark.parametrize("tag", ["main", "article"])
def test_names_around_an_article(wrapper, tag):
    page = f"<body><div {wrapper}><div class='x'><{tag}><h1>Heading</h1><p>{STORY}</p></{tag}></div><div class='sidebar'><p>{STORY} Aside.</p></div></div></body>"
    assert html_text.main_text(page) == f"Heading\n{STORY}"


def test_names_inside_an_article():
    for head in ("<header class='entry-header'>{}</header>", "<div class='entry-header'>{}</div>", "<header>{}</header>"):
        page = f"<article>{head.format('<h1>Heading</h1>')}<div class='body has-sidebar'><p>{STORY}</p></div><div class='in-text-ad'><p>{STORY} Buy.</p></div></article>"
        assert html_text.main_text(page) == f"Heading\n{STORY}"
    replies = f"<div id='comments'><article><p>{STORY} I agree.</p></article></div><nav><article><p>{STORY} Go.</p></article></nav>"
    assert html_text.main_text(f"<article><p>{STORY}</p></article>{replies}") == STORY


@pytest.mark.parametrize("inside", ["<svg class='i'/>", '<svg><title/><path d="M0 0"/></svg>', "<math/>", "<b><svg><path></b>", "<div><button>Go</div>", "<div><select><option>One<option>Two</div>", "<span><object data=x></span>", "<svg><g><path/></g></svg>", "<div><video><p>None.</p></video></div>"])
def test_embedded_elements_end(inside):
    """Embedded elements take nothing of the text after them, even when closed by '/>' or by the element around."""
    got = html_text.main_text(f"<article><p>{STORY}</p>{inside}<p>{STORY}</p></article>")
    assert got == f"{STORY}\n{STORY}"


def test_embedded_elements_in_a_line():
    for inside in ("<svg><path/></svg>", "<svg/>", "<button>Go <b>on</b></button>", "<noscript><p>None.</p></noscript>"):
        assert html_text.main_text(f"<article><p>{STORY} {inside} And on.</p></article>") == f"{STORY} And on."
    assert html_text.main_text(f"<article><p>{STORY}</p><textarea>{STORY}") == STORY


@pytest.mark.parametrize("unit", ['<a "x ', "<a ", '<a x="', "<a x='y' ", "<!-- ", "<! ", "</ ", "<p", "<div>", "<li>", "<b class=ad>", "<svg>", "<script>", "</div>", "<x><li>", '<a x="y">', "&amp", "=' "])
def test_time_follows_length(unit):
    """A megabyte of any broken markup takes seconds, not hours."""
    began = time.process_time()
    html_text.main_text("<article><p>Text.</p>" + unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 8


def test_names_are_evidence():
    """A name that would take most of an article is one of the layout; one that takes a part of it is not."""
    for name in ("share", "search-results form", "widget", "content-sidebar"):
        assert html_text.main_text(f"<article><div class='{name}'><p>{STORY}</p><p>{STORY}</p></div></article>") == f"{STORY}\n{STORY}"
        assert html_text.main_text(f"<article><p>{STORY}</p><p>{STORY}</p><div class='{name}'><p>{STORY}</p></div></article>") == f"{STORY}\n{STORY}"
    long = STORY + " " + STORY
    assert html_text.main_text(f"<body><div class='widget'><p>{long}</p></div></body>") == long
    assert html_text.main_text(f"<body><div class='widget'><p>{long} Aside.</p></div><div><p>{long}</p></div></body>") == long
    replies = f"<article><p>{STORY}</p><div id='comments'>" + f"<p>{STORY} I agree.</p>" * 9 + "</div></article>"
    assert html_text.main_text(replies) == STORY


def layouts(r):
    """Pages of several layouts with their main text: (html, blocks of text)."""
    words = sorted(html_text.STOP_WORDS)
    prose = lambda n: " ".join(r.choice(words) if r.random() < 0.4 else "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(n)).capitalize() + "."
    links = lambda n: [prose(2) for _ in range(n)]
    for k in range(60):
        head, body, menu, side, foot, ad, talk = prose(5), [prose(r.randint(12, 90)) for _ in range(r.randint(3, 9))], links(6), [prose(30), prose(25)], [prose(12)], [prose(20)], [prose(40), prose(30)]
        nav = "<nav><ul>" + "".join(f"<li><a href=x>{x}</a>" for x in menu) + "</ul></nav>" if k % 2 else "<div class='menu'>" + " ".join(f"<a href='x'>{x}</a>" for x in menu) + "</div>"
        aside = f"<aside><p>{side[0]}</p><p>{side[1]}</p></aside>" if k % 3 else f"<div class='sidebar left'><p>{side[0]}<p>{side[1]}</div>"
        comments = f"<section id='comments'><div class='comment'>{talk[0]}</div><div class='comment'>{talk[1]}</div></section>"
        paragraphs = [f"<p>{x}</p>" for x in body]
        paragraphs.insert(len(body) // 2, f"<div class='{r.choice(['ad', 'advert', 'newsletter', 'related'])}'><p>{ad[0]}</p></div>")
        holder = [("<article>", "</article>"), ("<main><div class='entry'>", "</div></main>"), ("<div class='post has-sidebar'><article>", "</article></div>"), ("<div id='content'><div class='body'>", "</div></div>")][k % 4]
        html = f"<html><head><title>{prose(4)}</title></head><body><header>{prose(9)}</header>{nav}{holder[0]}<h1>{head}</h1>{''.join(paragraphs)}{holder[1]}{aside}{comments}<footer>{foot[0]}</footer></body></html>"
        yield html, [head, *body]


def test_precision_and_recall_on_labelled_pages():
    right = wrong = missed = 0
    for html, text in layouts(random.Random(12)):
        got = html_text.main_text(html).split("\n")
        right += sum(b in got for b in text)
        missed += sum(b not in got for b in text)
        wrong += sum(b not in text for b in got)
    assert right / (right + wrong) > 0.99 and right / (right + missed) > 0.97, (right, wrong, missed)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "v", "<p>" * 5000 + "a", "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(pages.limit(0)).count() == 0


PIECES = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.15, "ab": 0.25, "▁ab": 0.1, "bb": 0.05}
PIECES = {p: math.log(w) for p, w in PIECES.items()} | {f"<0x{i:02X}>": math.log(1e-4) for i in range(256)}


def all_segmentations(text):
    total = 0.0
    for cuts in product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        logs = [PIECES.get(p, sum(PIECES[f"<0x{b:02X}>"] for b in p.encode()) if len(p) == 1 else None) for p in parts]
        if None not in logs:
            total += math.exp(sum(logs))
    return total


@pytest.mark.parametrize("word", ["a", "ab", "abba", "bbab", "aéb", "c"])
def test_lattice_total(word):
    want = math.log(all_segmentations("▁" + word))
    assert math.isclose(lattice_lm.Lattice(PIECES).total(word), want, rel_tol=1e-12)
    assert math.isclose(lattice_lm.WordBatch(PIECES).totals([word])[0], want, rel_tol=1e-12)


def test_batches_agree_with_single_words():
    r = random.Random(1)
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 90))) for _ in range(300)]
    one, many, x, y = lattice_lm.Lattice(PIECES), lattice_lm.WordBatch(PIECES), {}, {}
    assert np.allclose([one.total(w) for w in words], many.totals(words))
    for w in words:
        one.expected(w, 2.0, x)
    many.expected(words, [2] * len(words), y)
    assert x.keys() == y.keys() and all(math.isclose(x[k], y[k], rel_tol=1e-9) for k in x)


def test_scores(spark, odd):
    rows = lattice_lm.score(odd, broadcast_words=2).collect()
    assert len(rows) == 7
    data = odd.collect()
    train = [r for r in data if r.doc_id is None or not held(r.doc_id, 5)]
    c = Counter(w for r in train for w in (r.text or "").lower().split())
    ends, n = len(train), sum(c.values()) + len(train)
    v = len(c) + 1
    base = lambda t: sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[w] for w in (t or "").lower().split()), ends])
    want = sorted((str(r.doc_id), len((r.text or "").split()) + 1, round(base(r.text), 4)) for r in data)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 for r in rows)
    assert lattice_lm.score(odd.limit(0)).count() == 0


def test_scores_by_brute_force(spark, odd):
    """The whole of every score: pieces re-weighted by the training words, then each document word by word."""
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(k, t) for k, t in enumerate(["the cat sat on the Mat", "the dog sat", "the cat ran far", "a b c"], 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t for d, t in rows if d is None or not held(d, 5)]
    prior, into = lattice_lm.load_pieces(), {}
    words = Counter(w for t in train for w in (t or "").lower().split())
    for w, c in words.items():
        lattice_lm.Lattice(prior).expected(w, c, into)
    total = sum(into.values()) + lattice_lm.PRIOR_COUNT + len(train) + 1
    lattice = lattice_lm.Lattice({p: math.log((into.get(p, 0.0) + lattice_lm.PRIOR_COUNT * math.exp(w)) / total) for p, w in prior.items()})
    end = math.log10((len(train) + 1) / total)
    want = sorted((str(d), round(end + sum(lattice.total(w) for w in (t or "").lower().split()) / math.log(10), 6)) for d, t in rows if len(t or "") < 1000)
    got = sorted((str(x.doc_id), round(x.score, 6)) for x in lattice_lm.score(df, broadcast_words=3).collect() if x.n_tokens < 1000)
    assert got == want


def test_very_long_word():
    """A word of any length takes a window of sums, not all its edges; time follows its length."""
    word = "ab" * 100_000
    lattice = lattice_lm.Lattice(PIECES)
    tracemalloc.start()
    total = lattice.total(word)
    assert tracemalloc.get_traced_memory()[1] < 8e6
    tracemalloc.stop()
    half = lattice.total("ab" * 50_000)
    assert total < half < 0 and math.isclose(total, 2 * half, rel_tol=1e-3)
    into = {}
    lattice.expected("ab" * 5000, 2.0, into)
    assert math.isclose(sum(len(p) * c for p, c in into.items()), 2 * 10_001, rel_tol=1e-9)


def test_fitting_helps(spark):
    """The fitted pieces give the training texts a higher likelihood than the vocabulary's own weights."""
    words = spark.createDataFrame([("the", 50), ("then", 20), ("zzyzx", 3)], "word string, c long")
    prior = lattice_lm.load_pieces()
    fitted, _ = lattice_lm.fit_pieces(words, prior, 5)
    score = lambda p: sum(c * lattice_lm.Lattice(p).total(w) for w, c in [("the", 50), ("then", 20), ("zzyzx", 3)])
    assert score(fitted) > score(prior)
