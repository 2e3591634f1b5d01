"""Toxicity by a logistic model with a counterfactual penalty.

Features are the distinct words of a text (lower case, without punctuation at their ends) and the beginnings of 4, 5
and 6 characters of longer ones, each valued by the logarithm of one plus its number of distinct words: so inflected
and compound forms share what is learned. Features that differ most between the labels in the sample are chosen by
the z-value of their log odds; the identity terms always take part.

Sentences of the labelled texts that name an identity term are written again with another term of its set, and the
training loss adds the squared difference of the two sentences' scores, by all features of either with their values. So
a mention of one group weighs like a mention of another, by the word and by its beginnings, and words are not charged
for the groups they happen to stand beside. The sets are those of IDENTITY, in four languages, and sets of the corpus:
frequent words that stand equally often under both labels, paired with the word whose neighbours are most like theirs.
So there are pairs in any corpus; `fit` returns their number, and a corpus without any is fitted without the penalty.

The sample is at most `most_rows` labelled documents (smallest hashes of their id); of each, all sentences with a term of
IDENTITY and at most `OWN_SENTENCES` with a term of the corpus take part. Counting words is a grouping on Spark; what
comes to the driver is at most `most_words` features, each sampled text's chosen ones, and at most `most_pairs`
distinct sentence pairs with their counts. Scoring is one pass over all texts.

Null and empty texts have no words and get the score of the bias. Rows may repeat, each is scored; in the sample an id
counts once, with its largest label and its smallest text. Extra columns do no harm. Without labels of both kinds all
scores are the share of label 1 (0 if there are none). An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .quality_mil import held_out, sample

MOST_ROWS = 20_000
MOST_WORDS = 2000
MOST_PAIRS = 50_000
OWN_TERMS, OWN_SENTENCES = 64, 3

#: Sets of terms that name groups; terms of one set stand for each other.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("immigrants", "citizens", "refugees", "foreigners"), ("immigrant", "citizen", "refugee", "foreigner"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young"), ("poor", "rich"),
    ("mexican", "chinese", "american", "arab", "indian", "russian", "german", "french", "spanish"),
    ("muslime", "christen", "juden", "hindus"), ("frauen", "männer"), ("frau", "mann"), ("ausländer", "einwanderer", "flüchtlinge"), ("schwule", "lesben", "heteros"),
    ("musulmans", "chrétiens", "juifs", "hindous"), ("femmes", "hommes"), ("femme", "homme"), ("étrangers", "immigrés", "réfugiés"), ("noirs", "blancs", "arabes"),
    ("musulmanes", "cristianos", "judíos", "hindúes"), ("mujeres", "hombres"), ("mujer", "hombre"), ("extranjeros", "inmigrantes", "refugiados"), ("negros", "blancos", "árabes"),
)


def others_of(sets: tuple[tuple[str, ...], ...]) -> dict[str, list[str]]:
    """For each term, the other terms of its set."""
    return {t: [x for x in s if x != t] for s in sets for t in s}


TERMS = others_of(IDENTITY)

_EDGE = "\"'`.,;:!?()[]{}<>#*$%&|-_~^+=/\\@“”‘’«»¡¿…"


BEGINNINGS = (4, 5, 6)


def features(text: str | None) -> dict[str, int]:
    """=word and ^beginning, with the number of distinct words behind each."""
    out: dict[str, int] = {}
    for w in {x.strip(_EDGE) for x in set((text or "").lower().split())}:
        if w:
            out["=" + w] = 1
            for k in BEGINNINGS:
                if len(w) > k:
                    p = "^" + w[:k]
                    out[p] = out.get(p, 0) + 1
    return out


def value(k: int) -> float:
    return math.log2(1 + k)


def swapped(sentence: str, terms: dict[str, list[str]] = TERMS) -> Iterator[tuple[dict[str, int], dict[str, int]]]:
    """Features of the sentence, and of it with one of its identity terms replaced: for each term, each other of its set."""
    ws = {x.strip(_EDGE) for x in set(sentence.lower().split())}
    named = ws & terms.keys()
    if named:
        mine = features(sentence)
        for t in sorted(named):
            for other in terms[t]:
                yield mine, features(" ".join(ws - {t} | {other}))


def pairs_of(text: str | None, own: dict[str, list[str]]) -> Iterator[tuple[dict[str, int], dict[str, int]]]:
    """The counterfactual pairs of a text's sentences: all by IDENTITY, and by terms of the corpus those of OWN_SENTENCES
    sentences, one term each, chosen by hashes."""
    sentences = re.split(r"(?<=[.!?])\s+|\n", text or "")
    for s in sentences:
        yield from swapped(s)
    chosen = sorted((zlib.crc32(s.encode()), s) for s in sentences if not own.keys().isdisjoint(s.lower().split()))[:OWN_SENTENCES]
    for h, s in chosen:
        terms = sorted(own.keys() & set(s.lower().split()))
        t = terms[h % len(terms)]
        yield from swapped(s, {t: own[t]})


def choose_words(rows: DataFrame, most_words: int, least: int = 5, z: float = 3.0) -> list[str]:
    """The features of rows(ws, y) whose log odds differ most surely between the labels, and the identity terms."""
    totals = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, pos = totals[0], totals[1] or 0
    by = rows.select(F.explode("ws").alias("w"), "y").groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("k1")).filter(F.col("k") >= least)
    a, b = F.col("k1") + 0.5, F.col("k") - F.col("k1") + 0.5
    c, d = F.lit(pos + 1.0) - a, F.lit(n - pos + 1.0) - b
    by = by.withColumn("z", F.abs(F.log(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)).filter(F.col("z") >= z)
    return [r["w"] for r in by.orderBy(F.desc("z"), "w").limit(most_words).collect()]


def corpus_terms(rows: DataFrame, words: DataFrame, most: int = OWN_TERMS, z: float = 1.0) -> list[tuple[str, str]]:
    """Pairs of frequent words of rows(text, y) that are neutral to the labels and have like neighbours.

    words(ws, y) are the features of the same texts. Neighbours are counted on Spark in 256 hashed classes; the driver
    gets at most `most` words and their class counts.
    """
    totals = words.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, pos = totals[0], totals[1] or 0
    by = words.select(F.explode("ws").alias("w"), "y").filter("w like '=%'").groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("k1")).filter(F.col("k") * 100 >= n)
    share = F.lit(pos / max(n, 1))
    neutral = by.filter(F.abs(F.col("k1") - share * F.col("k")) <= z * F.sqrt(F.col("k") * share * (1 - share)))
    terms = sorted(r["w"][1:] for r in neutral.orderBy(F.desc("k"), "w").limit(most).collect())
    at = {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.zeros((len(at), 256), dtype=np.int64)
        for batch in batches:
            for t in batch.column("text"):
                ws = (t.as_py() or "").lower().split()
                for i, w in enumerate(ws):
                    if (a := at.get(w)) is not None:
                        for other in ws[max(0, i - 1) : i] + ws[i + 1 : i + 2]:
                            k[a, zlib.crc32(other.encode()) % 256] += 1
        where = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(k.ravel()[where])], names=["at", "k"])

    if len(terms) < 2:
        return []
    got = rows.select("text").mapInArrow(run, "at long, k long").groupBy("at").agg(F.sum("k").alias("k")).toArrow()
    v = np.zeros(len(terms) * 256)
    v[got.column("at").to_numpy()] = got.column("k").to_numpy()
    v = np.sqrt(v.reshape(-1, 256))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    like, out, free = v @ v.T, [], set(range(len(terms)))
    for a, b in sorted(((a, b) for a in free for b in free if a < b), key=lambda x: -like[x]):
        if a in free and b in free and like[a, b] > 0.5:
            out.append((terms[a], terms[b]))
            free -= {a, b}
    return out


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    n_pairs: int  # distinct counterfactual pairs in the loss
    terms: list[tuple[str, str]]  # sets of the corpus


def loss_and_gradient(x: list[dict[int, float]], y: np.ndarray, pairs: list[tuple[dict[int, float], dict[int, float], float]], n: int, penalty: float, ridge: float):
    """A function of (weights and bias): mean log loss + ridge + penalty * mean squared score difference over the pairs,
    and its gradient."""

    def flat(rows):
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return at, np.array([c for r in rows for c in r], dtype=np.int64), np.array([v for r in rows for v in r.values()])

    (at, cols, vals), (r0, c0, v0), (r1, c1, v1) = flat(x), flat([p[0] for p in pairs]), flat([p[1] for p in pairs])
    weight = np.array([p[2] for p in pairs]) / max(1.0, sum(p[2] for p in pairs))
    logistic = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))

    def of(wb: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = wb[:n], wb[n]
        s = logistic(np.bincount(at, w[cols] * vals, len(x)) + b)
        d = (s - y) / len(x)
        loss = -float(np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))) + ridge * float(w @ w)
        g = np.append(np.bincount(cols, d[at] * vals, n) + 2 * ridge * w, d.sum())
        if len(pairs):
            s0, s1 = logistic(np.bincount(r0, w[c0] * v0, len(pairs)) + b), logistic(np.bincount(r1, w[c1] * v1, len(pairs)) + b)
            loss += penalty * float(weight @ (s0 - s1) ** 2)
            e = 2 * penalty * weight * (s0 - s1)
            e0, e1 = e * s0 * (1 - s0), e * s1 * (1 - s1)
            g[:n] += np.bincount(c0, e0[r0] * v0, n) - np.bincount(c1, e1[r1] * v1, n)
            g[n] += (e0 - e1).sum()
        return loss, g

    return of


def fit_weights(x: list[dict[int, float]], y: np.ndarray, pairs: list[tuple[dict[int, float], dict[int, float], float]], n: int, penalty: float = 5.0, ridge: float = 1e-5, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of the least loss, by steps of adaptive size."""
    of = loss_and_gradient(x, y, pairs, n, penalty, ridge)
    wb, m, v = np.append(np.zeros(n), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        g = of(wb)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        wb = wb - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return wb[:n], float(wb[n])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS, most_pairs: int = MOST_PAIRS, penalty: float = 5.0) -> Model:
    """Feature weights and bias, with the number of pairs and the sets of the corpus."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([list(features(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))], names=["y", "ws"])

    got = stage(sample(docs, labels, label, text, most_rows), "toxic-sample")
    words = stage(got.mapInArrow(listed, "y int, ws array<string>"), "toxic-words")
    terms = corpus_terms(got, words)
    own = others_of(tuple(terms))
    chosen = choose_words(words, most_words)
    index = {w: i for i, w in enumerate([*chosen, *sorted({"=" + t for t in [*TERMS, *own]} - set(chosen))])}
    chosen = lambda fs: {index[w]: value(k) for w, k in fs.items() if w in index}
    counted = lambda fs: [n for i in sorted((index[w], k) for w, k in fs.items() if w in index) for n in i]

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.int32(), pa.float64())
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                found = [[[counted(a), counted(b)] for a, b in pairs_of(t, own)] for t in texts]
                xs = pa.array([list(chosen(features(t)).items()) for t in texts], kind)
                yield pa.RecordBatch.from_arrays([part.column("y"), xs, pa.array(found, pa.list_(pa.list_(pa.list_(pa.int32()))))], names=["y", "x", "swaps"])

    rows = stage(got.mapInArrow(valued, "y int, x map<int,double>, swaps array<array<array<int>>>"), "toxic-features")
    known = rows.select("y", "x").collect()
    y = np.array([r["y"] for r in known], dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0, terms)
    side = lambda ns: {i: value(k) for i, k in zip(ns[::2], ns[1::2], strict=True)}
    swaps = rows.select(F.explode("swaps").alias("s")).groupBy("s").count().orderBy(F.xxhash64("s"), "s").limit(most_pairs).collect()
    pairs = [(side(r["s"][0]), side(r["s"][1]), float(r["count"])) for r in swaps]
    w, b = fit_weights([r["x"] for r in known], y, pairs, len(index), penalty)
    return Model({x: float(w[i]) for x, i in index.items() if w[i]}, b, len(pairs), terms)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", threshold: float = 0.7, **how) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    weights, bias, *_ = fit(docs, labels, label, text, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = {f[1:]: w for f, w in weights.items() if f[0] == "="}
        starts = [(k, {f[1:]: w for f, w in weights.items() if f[0] == "^" and len(f) == k + 1}) for k in BEGINNINGS]
        for batch in batches:
            logits = np.empty(len(batch))
            for i, t in enumerate(batch.column("text")):
                seen = {w.strip(_EDGE) for w in set((t.as_py() or "").lower().split())}
                x = bias + sum(whole[w] for w in seen & whole.keys())
                for k, known in starts:
                    hits = Counter(w[:k] for w in seen if len(w) > k and w[:k] in known)
                    x += sum(known[p] * value(c) for p, c in hits.items())
                logits[i] = x
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
