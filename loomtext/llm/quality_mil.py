"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. Each passage is encoded by its shape (kinds of characters, word
lengths, repetition) and its content (how the log odds of its hashed words between the labels are spread), and embedded;
gated attention, learned from document labels alone, weighs the passages; the score is a logistic function of the
weighted mean embedding. Every passage of every text is encoded and scored.

The model is fitted on at most `most_rows` labelled documents, those with the smallest hashes of their id among the
rows that may be learned from, and on every passage of each. Their features, some 90 bytes a passage, are staged, and the
driver takes them batch by batch, some 8 MB or one document at a time, however long the documents are. Log odds are
counted on Spark, for a bounded number of hashed words, in two halves of the sample: a document is fitted on the odds of
the other half, so that its own label is not in its features.
Scoring is one pass over Arrow batches, a megabyte of text at a time.

Null and empty texts are one empty passage. Rows may repeat, each is scored; in the sample an id counts once, with its
largest label and its smallest text. Extra columns do no harm. Without any labels of both kinds all scores are the share
of label 1 (0.5 if there are none). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import stage

PASSAGE = 64
MOST_ROWS = 5000
BATCHES, EPOCHS = 20, 40
BUCKETS = 1 << 16  # of hashed words

_KINDS = np.full(256, 9, dtype=np.int8)  # bytes by kind; 9: others
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c", b"\n\r", b".,;:", b"!?", b"|", b"#*$%&<>@^~=+_\\/{}[]`")):
    _KINDS[list(_chars)] = _i
_KINDS[128:] = 10
N_SHAPE, N_CONTENT = 18, 5
N_FEATURES = N_SHAPE + N_CONTENT


def passages(texts: pa.Array, odds: np.ndarray | None = None, most_bytes: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of passages, passages of each text) for a few texts at a time. `odds`: log odds of the hashed words."""
    odds = np.zeros(BUCKETS) if odds is None else odds
    for data, bounds in _chunks(texts, most_bytes):
        yield _features(data, bounds, odds)


def _chunks(texts: pa.Array, most_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of a few texts at a time, and where each begins."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.int64)


def _features(data: np.ndarray, bounds: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, counts = shingles.word_hashes(data, bounds)
    per = np.maximum(1, -(-counts // PASSAGE))
    n = int(per.sum())
    text_of = np.repeat(np.arange(len(per)), per)
    first_passage = np.cumsum(per) - per
    word_text = np.repeat(np.arange(len(counts)), counts)
    word_at = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    word_passage = first_passage[word_text] + word_at // PASSAGE
    solid = ~shingles._SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1 : len(data)]
    starts = np.flatnonzero(begins)
    # a passage's bytes run from its first word to the next passage
    cuts = bounds[:-1][text_of].copy()
    inner = word_at % PASSAGE == 0
    inner &= word_at > 0
    cuts[word_passage[inner]] = starts[inner]
    kinds = np.zeros((n, 11))
    kind = _KINDS[data]
    ends = np.append(cuts[1:], len(data))
    for k in range(11):
        run = np.concatenate(([0], np.cumsum(kind == k)))
        kinds[:, k] = run[ends] - run[cuts]
    size = np.maximum(1, ends - cuts)
    n_words = np.bincount(word_passage, minlength=n)
    count = np.maximum(1, n_words)
    lengths = np.diff(np.append(starts, len(data))) if len(starts) else np.zeros(0)
    mean = np.bincount(word_passage, lengths, n) / count
    square = np.bincount(word_passage, lengths.astype(float) ** 2, n) / count
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (word_passage[1:] == word_passage[:-1])
    repeats = np.bincount(word_passage[same], minlength=n) / count
    order = np.lexsort((words, word_passage))
    w, p = words[order], word_passage[order]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(p[new], minlength=n) / count
    capital = np.bincount(word_passage, (data[starts] >= 65) & (data[starts] <= 90), n) / count if len(starts) else np.zeros(n)
    rest = np.stack([np.minimum(mean, 40), np.sqrt(np.minimum(np.maximum(square - mean**2, 0), 900)), repeats, distinct, capital, np.log1p(n_words), np.log1p(per)[text_of]], axis=1)
    return np.concatenate((kinds / size[:, None], rest, _content(odds[_bucket(words)], word_passage, n, count)), axis=1).astype(np.float32), per


def _content(v: np.ndarray, passage: np.ndarray, n: int, count: np.ndarray) -> np.ndarray:
    """Mean, largest and smallest log odds of each passage's words, and the shares beyond 1 and -1."""
    out = np.zeros((n, N_CONTENT))
    if len(v):
        out[:, 0] = np.bincount(passage, v, n) / count
        first = np.flatnonzero(np.diff(passage, prepend=-1))  # words stand passage by passage
        out[passage[first], 1] = np.maximum(np.maximum.reduceat(v, first), 0)
        out[passage[first], 2] = np.minimum(np.minimum.reduceat(v, first), 0)
        out[:, 3], out[:, 4] = np.bincount(passage, v > 1, n) / count, np.bincount(passage, v < -1, n) / count
    return out


class GatedAttention:
    """Gated attention over bags: z = sum a_i tanh(W x_i), a = softmax(w . tanh(V h) * sigmoid(U h)), score = logistic(c . z + c0)."""

    def __init__(self, n_in: int, n_hidden: int = 16, n_gate: int = 8, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": g(n_in, n_hidden), "b": np.zeros(n_hidden), "V": g(n_hidden, n_gate), "U": g(n_hidden, n_gate), "w": g(n_gate), "c": g(n_hidden), "c0": np.zeros(1)}
        self.mean, self.scale = np.zeros(n_in), np.ones(n_in)

    def forward(self, x: np.ndarray, per: np.ndarray) -> dict:
        p, starts, bag = self.p, np.cumsum(per) - per, np.repeat(np.arange(len(per)), per)
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "starts": starts, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))}

    def gradient(self, x: np.ndarray, per: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by all parameters."""
        p, f = self.p, self.forward(x, per)
        d = (f["y"] - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (f["h"] * dz[f["bag"]]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[f["bag"]])
        g = {"c": f["z"].T @ d, "c0": d.sum(keepdims=True), "w": (f["t"] * f["s"]).T @ de}
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["b"] = f["x"].T @ dh, dh.sum(0)
        return g

    def fit(self, x: np.ndarray, per: np.ndarray, y: np.ndarray, epochs: int = 300, **how) -> None:
        self.fit_batches(lambda: iter([(x, per, y)]), epochs, **how)

    def fit_batches(self, batches: Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], epochs: int, rate: float = 0.02, decay: float = 1e-4) -> None:
        """batches() gives the batches (x, per, y) of all documents; each epoch takes one step for each of them."""
        n, total, square = 0, 0.0, 0.0
        for x, _, _ in batches():
            n, total, square = n + len(x), total + x.sum(0, dtype=np.float64), square + np.square(x, dtype=np.float64).sum(0)
        self.mean = total / n
        self.scale = np.sqrt(np.maximum(square / n - self.mean**2, 0)) + 1e-3
        p, m, v, step = self.p, {}, {}, 0
        for _ in range(epochs):
            for batch in batches():
                step, g = step + 1, self.gradient(*batch)
                for k in p:
                    g[k] = g[k] + decay * p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g[k] ** 2
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), per)["y"]


def held_out(fold: int = 3, held: int = 1):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, text: str, most_rows: int) -> DataFrame:
    """(text, y, half) of at most most_rows labelled documents outside the held-out fold; half is 0 or 1 by a hash of the id."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # a top-k in each task, then of all
    met = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half"))


def log_odds(rows: DataFrame) -> list[np.ndarray]:
    """For rows(text, y, half): log odds of the hashed words between the labels in half 0, half 1, and both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.zeros((4, BUCKETS + 1), dtype=np.int64)  # half and label; the last column counts documents
        for batch in batches:
            kinds, at = (2 * batch.column("half").to_numpy() + batch.column("y").to_numpy()).tolist(), 0
            for data, bounds in _chunks(batch.column("text"), 1 << 20):
                words, counts = shingles.word_hashes(data, bounds)
                ends = np.cumsum(counts)
                for e, c in zip(ends.tolist(), counts.tolist(), strict=True):
                    k[kinds[at], np.unique(_bucket(words[e - c : e]))] += 1
                    k[kinds[at], BUCKETS] += 1
                    at += 1
        where = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(k.ravel()[where])], names=["at", "k"])

    got = rows.select("text", "y", "half").mapInArrow(run, "at long, k long").groupBy("at").agg(F.sum("k").alias("k")).toArrow()  # at most 4 BUCKETS rows
    k = np.zeros(4 * (BUCKETS + 1))
    k[got.column("at").to_numpy()] = got.column("k").to_numpy()
    k = k.reshape(2, 2, BUCKETS + 1)
    out = []
    for c in (k[0], k[1], k.sum(0)):
        share = (c[:, :BUCKETS] + 1) / (c[:, BUCKETS:] + 2)
        seen = c[:, :BUCKETS].sum(0) > 0
        out.append(np.where(seen, np.clip(np.log(share[1] / share[0]), -4, 4), 0.0))
    return out


def batches_of(features: DataFrame, size: int, most_bytes: int = 8 << 20, held_bytes: int = 64 << 20) -> Callable[[], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """All rows of the staged features(x, y), in the order of a hash, as batches (x, per, y) of `size` documents, or of
    fewer where those have more than most_bytes of features. They are read again for each epoch, one partition at a time;
    those of a table of at most held_bytes are the same batches, kept."""
    ordered = features.orderBy(F.xxhash64("x", "y"), "x", "y")

    def packed(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bags = [np.frombuffer(bytes(r["x"]), dtype=np.float32).reshape(-1, N_FEATURES) for r in rows]
        return np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r["y"] for r in rows], dtype=float)

    def read() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows, width = [], 0
        for r in ordered.toLocalIterator():
            if rows and (len(rows) == size or width + len(r["x"]) > most_bytes):
                yield packed(rows)
                rows, width = [], 0
            rows.append(r)
            width += len(r["x"])
        if rows:
            yield packed(rows)

    if (features.agg(F.sum(F.octet_length("x"))).first()[0] or 0) > held_bytes:
        return read
    held = list(read())
    return lambda: iter(held)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", most_rows: int = MOST_ROWS) -> tuple[GatedAttention | None, np.ndarray, float]:
    """The model, the words' log odds, and the share of label 1; no model without both labels."""
    rows = stage(sample(docs, labels, label, text, most_rows), "quality-sample")
    kinds = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(kinds) < 2:
        return None, np.zeros(BUCKETS), float(next(iter(kinds), 0.5))
    odds = log_odds(rows)
    shared = docs.sparkSession.sparkContext.broadcast(odds[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in (0, 1):
                part, bags = batch.filter(pa.array(batch.column("half").to_numpy() == half)), []
                for x, per in passages(part.column("text"), shared.value[1 - half]):
                    for e, k in zip(np.cumsum(per).tolist(), per.tolist(), strict=True):
                        bags.append(x[e - k : e].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), part.column("y")], names=["x", "y"])

    features = stage(rows.mapInArrow(run, "x binary, y int"), "quality-features")
    model, n = GatedAttention(N_FEATURES), sum(kinds.values())
    model.fit_batches(batches_of(features, -(-n // BATCHES)), EPOCHS)
    return model, odds[2], kinds[1] / n


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    model, odds, share = fit(docs, labels, label, text, most_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model, odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, odds = shared.value
        for batch in batches:
            got = [model.score(x, per) if model else np.full(len(per), share) for x, per in passages(batch.column("text"), odds)]
            scores = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
