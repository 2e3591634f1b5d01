"""Subword lattice likelihood: a text's probability summed over all its segmentations into pieces.

The pieces are those of an existing vocabulary, whose own scores state each piece's rank; Zipf's law turns ranks into
first weights. The training texts then re-weight the pieces once by their expected counts (a forward and a backward
pass over each distinct training word, weighted by its count), so that the model is of this corpus. A text is drawn
piece by piece; words begin with the vocabulary's word mark, and one end piece closes the text. As no piece spans two words, the text's
log-probability is the sum over its words of the log of the lattice total (forward recursion in log space), plus the
end.

Dataflow: tasks count words and merge counts by word. The table of distinct words, with counts and lattice totals, is
the model. The most frequent words, at most `broadcast_words`, go to every task, which sums them on the spot; a text's
other words join the table by word. So no word is hot in the join, and no table that grows with the corpus is sent
to the driver. The piece table that comes to the driver has the size of the vocabulary.

Null and empty texts have the end only. A null doc_id is never held out. Rows may repeat, each is scored. Extra columns
do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BYTE_SHARE = 1e-4
PRIOR_COUNT = 1000.0


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> log weight from the vocabulary's scores; byte pieces under their names <0x00> and so on."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked, rare = {}, {}
    for i in range(vocabulary.get_piece_size()):
        piece = vocabulary.id_to_piece(i)
        if vocabulary.is_byte(i):
            rare[piece] = math.log(BYTE_SHARE / 256)
        elif not (vocabulary.is_control(i) or vocabulary.is_unknown(i)):
            ranked[piece] = 1.0 / (2.0 - vocabulary.get_score(i))
    total = sum(ranked.values()) / (1 - BYTE_SHARE)
    return {p: math.log(w / total) for p, w in ranked.items()} | rare


class Lattice:
    """All segmentations of a word under piece log-probabilities, for words of any length: sums are kept for the span of
    the longest piece only, and one number for each character where both directions are asked for."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))

    def _spans(self, text: str, i: int) -> Iterator[tuple[int, float, tuple[str, ...]]]:
        """(end, log weight, pieces) of what may stand at i. Characters without a piece are spelt in bytes."""
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            w = self.pieces.get(text[i:j])
            if w is not None:
                yield j, w, (text[i:j],)
            elif j == i + 1:
                spelt = tuple(f"<0x{b:02X}>" for b in text[i].encode())
                yield j, sum(self.pieces[b] for b in spelt), spelt

    @staticmethod
    def _plus(a: float | None, b: float) -> float:
        """Log of the sum of two exponentials."""
        if a is None:
            return b
        top, low = (a, b) if a > b else (b, a)
        return top + math.log1p(math.exp(low - top))

    def _forward(self, text: str) -> Iterator[float]:
        """Log sums over all ways to each place, in turn."""
        ahead: deque[float | None] = deque([0.0] + [None] * self.longest)
        for i in range(len(text)):
            alpha = ahead.popleft()
            ahead.append(None)
            yield alpha
            for j, w, _ in self._spans(text, i):
                ahead[j - i - 1] = self._plus(ahead[j - i - 1], alpha + w)
        yield ahead[0]

    def total(self, word: str) -> float:
        """Log of the sum over all segmentations."""
        return deque(self._forward(MARK + word), maxlen=1)[0]

    def expected(self, word: str, times: float, into: dict[str, float]) -> None:
        """Add the expected number of each piece, over all segmentations, times `times`."""
        text = MARK + word
        alpha, n = array("d", self._forward(text)), len(text)
        beta: deque[float] = deque([0.0], maxlen=self.longest)  # of the places behind i
        for i in range(n - 1, -1, -1):
            here = None
            for j, w, spelt in self._spans(text, i):
                b = w + beta[j - i - 1]
                here = self._plus(here, b)
                share = times * math.exp(alpha[i] + b - alpha[n])
                for p in spelt:
                    into[p] = into.get(p, 0.0) + share
            beta.appendleft(here)


class WordBatch:
    """Lattices of many words at once: spans are looked up by hash, sums run over all words of one length together.

    Gives what Lattice gives; words beyond `longest_word` characters go to Lattice.
    """

    longest_word = 64

    def __init__(self, pieces: dict[str, float]):
        self.lattice, self.names = Lattice(pieces), sorted(p for p in pieces if not p.startswith("<0x"))
        self.span = max(map(len, self.names))
        hashes = np.array([self._hash(p) for p in self.names], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.weights = np.array([pieces[p] for p in self.names])[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.spelt: dict[int, float] = {}

    _BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def _hash(self, piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for ch in piece:
            h = h * self._BASE + np.uint64(ord(ch) + 1)
        return (h * self._MIX)[0]

    def _spell(self, code: int) -> float:
        if code not in self.spelt:
            self.spelt[code] = sum(self.lattice.pieces[f"<0x{b:02X}>"] for b in chr(code).encode())
        return self.spelt[code]

    def _spans(self, codes: np.ndarray):
        """For each length l: (log weights by start, -inf where no piece; place in self.weights, -1 without; spelt)."""
        n, width = codes.shape
        out, h = [], np.zeros((n, width), dtype=np.uint64)
        for k in range(1, min(self.span, width) + 1):
            h = h[:, : width - k + 1] * self._BASE + (codes[:, k - 1 :] + 1).astype(np.uint64)
            key = h * self._MIX
            w, at = np.full(key.shape, -np.inf), np.full(key.shape, -1, dtype=np.int64)
            hit = np.flatnonzero(self.maybe[(key >> np.uint64(42)).astype(np.int64)])
            if len(hit):
                found = key.ravel()[hit]
                place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
                good = self.hashes[place] == found
                w.ravel()[hit[good]], at.ravel()[hit[good]] = self.weights[place[good]], place[good]
            if k == 1:
                lone = at < 0
                if lone.any():
                    chars, back = np.unique(codes[lone], return_inverse=True)
                    w[lone] = np.array([self._spell(int(c)) for c in chars])[back]
            out.append((w, at))
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        """Log of the sum of exponentials across the list."""
        x = np.stack(terms)
        top = x.max(0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(x - safe).sum(0))

    def _forward(self, spans, n: int, width: int) -> np.ndarray:
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0.0
        for j in range(1, width + 1):
            alpha[j] = self._sum([alpha[j - k] + spans[k - 1][0][:, j - k] for k in range(1, min(len(spans), j) + 1)])
        return alpha

    def _by_length(self, words: list[str]):
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for length, members in groups.items():
            step = max(1, 200_000 // (length + 1))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                if length > self.longest_word:
                    yield part, None
                else:
                    text = "".join(MARK + words[i] for i in part)
                    yield part, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64).reshape(len(part), length + 1)

    def totals(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for part, codes in self._by_length(words):
            if codes is None:
                out[part] = [self.lattice.total(words[i]) for i in part]
            else:
                out[part] = self._forward(self._spans(codes), *codes.shape)[-1]
        return out

    def expected(self, words: list[str], times: list[int], into: dict[str, float]) -> None:
        sums, weight = np.zeros(len(self.weights)), np.array(times, dtype=np.float64)
        for part, codes in self._by_length(words):
            if codes is None:
                for i in part:
                    self.lattice.expected(words[i], times[i], into)
                continue
            (n, width), spans = codes.shape, self._spans(codes)
            alpha = self._forward(spans, n, width)
            beta = np.full((width + 1, n), -np.inf)
            beta[width] = 0.0
            for i in range(width - 1, -1, -1):
                beta[i] = self._sum([beta[i + k] + spans[k - 1][0][:, i] for k in range(1, min(len(spans), width - i) + 1)])
            for k, (w, at) in enumerate(spans, 1):
                share = np.exp(alpha[: width - k + 1].T + w + beta[k:].T - alpha[width][:, None]) * weight[part][:, None]
                known = at >= 0
                sums += np.bincount(at[known], share[known], len(sums))
                if k == 1 and not known.all():
                    for c, x in zip(codes[~known].tolist(), share[~known].tolist(), strict=True):
                        for b in chr(c).encode():
                            into[f"<0x{b:02X}>"] = into.get(f"<0x{b:02X}>", 0.0) + x
        for place in np.flatnonzero(sums):
            name = self.names[self.ids[place]]
            into[name] = into.get(name, 0.0) + float(sums[place])


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The batches, joined to at least `least` rows each: short ones leave few words of a length together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, total, c): uses in all texts and in training texts; counted in each task before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(seen[0] | seen[1]) if seen[1] else list(seen[0])
            train, held = [seen[0][k] for k in keys], [seen[1][k] for k in keys]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays([pa.array([k.decode() for k in keys], pa.string()), pa.array(train, pa.int64()), pa.array(held, pa.int64())], names=["word", "train", "held"])

        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                seen[held].update((text.as_py() or "").encode().lower().split())
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield flush()
        if seen[0] or seen[1]:
            yield flush()

    rows = docs.select("text", "held_out").mapInArrow(run, "word string, train long, held long")
    return rows.groupBy("word").agg(F.sum("train").alias("c"), F.sum(F.col("train") + F.col("held")).alias("total"))


def fit_pieces(words: DataFrame, pieces: dict[str, float], n_ends: int) -> tuple[dict[str, float], float]:
    """Re-weighted pieces and the end's log-probability, from the expected counts in words(word, c)."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = WordBatch(shared.value), {}
        for batch in _gathered(batches):
            lattice.expected(batch.column("word").to_pylist(), batch.column("c").to_pylist(), into)
        yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.float64())], names=["piece", "e"])

    got = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece string, e double").groupBy("piece").agg(F.sum("e").alias("e"))
    counts = {r[0]: r[1] for r in got.collect()}  # at most the vocabulary
    total = sum(counts.values()) + PRIOR_COUNT + n_ends + 1.0
    return {p: math.log((counts.get(p, 0.0) + PRIOR_COUNT * math.exp(w)) / total) for p, w in pieces.items()}, math.log((n_ends + 1.0) / total)


def _lattice_totals(words: DataFrame, pieces: dict[str, float]) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = WordBatch(shared.value)
        for batch in _gathered(batches):
            logs = lattice.totals(batch.column("word").to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], names=["word", "c", "total", "lp"])

    return words.select("word", "c", "total").mapInArrow(run, "word string, c long, total long, lp double")


def _frequent(words: DataFrame, most: int) -> dict[bytes, tuple[int, float]]:
    """The words above the lowest power-of-two count that leaves at most `most` of them."""
    bins = sorted(words.groupBy(F.floor(F.log2("total")).alias("b")).count().collect(), reverse=True)  # some 60 rows
    floor, n = None, 0
    for b, k in bins:
        if n + k > most:
            break
        floor, n = b, n + k
    if floor is None:
        return {}
    return {r[0].encode(): (r[1], r[2]) for r in words.filter(F.floor(F.log2("total")) >= floor).select("word", "c", "lp").collect()}


def score(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, fold: int = 5, held: int = 1, broadcast_words: int = 100_000) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", out_of.alias("held_out"), F.col(text).alias("text"))
    words = stage(_word_counts(rows), "word-counts")
    ends = rows.filter(~F.col("held_out")).count()
    sums = words.filter("c > 0").agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = (sums[0] or 0) + ends, sums[1] + (1 if ends else 0)
    pieces, end_log = fit_pieces(words, load_pieces(vocabulary), ends)
    model = stage(_lattice_totals(words, pieces), "words")
    shared = spark.sparkContext.broadcast(_frequent(model, broadcast_words))
    size = n + 0.5 * (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: (c > 0, math.log10((c + 0.5) / size), lp) for w, (c, lp) in shared.value.items()}
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                tokens, hits, base, lattice, rare, times, starts = [], [], [], [], [], [], [0]
                for t in part.column("text"):
                    counts = Counter((t.as_py() or "").encode().lower().split())
                    k, b, s = int(ends > 0), math.log10((ends + 0.5) / size), end_log / math.log(10)
                    for w, c in counts.items():
                        if (got := known.get(w)) is None:
                            rare.append(w.decode())
                            times.append(c)
                        else:
                            k, b, s = k + c * got[0], b + c * got[1], s + c * got[2]
                    tokens.append(sum(counts.values()) + 1)
                    hits.append(k)
                    base.append(b)
                    lattice.append(s)
                    starts.append(len(rare))
                pairs = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int64())], names=["word", "times"]))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), part.column("held_out"), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(lattice, pa.float64()), pairs], names=["rid", "doc_id", "held_out", "n_tokens", "k", "b", "s", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = stage(rows.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, k long, b double, s double, rare array<struct<word:string,times:long>>"), "scored")
    rest = part.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    rest = rest.join(model.select("word", "c", "lp"), "word").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k2"), F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / size)).alias("b2"), F.sum(F.col("times") * F.col("lp")).alias("s2")
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return part.drop("rare").join(rest, "rid", "left").select("doc_id", "held_out", "n_tokens", plus("k", "k2").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("b", "b2").alias("base_score"), plus("s", "s2").alias("score"))
