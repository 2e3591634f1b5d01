"""Periodic runs of words, found with a suffix automaton whose suffix links are kept in a link-cut forest.

Each appended word gives the automaton a new longest state; the path from it to the root holds all suffixes of the text
so far. That path is a sequence of segments, each of suffixes that last ended at one and the same place before; access()
walks over them and recolours them as one. Where the longest suffix of a segment has length L and ended q words earlier,
the last L + q words have period q, and the word before them breaks it; with L >= q their end is a square. The run that
the squares of one period and one beginning extend to is thus known without another look at the words.

A run of at least `exponent` periods lies inside a stretch of words in which each three in a row come back `exponent` - 1
times, so automata are built for such stretches alone (found by sorting hashes of whole batches); stretches go on being
cut until nothing is left to cut. That decides nothing: words in a stretch are compared as they are, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import byte_values
from .common import let, n_words, text_or_empty, words
from .shingles import _PLACES, _stir, word_hashes

EXPONENT, LENGTH = 4, 6
_GRAM = 3
_SALT = np.uint64(0x9E3779B97F4A7C15)


class _Paths:
    """The suffix-link tree as paths in splay trees ordered by depth; a path's colour stands at its tree's root."""

    def __init__(self):
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def add(self, above: int) -> None:
        """A new node below `above`, a path of its own."""
        self.left.append(0)
        self.right.append(0)
        self.up.append(above)
        self.colour.append(-1)

    def insert_above(self, node: int, new: int) -> None:
        """`new` (added before) becomes the parent of node, on the same path."""
        self.splay(node)
        high = self.left[node]
        self.left[new], self.left[node], self.up[new] = high, new, node
        if high:
            self.up[high] = new

    def splay(self, x: int) -> None:
        left, right, up, colour = self.left, self.right, self.up, self.colour
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            for v in ((y if (left[z] == y) == (left[y] == x) else x), x) if inner else (x,):
                y = up[v]
                z = up[y]
                if z and left[z] == y:
                    left[z] = v
                elif z and right[z] == y:
                    right[z] = v
                else:
                    colour[v] = colour[y]
                if left[y] == v:
                    b = right[v]
                    left[y], right[v] = b, y
                else:
                    b = left[v]
                    right[y], left[v] = b, y
                if b:
                    up[b] = y
                up[y], up[v] = v, z

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Make the path from node to the root one of the given colour; (deepest node, colour) of each segment that it had."""
        right, up, colours = self.right, self.up, self.colour
        x, below = node, 0
        while x:
            self.splay(x)
            if below:
                yield x, colours[x]
            if right[x]:
                colours[right[x]] = colours[x]
            right[x], below, x = below, x, up[x]
        colours[below] = colour


def runs_in(sequence: list, exponent: int = EXPONENT, length: int = LENGTH) -> dict[tuple[int, int], int]:
    """{(start, period): end} of all maximal runs with length >= max(length, exponent * period); values need to be hashable."""
    step, link, size, paths = [{}, {}], [0, 0], [-1, 0], _Paths()  # 0 is none, 1 the empty suffix
    last, found = 1, {}
    for i, w in enumerate(sequence):
        new, p = len(size), last
        size.append(size[last] + 1)
        step.append({})
        while p and w not in step[p]:
            step[p][w] = new
            p = link[p]
        q = step[p][w] if p else 1
        if p and size[q] != size[p] + 1:
            clone = new + 1
            link.append(clone)
            paths.add(clone)
            size.append(size[p] + 1)
            step.append(step[q].copy())
            link.append(link[q])
            paths.add(0)
            paths.insert_above(q, clone)
            link[q] = clone
            while p and step[p].get(w) == q:
                step[p][w] = clone
                p = link[p]
        else:
            link.append(q)
            paths.add(q)
        for node, end in paths.access(new, i):
            back, long = i - end, size[node]
            if end >= 0 and long >= (exponent - 1) * back and long + back >= length:
                found[i + 1 - back - long, back] = i + 1
        last = new
    return found


def _often(keys: np.ndarray, times: int) -> np.ndarray:
    """Which of the keys occur at least so many times."""
    if len(keys) < times:
        return np.zeros(len(keys), dtype=bool)
    ordered = np.sort(keys)
    values = ordered[times - 1 :][ordered[times - 1 :] == ordered[: len(ordered) - times + 1]]
    return np.isin(keys, values) if len(values) else np.zeros(len(keys), dtype=bool)


def stretches(hashes: np.ndarray, counts: np.ndarray, exponent: int, length: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches that can hold a run, for the hashed words of several texts in a row."""
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    at = np.flatnonzero(text[: 1 - _GRAM] == text[_GRAM - 1 :]) if len(text) >= _GRAM else np.zeros(0, np.int64)
    grams = _stir(sum(hashes[at + k] * _PLACES[k] for k in range(_GRAM)))
    label = text[at]
    while len(at):
        keep = _often(grams + label.astype(np.uint64) * _SALT, exponent - 1)
        at, grams, label = at[keep], grams[keep], label[keep]
        if not len(at):
            break
        label = np.cumsum(np.diff(at, prepend=-2) != 1)  # never over two texts: the last words of a text begin no gram
        sizes = np.bincount(label)
        wide = sizes[label] + _GRAM - 1 >= length
        if keep.all() and wide.all():
            break
        at, grams, label = at[wide], grams[wide], label[wide]
    edges = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    firsts, lasts = at[edges], at[np.append(edges[1:], len(at)) - 1] if len(at) else at
    return [(int(text[a]), int(a - starts[text[a]]), int(b - starts[text[a]]) + _GRAM) for a, b in zip(firsts, lasts, strict=True)]


def _found(texts: list[bytes], exponent: int, length: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs as (start, length, period), collapsed text) of each text."""
    bounds = np.cumsum([0, *map(len, texts)])
    hashes, counts = word_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    split: dict[int, list[bytes]] = {}
    for i, a, b in stretches(hashes, counts, exponent, length) if len(hashes) else ():
        held = split[i] = split.get(i) or texts[i].split()
        ids: dict[bytes, int] = {}
        got = runs_in([ids.setdefault(w, len(ids)) for w in held[a:b]], exponent, length)
        runs.setdefault(i, []).extend((a + s, e - s, q) for (s, q), e in got.items())
    for i, t in enumerate(texts):
        held = split.get(i) or t.split()
        if i in runs:
            fall = np.zeros(len(held) + 1, dtype=np.int64)
            for s, n, q in runs[i]:
                fall[s + q] += 1
                fall[s + n] -= 1
            kept = np.cumsum(fall)[:-1] == 0
            held = [w for w, k in zip(held, kept.tolist(), strict=True) if k]
        yield sorted((s, q, n) for s, n, q in runs.get(i, ())), b" ".join(held)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, length: int = LENGTH, most_bytes: int = 1 << 20) -> DataFrame:
    """(key, runs, collapsed) for each row of docs: runs is array<struct<start, length, period>> by start, then period,
    counted in words; collapsed is the text without the words that a run repeats, joined by single spaces.

    A run is a stretch of words with smallest period q and length >= max(`length`, `exponent` * q) that no neighbouring
    word extends. Words are the maximal runs of other than space and \\t..\\r. Null and empty texts have no run and
    collapse to nothing; equal rows and null keys have rows of their own; other columns of docs take no part. A text is
    read in its own row, whatever its length, at a few hundred bytes for each word inside a stretch. Narrow: no shuffle.
    """
    if exponent < 3 or length <= exponent:
        raise ValueError("exponent must be 3 or more, and length above it")
    kind = docs.schema[key].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_values(batch.column(1))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
                got = list(_found([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)], exponent, length))
                runs = pa.array([[{"start": s, "length": n, "period": q} for s, q, n in r] for r, _ in got], pa.list_(struct))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), runs, pa.array([c for _, c in got], pa.binary()).cast(pa.string())], names=[key, "runs", "collapsed"])
                i = j

    return docs.select(key, text_or_empty(F.col(text)).alias("text")).mapInArrow(run, f"`{key}` {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first by start, then period; null without a run."""
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, nothing, lambda acc, r: F.when(acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"]), r).otherwise(acc))


def planted(key: Column, text: Column) -> Column:
    """The text, for one in ten keys with a tail that repeats itself: with h the unsigned crc32 of the decimal key, g = h div 10
    and n words, if h % 10 = 0 and n > 0 every word i >= a becomes the original word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def tail(x):
        n = F.size(x["w"])
        a = (x["g"] % n).cast("int")
        return let(F.struct(x["w"].alias("w"), n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + x["g"] % 8))).cast("int").alias("p")), repeated)

    def repeated(x):
        return F.array_join(F.transform(x["w"], lambda w, i: F.when(i >= x["a"], F.get(x["w"], x["a"] + (i - x["a"]) % x["p"])).otherwise(w)), " ")

    changed = let(F.struct(words(text).alias("w"), g.alias("g")), tail)
    return F.when((h % 10 == 0) & (n_words(text) > 0), changed).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli (null without a run), runs_sha256 over
    every run's `start,length,period` and a line feed, collapsed_sha256; of the planted texts."""
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
