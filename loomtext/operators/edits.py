"""Edits of documents as a piece table: inserts, deletes, replacements and moves of any length.

A document under edit is a list of pieces, each a span of its bytes or of an insertion, with the span's fingerprint. An edit
splits at most three pieces and moves no byte; H(AB) = H(A) + x^|A| H(B) composes the fingerprint of the whole, or of any
range, from those of the pieces. The text is built once, at the end. Pieces stand in chunks with a length and a fingerprint
of their own, so an edit and a fingerprint cost about the square root of the number of pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import BASES, LANES, MODULUS, byte_values, hash_blocks, hash_bytes, powers, powers_at, slices

_CHUNK = 32
_LEAF = 256
_NEAR = 1 << 16


def _lanes(data: bytes) -> tuple[int, ...]:
    """Both lanes of a few bytes: by Horner's rule where numpy would take longer."""
    if len(data) > 48:
        return hash_bytes(data, [powers(lane, _LEAF) for lane in range(2)])
    out = []
    for base in BASES:
        h = 0
        for c in reversed(data):
            h = (h * base + c + 1) % MODULUS
        out.append(h)
    return tuple(out)


class Source:
    """Bytes that pieces refer to, with prefix fingerprints: of short ones at every byte, of others at every leaf of 256 bytes."""

    def __init__(self, data: bytes):
        self.data, self.step, self.prefix = data, 1 if len(data) <= _NEAR else _LEAF, [np.zeros(1, np.int64)] * 2
        if len(data) <= 48:
            one, two, a, b = [0], [0], 0, 0
            for c, x, y in zip(data, *_small_powers(), strict=False):
                a, b = (a + (c + 1) * x) % MODULUS, (b + (c + 1) * y) % MODULUS
                one.append(a)
                two.append(b)
            self.prefix = [one, two]
        elif self.step == 1:
            values = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
            self.prefix = [np.append(0, np.cumsum(values * powers(k, _NEAR)[: len(data)] % MODULUS) % MODULUS) for k in range(2)]
        else:
            cuts = np.arange(0, len(data) - _LEAF + 1, _LEAF)
            leaves = hash_blocks(np.frombuffer(data, dtype=np.uint8), np.append(cuts, cuts[-1] + _LEAF))
            self.prefix = [np.append(0, np.cumsum(leaves[k] * powers_at(k, cuts) % MODULUS) % MODULUS) for k in range(2)]

    def upto(self, at: int) -> tuple[int, ...]:
        """The fingerprint of the first `at` bytes: one look-up and, of a long source, the part of one leaf."""
        if self.step == 1:
            return int(self.prefix[0][at]), int(self.prefix[1][at])
        k = min(at // _LEAF, len(self.prefix[0]) - 1)
        rest = _lanes(self.data[k * _LEAF : at])
        return tuple((int(p[k]) + pow(b, k * _LEAF, MODULUS) * r) % MODULUS for p, r, b in zip(self.prefix, rest, BASES, strict=True))


@functools.cache
def _small_powers() -> list[list[int]]:
    return [powers(k, 64).tolist() for k in range(2)]


@functools.cache
def _near_powers() -> list[np.ndarray]:
    """Of both lanes, the base to each of the exponents from -_NEAR to _NEAR."""
    return [powers_at(k, np.arange(-_NEAR, _NEAR + 1) % (MODULUS - 1)) for k in range(2)]


def _shifts(by: int) -> tuple[int, int]:
    """Both lanes' bases to the exponent `by`, which may be negative."""
    if -_NEAR <= by <= _NEAR:
        one, two = _near_powers()
        return one.item(by + _NEAR), two.item(by + _NEAR)
    return pow(BASES[0], by % (MODULUS - 1), MODULUS), pow(BASES[1], by % (MODULUS - 1), MODULUS)


def join_fp(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """(length, lanes) of AB from those of A and B."""
    one, two = _shifts(a[0])
    return (a[0] + b[0], (a[1] + one * b[1]) % MODULUS, (a[2] + two * b[2]) % MODULUS)


class PieceTable:
    """Content as chunks of pieces (source, from, to, fingerprints of the source up to either end)."""

    def __init__(self, data: bytes, fingerprints: bool = True):
        self.fingerprints, self.chunks, self.sizes, self.prints = fingerprints, [], [], []
        self._put(0, self._whole(data))

    def _whole(self, data: bytes) -> list[tuple]:
        if not data:
            return []
        source = Source(data) if self.fingerprints else None
        return [(source, data, 0, len(data), (0, 0), source.upto(len(data)) if source else None)]

    def _put(self, at: int, pieces: list[tuple]) -> None:
        """New chunks at a place among the chunks; their fingerprints are composed when they are asked for."""
        if not pieces:
            return
        if len(pieces) <= _CHUNK:
            self.chunks.insert(at, pieces)
            self.sizes.insert(at, sum([p[3] - p[2] for p in pieces]))
            self.prints.insert(at, None)
            return
        parts = [pieces[i : i + _CHUNK] for i in range(0, len(pieces), _CHUNK)]
        self.chunks[at:at], self.sizes[at:at], self.prints[at:at] = parts, [sum(p[3] - p[2] for p in part) for part in parts], [None] * len(parts)

    def __len__(self) -> int:
        return sum(self.sizes)

    def _split(self, pos: int) -> int:
        """Make a chunk begin at byte pos; its number."""
        at = 0
        while at < len(self.chunks) and pos >= self.sizes[at]:
            pos -= self.sizes[at]
            at += 1
        if not pos:
            return at
        pieces, i = self.chunks[at], 0
        while pos >= pieces[i][3] - pieces[i][2]:
            pos -= pieces[i][3] - pieces[i][2]
            i += 1
        left, right = pieces[:i], pieces[i:]
        if pos:
            source, data, a, b, before, after = pieces[i]
            middle = source.upto(a + pos) if source else None
            left, right[0] = [*left, (source, data, a, a + pos, before, middle)], (source, data, a + pos, b, middle, after)
        del self.chunks[at], self.sizes[at], self.prints[at]
        self._put(at, right)
        self._put(at, left)
        return at + 1

    def _tidy(self) -> None:
        """Few and full chunks again, when many have become small."""
        if len(self.chunks) > 64 and len(self.chunks) > 4 * sum(map(len, self.chunks)) // _CHUNK:
            pieces = [p for c in self.chunks for p in c]
            self.chunks, self.sizes, self.prints = [], [], []
            self._put(0, pieces)

    def edit(self, pos: int, del_len: int, ins: bytes, to: int | None = None) -> None:
        """Cut del_len bytes at pos and put ins there; with `to`, the cut bytes are put back at `to` of what that gives."""
        n = len(self)
        if pos < 0 or del_len < 0 or pos + del_len > n:
            raise ValueError(f"edit of {del_len} bytes at {pos} is outside of a document of {n} bytes")
        if to is not None and not 0 <= to <= n - del_len + len(ins):
            raise ValueError(f"move to {to} is outside of a document of {n - del_len + len(ins)} bytes")
        first = self._split(pos)
        last = self._split(pos + del_len) if del_len else first
        cut = [p for c in self.chunks[first:last] for p in c]
        del self.chunks[first:last], self.sizes[first:last], self.prints[first:last]
        self._put(first, self._whole(ins))
        if to is not None and cut:
            self._put(self._split(to), cut)
        self._tidy()

    def fingerprint(self) -> tuple[int, int, int]:
        """(length, lanes) of the content."""
        out = (0, 0, 0)
        for i, h in enumerate(self.prints):
            if h is None:
                n = f1 = f2 = 0
                for _, _, a, b, (p1, p2), (q1, q2) in self.chunks[i]:
                    one, two = _shifts(n - a)
                    f1, f2, n = (f1 + (q1 - p1) * one) % MODULUS, (f2 + (q2 - p2) * two) % MODULUS, n + b - a
                self.prints[i] = h = (n, f1, f2)
            out = join_fp(out, h)
        return out

    def spans(self) -> list[tuple[bytes, int, int]]:
        """(data, from, to) of the pieces in order."""
        return [p[1:4] for c in self.chunks for p in c]

    def content(self) -> bytes:
        return b"".join(data[a:b] for data, a, b in self.spans())


def _listed(docs: DataFrame, edits: DataFrame, data: str, key: str) -> DataFrame:
    """(key, data, e): each document with its edits in step order."""
    to = F.col("to").cast("long") if "to" in edits.columns else F.lit(None).cast("long")
    each = F.struct(F.col("step").cast("long").alias("step"), F.col("pos").cast("long").alias("pos"), F.col("del_len").cast("long").alias("del_len"), F.col("ins").alias("ins"), to.alias("to"))
    listed = edits.groupBy(key).agg(F.sort_array(F.collect_list(each)).alias("e"))
    return docs.select(key, F.col(data).alias("data")).join(listed, key, "left")


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[tuple]]]:
    """Number, content and edits (step, pos, del_len, ins, to) of each document."""
    data, at = byte_values(batch.column("data"))
    listed = batch.column("e")
    fields = listed.flatten()
    rows = list(zip(*[fields.field(name).to_pylist() for name in ("step", "pos", "del_len", "ins", "to")], strict=True))
    ends = np.cumsum([0, *[n or 0 for n in listed.value_lengths().to_pylist()]]).tolist()
    for i in range(len(batch)):
        yield i, data[at[i] : at[i + 1]].tobytes(), rows[ends[i] : ends[i + 1]]


def edit_apply(docs: DataFrame, edits: DataFrame, data: str = "data", key: str = "doc_id", upto: int | None = None) -> DataFrame:
    """(key, data) after edits(key, step, pos, del_len, ins[, to]) in step order; up to a step, if given.

    Each edit cuts del_len bytes at pos and puts ins there: an insert, a delete, a replacement. With `to` (not null), the cut
    bytes come back at byte `to` of what that gives: a move. Positions are those of the content at that step; one outside of
    it is an error. A null ins is empty, null data too; documents without edits keep theirs.
    """
    rows = _listed(docs, edits if upto is None else edits.filter(F.col("step") <= upto), data, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            out = []
            for _, content, steps in _steps(batch):
                table = PieceTable(content, fingerprints=False)
                for _, pos, cut, ins, to in steps:
                    table.edit(pos, cut, ins or b"", to)
                out.append(table.content())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary())], names=[key, "data"])

    none = rows.filter("e is null").select(key, F.coalesce("data", F.lit(b"")).alias("data"))
    return rows.filter("e is not null").mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, data binary").unionByName(none)


def edit_identity(docs: DataFrame, edits: DataFrame, every: int, data: str = "data", key: str = "doc_id") -> DataFrame:
    """(key, step, n, fp1, fp2) after each `every`-th edit: length and fingerprint of the content, composed from its pieces.

    Edits are those of edit_apply, of any length. Base bytes are hashed once, inserted ones once; an edit hashes at most
    the leaves that it cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            out = []
            for i, content, steps in _steps(batch):
                table = PieceTable(content)
                for k, (step, pos, cut, ins, to) in enumerate(steps, 1):
                    table.edit(pos, cut, ins or b"", to)
                    if k % every == 0:
                        out.append((i, step, *table.fingerprint()))
            which, *rest = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(which, pa.int64())), *[pa.array(c, pa.int64()) for c in rest]], names=[key, "step", "n", *LANES])

    rows = _listed(docs, edits, data, key).filter("e is not null")
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, step long, n long, fp1 long, fp2 long")


def edit_pieces(docs: DataFrame, edits: DataFrame, data: str = "data", key: str = "doc_id") -> DataFrame:
    """(key, base_bytes, kept_bytes, new_bytes, n_pieces) after all edits: how much of the content still refers to the base
    document, how much to insertions, and in how many pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            out = []
            for _, content, steps in _steps(batch):
                table = PieceTable(content, fingerprints=False)
                for _, pos, cut, ins, to in steps:
                    table.edit(pos, cut, ins or b"", to)
                spans = table.spans()
                kept = sum(b - a for s, a, b in spans if s is content)
                out.append((len(content), kept, len(table) - kept, len(spans)))
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]], names=[key, "base_bytes", "kept_bytes", "new_bytes", "n_pieces"])

    rows = _listed(docs, edits, data, key)
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, base_bytes long, kept_bytes long, new_bytes long, n_pieces long")


def snapshot_at(docs: DataFrame, edits: DataFrame, version: int, **how) -> DataFrame:
    """(key, data) as of a version."""
    return edit_apply(docs, edits, upto=version, **how)
