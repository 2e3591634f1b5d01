"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a few bits by covering anchors.

Anchors are the words of a code made of blocks: two binary Golay codes (23 bits, every word within 3 bits of exactly one
code word), a Hamming code (15 bits, within 1), and three bits that all anchors leave open; 2^35 anchors. Each fingerprint
lies within the covering radius of its home anchor in every block. It is replicated to all anchors that it reaches with
the threshold added to the radii, so one of two fingerprints within the threshold is always replicated to the other's home,
and each anchor compares the fingerprints at home there with its replicas. The replicas of a fingerprint (some 150 for 2
bits) do not depend on the data, nor does anything here on what near copies there are.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import byte_values
from .common import join_checked, stage, text_or_empty
from .components import components

K, BITS, SEED = 3, 2, 42

#: Fixed values, the generators of the perfect codes: (first bit, length, generator polynomial, covering radius).
BLOCKS = ((0, 23, 0b110001110101, 3), (23, 23, 0b110001110101, 3), (46, 15, 0b10011, 1))


def simhash(data: bytes, k: int = K, seed: int = SEED, most: int = 1 << 16) -> int:
    """The fingerprint of the text: bit b is 1 if it is set in over half of the XXH64 values of all k-word shingles."""
    words = data.lower().split()  # of bytes: A-Z, and the six white spaces of the contracts
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: max(1, len(words) - k + 1)], ends[min(k, len(words)) - 1 :]
    of, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), most):
        h = np.array([of(joined[a:b], seed) for a, b in zip(starts[i : i + most].tolist(), ends[i : i + most].tolist(), strict=True)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a signed long; 0 without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_values(batch.column(1))
            got = np.array([simhash(data[a:b].tobytes(), k) for a, b in itertools.pairwise(at.tolist())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text_or_empty(F.col(text)).alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def remainders(words: np.ndarray, size: int, generator: int) -> np.ndarray:
    """Words of `size` bits modulo the generator: the syndrome, the same for all words at the same offset from the code."""
    degree, out = generator.bit_length() - 1, words.copy()
    for bit in range(size - 1, degree - 1, -1):
        out = np.where((out >> bit) & 1, out ^ (generator << (bit - degree)), out)
    return out


@functools.cache
def offsets(size: int, generator: int, radius: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of bits beyond the radius, 0 to `bits`: (begins, patterns); the words of weight radius + that number
    (at most the radius, for 0) with syndrome s are patterns[begins[s]:begins[s + 1]]."""
    out = []
    for extra in range(bits + 1):
        weights = range(radius + 1) if extra == 0 else [radius + extra]
        words = np.array([sum(1 << b for b in c) for w in weights for c in itertools.combinations(range(size), w)], dtype=np.int64)
        s = remainders(words, size, generator)
        counts = np.bincount(s, minlength=1 << (generator.bit_length() - 1))
        out.append((np.append(0, np.cumsum(counts)), words[np.argsort(s, kind="stable")]))
    return out


def anchors(fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(which fingerprint, anchor, is it at home there?) for every anchor within the covering radii and `bits` more."""
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size, _, _ in BLOCKS]
    syndromes = [remainders(p, size, g) for p, (_, size, g, _) in zip(parts, BLOCKS, strict=True)]
    for extras in itertools.product(range(bits + 1), repeat=len(BLOCKS)):
        if sum(extras) > bits:
            continue
        which, anchor = np.arange(len(fp)), np.zeros(len(fp), dtype=np.int64)
        for part, s, extra, (_, size, g, radius) in zip(parts, syndromes, extras, BLOCKS, strict=True):
            begins, patterns = offsets(size, g, radius, bits)[extra]
            first, count = begins[s[which]], begins[s[which] + 1] - begins[s[which]]
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            which, anchor = np.repeat(which, count), np.repeat(anchor, count)
            degree = g.bit_length() - 1
            anchor = (anchor << (size - degree)) | ((part[which] ^ patterns[place]) >> degree)
        yield which, anchor, not any(extras)


def covered(fps: DataFrame, bits: int = BITS, most: int = 4096) -> DataFrame:
    """fps(fp) -> (anchor, fp, home): each fingerprint at its home anchor and at all others in reach. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for i in range(0, len(fp), most):
                some = fp[i : i + most]
                for which, anchor, home in anchors(some.view(np.uint64), bits):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(some[which]), pa.array(np.full(len(which), home))], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def near_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Distinct fingerprints fps(fp) -> links (a, b), a < b, of all that differ in 1 to `bits` bits; each link once.

    A pair meets at a's home: home anchors are unique, and b comes to each anchor once.
    """
    at = covered(fps, bits)
    home = covered(fps, 0).select("anchor", F.col("fp").alias("a"))
    apart = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    there = at.select(F.col("anchor").alias("there"), F.col("fp").alias("b")).hint("merge")  # never broadcast: the planner cannot know how many replicas there are
    return home.join(there, (F.col("anchor") == F.col("there")) & apart).select("a", "b")


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, bits: int = BITS) -> DataFrame:
    """(key, fingerprint, component_id) for each row of docs: fingerprint as 16 hex digits; component_id is the smallest key
    among the rows that links of `bits` or fewer differing bits reach, itself included.

    Rows are first reduced to distinct fingerprints, so exact copies cost one row. Null and empty texts and those without
    words have fingerprint 0 and are linked like others; texts of fewer than k words are one shingle. Null keys are never a
    component_id but where all rows of a component have none; repeated keys and rows have rows of their own; other columns
    take no part. An empty table gives no rows.
    """
    rows = stage(fingerprints(docs, key, text, k), "fingerprints")
    groups = stage(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = stage(components(stage(near_links(groups, bits), "near")).select(F.col("node").alias("fp"), "root"), "roots")
    placed = join_checked(groups, roots, ["fp"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # of single rows without a link the component is the key; the others' classes are looked up
    several = stage(placed.join(least, "root").filter("n > 1 or component_id <> least").select("fp", "component_id", "n"), "classes")
    # hot fingerprints, 256 at most, are told by broadcast, so no key of the shuffled join holds more than 1/256 of the rows
    limit = rows.count() / 256
    hot = several.filter(F.col("n") > limit).select("fp", F.col("component_id").alias("_hot"), F.lit(True).alias("_is_hot"))
    told = rows.join(F.broadcast(hot), "fp", "left")
    cold = join_checked(told.filter("_is_hot is null").drop("_hot", "_is_hot"), stage(several.filter(F.col("n") <= limit).withColumn("_known", F.lit(True)).drop("n"), "cold"), ["fp"], "left")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    own = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col(key))
    return told.filter("_is_hot").select(key, hexed, F.col("_hot").alias("component_id")).unionByName(cold.select(key, hexed, own.alias("component_id")))
