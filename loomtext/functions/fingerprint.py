"""Polynomial fingerprints modulo 2^31 - 1 in two lanes.

H(s) = sum of (byte_i + 1) * x^i, from the left, so that prefixes are running sums, an append is H(A) + x^|A| H(B),
and q copies are H(S) * (1 + x^n + ... + x^((q-1) n)). Products of two residues fit a long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import let

MODULUS = (1 << 31) - 1
BASES = (131, 137)
LANES = ("fp1", "fp2")


def power(exponent: Column, base: int, bits: int = 40) -> Column:
    """base^exponent mod MODULUS for exponents below 2^bits: one look-up in a constant table for each byte of the exponent."""
    out = None
    for k in range(0, bits, 8):
        table = F.expr("array(" + ",".join(f"{pow(base, d << k, MODULUS)}L" for d in range(256)) + ")")
        digit = F.shiftright(exponent.cast("long"), k).bitwiseAND(F.lit(255)).cast("int") + 1
        factor = F.element_at(table, digit)
        out = factor if out is None else (out * factor) % MODULUS
    return out


@functools.cache
def powers(lane: int, n: int) -> np.ndarray:
    """The first n powers of a lane's base."""
    out = np.ones(n, dtype=np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(BASES[lane], done, MODULUS) % MODULUS
        done += more
    return out


@functools.cache
def _digit_powers(lane: int, k: int) -> np.ndarray:
    """The lane's base to d * 2^k for each byte d."""
    return np.array([pow(BASES[lane], d << k, MODULUS) for d in range(256)], dtype=np.int64)


def powers_at(lane: int, exponents: np.ndarray) -> np.ndarray:
    """The lane's base to each of the exponents, by a table for each byte of them."""
    out, k = np.ones(len(exponents), dtype=np.int64), 0
    while len(exponents) and (int(exponents.max()) >> k):
        out = out * _digit_powers(lane, k)[(exponents >> k) & 255] % MODULUS
        k += 8
    return out


def hash_bytes(data: bytes, tables: list[np.ndarray]) -> tuple[int, int]:
    values = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    return tuple(int((values * t[: len(values)] % MODULUS).sum() % MODULUS) for t in tables)


def byte_values(blocks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings or binaries, and where each begins and the last ends; nulls are empty."""
    text = pa.types.is_string(blocks.type) or pa.types.is_large_string(blocks.type)
    blocks = blocks.cast(pa.large_string() if text else pa.large_binary())
    if blocks.null_count:
        blocks = blocks.fill_null("" if text else b"")
    offsets = np.frombuffer(blocks.buffers()[1], dtype=np.int64)[blocks.offset : blocks.offset + len(blocks) + 1] if len(blocks) else np.zeros(1, np.int64)
    data = np.frombuffer(blocks.buffers()[2], dtype=np.uint8) if len(blocks) and blocks.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 256, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and bytes of a column: a task holds what it makes of one slice."""
    for batch in batches:
        ends = byte_values(batch.column(column))[1] if len(batch) else [0]
        at = 0
        while at < len(batch):
            to = max(at + 1, min(at + most, int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def hash_blocks(data: np.ndarray, offsets: np.ndarray, most_bytes: int = 1 << 20) -> np.ndarray:
    """Both lanes of all blocks, a megabyte of them at a time."""
    out, i = np.zeros((2, len(offsets) - 1), dtype=np.int64), 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        sizes, starts = np.diff(offsets[i : j + 1]), offsets[i:j] - offsets[i]
        place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        values, full = data[offsets[i] : offsets[j]].astype(np.int64) + 1, np.flatnonzero(sizes)
        for k in range(2):
            if len(full):
                terms = values * powers(k, int(sizes.max()))[place] % MODULUS
                out[k, i + full] = np.add.reduceat(terms, starts[full]) % MODULUS
        i = j
    return out


def leaf_hash(leaf: Column) -> Column:
    """struct<fp1, fp2> of a block, a batch of blocks at a time."""

    @F.arrow_udf("fp1 long, fp2 long")
    def of(blocks: pa.Array) -> pa.Array:
        h = hash_blocks(*byte_values(blocks))
        return pa.StructArray.from_arrays([pa.array(h[0]), pa.array(h[1])], names=list(LANES))

    return of(leaf)


def geometric(q: Column, ratio: Column, bits: int = 32) -> Column:
    """1 + r + ... + r^(q-1) mod MODULUS by doubling over the bits of q, high to low; 0 for q = 0."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("p"))
    fold = lambda x: F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), zero, lambda acc, k: _double(acc, x["q"], x["r"], k))["s"]
    return let(F.struct(q.alias("q"), ratio.alias("r")), fold)


def _double(acc: Column, q: Column, ratio: Column, k: Column) -> Column:
    twice = F.struct((acc["s"] * (1 + acc["p"]) % MODULUS).alias("s"), (acc["p"] * acc["p"] % MODULUS).alias("p"))
    bit = (F.floor(q / F.pow(F.lit(2.0), k)).cast("long") % 2) == 1
    plus = F.struct((F.lit(1) + ratio * (acc["s"] * (1 + acc["p"]) % MODULUS)) % MODULUS, ratio * (acc["p"] * acc["p"] % MODULUS) % MODULUS)
    return F.when(bit, F.struct(plus["col1"].alias("s"), plus["col2"].alias("p"))).otherwise(twice)
