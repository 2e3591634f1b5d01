"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

Distinct conversations are sorted into range partitions. In each, the edges between neighbours are taken in descending
depth of their common prefix: an edge joins two components, and where no node stands at its depth yet, it makes a branching
one. What lies on the paths to a partition's first or last conversation may go on in the partitions beside it and stays
open; all other nodes are complete. A partition's forest is contracted to these two paths, with the sums of what hangs on
them; one further round of the same procedure over the contracted forests merges them across the boundaries.

Turns are compared by 128-bit digests. A conversation travels as its digests and byte lengths (20 bytes a turn), never as
texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, stage

_DIGEST = 16
#: What a place in the trie gathers: members, their smallest id, childless nodes, saved bytes and children below, ends.
_WEIGHT = "depth:long,n:long,conv:long,leaves:long,saved:long,children:long,ends:string"
_SPINE = f"part int, side int, key binary, sizes array<long>, weights array<struct<{_WEIGHT}>>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A node whose parent is open names the parent's place: partition, side (0: first path, 1: last path), and depth below zero for none.
_REF = "ref_part int, ref_side int, ref_depth long"


def common_turns(a: bytes, b: bytes) -> int:
    """The number of whole digests at the beginning that two keys share."""
    n = min(len(a), len(b)) // _DIGEST
    if n < 16:
        return next((i for i in range(n) if a[i * _DIGEST : (i + 1) * _DIGEST] != b[i * _DIGEST : (i + 1) * _DIGEST]), n)
    x, y = (np.frombuffer(k, dtype="<u8", count=2 * n).reshape(-1, 2) for k in (a, b))
    differs = (x != y).any(1)
    return int(differs.argmax()) if differs.any() else n


class Forest:
    """The compact trie over sorted keys: a node for each key and each depth at which neighbours part.

    parent[x] of equal depth means that x and its parent are one node found from two sides.
    """

    def __init__(self, keys: list[bytes]):
        self.depth = [len(k) // _DIGEST for k in keys]
        self.parent, self.below = [-1] * len(keys), list(range(len(keys)))  # below: a key on whose path the node lies
        component, top = list(range(len(keys))), list(range(len(keys)))
        shared = [common_turns(a, b) for a, b in zip(keys, keys[1:], strict=False)]

        def find(x: int) -> int:
            while component[x] != x:
                component[x] = x = component[component[x]]
            return x

        self.merged: list[int] = []
        for edge in sorted(range(len(shared)), key=lambda e: -shared[e]):
            a, b, d = find(edge), find(edge + 1), shared[edge]
            x, y = top[a], top[b]
            if self.depth[x] == d:
                self.parent[y] = x
                if self.depth[y] == d:
                    self.merged.append(y)
            elif self.depth[y] == d:
                self.parent[x] = x = y
            else:
                self.parent[x] = self.parent[y] = x = self._new(d, edge)
            component[b], top[a] = a, x
        self.root = top[find(0)]
        if self.depth[self.root]:
            self.parent[self.root] = self._new(0, 0)
            self.root = self.parent[self.root]

    def _new(self, depth: int, key: int) -> int:
        self.depth.append(depth)
        self.parent.append(-1)
        self.below.append(key)
        return len(self.depth) - 1

    def real(self, x: int) -> int:
        while self.parent[x] >= 0 and self.depth[self.parent[x]] == self.depth[x]:
            x = self.parent[x]
        return x

    def path(self, key: int) -> list[int]:
        """The nodes from a key's own to the root."""
        x, out = self.real(key), []
        while x >= 0:
            out.append(x)
            x = self.real(self.parent[x]) if self.parent[x] >= 0 else -1
        return out

    def upwards(self) -> list[int]:
        """All nodes but the root, deepest first; a merged one before what it was merged into."""
        order = {x: i for i, x in enumerate(self.merged)}
        return sorted((x for x in range(len(self.depth)) if x != self.root), key=lambda x: (-self.depth[x], order.get(x, len(order))))


def fold(keys: list[bytes], sizes: list, weights: list[tuple], keep_open: bool):
    """One round: sorted keys with byte sizes and weights (n, conv, leaves, saved, children, ends) -> (nodes, spines, least).

    nodes are rows of _NODE with the compact parent of those whose parent is open, else None; spines are (side, key number,
    weights by depth) of the two open paths, none without keep_open; least(k) is the smallest id at the node of key k.
    """
    f = Forest(keys)
    paths = [f.path(0), f.path(len(keys) - 1)] if keep_open else []
    side = {x: s for s in (1, 0) for x in (paths[s] if keep_open else ())}
    blank = (0, None, 0, 0, 0, None)
    held = [list(weights[x]) if x < len(keys) else list(blank) for x in range(len(f.depth))]
    totals: dict[int, np.ndarray] = {}

    def span(x: int, a: int, b: int) -> int:
        k = f.below[x]
        if k not in totals:
            totals[k] = np.append(0, np.cumsum(np.asarray(sizes[k], dtype=np.int64)))
        return int(totals[k][b] - totals[k][a])

    order = f.upwards()
    for x in order:
        h, p = held[x], f.parent[x]
        same = f.depth[p] == f.depth[x]
        if not same and x in side:
            continue
        q = held[p]
        q[0] += h[0]
        q[1] = h[1] if q[1] is None else q[1] if h[1] is None else min(q[1], h[1])
        if same:
            q[2], q[3], q[4], q[5] = q[2] + h[2], q[3] + h[3], q[4] + h[4], q[5] or h[5]
            continue
        h[2] = h[2] if h[4] else 1
        q[2], q[3], q[4] = q[2] + h[2], q[3] + h[3] + (h[0] - 1) * span(x, f.depth[p], f.depth[x]), q[4] + 1

    def nodes():
        for x in [*order, f.root]:
            if x in side or (x != f.root and f.depth[f.parent[x]] == f.depth[x]):
                continue
            n, conv, leaves, saved, children, ends = held[x]
            if x == f.root:
                yield (conv, 0, None, n, children, leaves if children else 1, saved, ends), None
                continue
            p = f.real(f.parent[x])
            for d in range(f.depth[x], f.depth[p], -1):
                saved += (n - 1) * span(x, d - 1, d)
                first = d - 1 == f.depth[p]
                above = (None if p in side else held[p][1]) if first else conv
                yield (conv, d, above, n, children, leaves, saved, ends), (side[p], f.depth[p]) if first and p in side else None
                children, ends = 1, None

    spines = [(s, k, [(f.depth[x], *held[x]) for x in paths[s] if side[x] == s]) for s, k in ((0, 0), (1, len(keys) - 1)) if keep_open and not (s and len(keys) == 1)]
    return nodes(), spines, lambda k: held[f.real(k)][1]


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_WEIGHT_TYPE = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("children", pa.int64()), ("ends", pa.string())])
_NODE_TYPES = [*[(x.split()[0], pa.string() if "string" in x else pa.int64()) for x in _NODE.split(", ")], ("ref_part", pa.int32()), ("ref_side", pa.int32()), ("ref_depth", pa.int64())]
_SPINE_TYPES = [("part", pa.int32()), ("side", pa.int32()), ("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("weights", pa.list_(_WEIGHT_TYPE))]


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[list]:
    """The named columns of all batches of a task; digests as bytes, sizes as arrays."""
    out: list[list] = [[] for _ in names]
    for batch in batches:
        for held, name in zip(out, names, strict=True):
            c = batch.column(name)
            held.extend([x.values.to_numpy() for x in c] if name == "sizes" else c.to_pylist())
    return out


def _in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct conversations of a partition -> its complete nodes, and its contracted forest as two spines."""
    keys, sizes, n, conv, ends = _columns(batches, ["key", "sizes", "n", "conv", "ends"])
    if not keys:
        return
    part = TaskContext.get().partitionId()
    nodes, spines, _ = fold(keys, sizes, [(a, c, 0, 0, 0, e) for a, c, e in zip(n, conv, ends, strict=True)], True)
    nothing_n, nothing_s = (None,) * len(_NODE_TYPES), (None,) * len(_SPINE_TYPES)
    names = [_WEIGHT_TYPE.field(i).name for i in range(_WEIGHT_TYPE.num_fields)]

    def rows():
        for row, ref in nodes:
            yield (*row, *((part, *ref) if ref else (None, None, None)), *nothing_s)
        for side, k, weights in spines:
            yield (*nothing_n, part, side, keys[k], sizes[k].tolist(), [dict(zip(names, w, strict=True)) for w in weights if w[1]])

    yield from _batches(rows(), pa.schema(_NODE_TYPES + _SPINE_TYPES))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All contracted forests -> the nodes of their open paths, and who stands at each place that a partition refers to."""
    part, side, key, sizes, weights = _columns(batches, ["part", "side", "key", "sizes", "weights"])
    items = sorted(((key[i][: w["depth"] * _DIGEST], i, w) for i, ws in enumerate(weights) for w in ws), key=lambda x: x[0])
    if not items:
        return
    names = ("n", "conv", "leaves", "saved", "children", "ends")
    held = [tuple(w[x] for x in names) for _, _, w in items]
    nodes, _, least = fold([k for k, _, _ in items], [sizes[i] for _, i, _ in items], held, False)

    def rows():
        for row, _ in nodes:
            yield (*row, None, None, None)
        for j, (_, i, w) in enumerate(items):
            yield (least(j), *(None,) * 7, part[i], side[i], w["depth"])

    yield from _batches(rows(), pa.schema(_NODE_TYPES))


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, conv_id) sorted by both -> (digest, conv, n, ends) of each digest: ids stream into one SHA-256 each."""
    schema = pa.schema([("digest", pa.binary()), ("conv", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])

    def rows():
        now, first, n, seal = None, None, 0, None
        for batch in batches:
            for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if digest != now:
                    if n:
                        yield now, first, n, seal.hexdigest()
                    now, first, n, seal = digest, conv, 1, hashlib.sha256(str(conv).encode())
                else:
                    n += 1
                    seal.update(b",%d" % conv)
        if n:
            yield now, first, n, seal.hexdigest()

    yield from _batches(rows(), schema)


def numbered(turns: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, i, digest, size): turns from 1 in order of turn (null first; ties
    by role and the digest of the text), each with the digest of role and text and the text's UTF-8 bytes; null role and text are empty. Rows
    without conv_id belong to no conversation and go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"), role.alias("role"), F.md5(text).alias("t"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "t")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("i"), "digest", "size")


def branched(turns: DataFrame) -> DataFrame:
    """numbered turns -> those of every conversation rebuilt as a branch: with h = unsigned crc32 of the decimal conv_id, % 9,
    the first h turns of conversation conv_id - conv_id % 5, then its own after its first h. A conversation left without
    turns has one row with null digest."""
    h = lambda c: (F.crc32(F.col(c).cast("string")) % 9).cast("long")
    own = turns.filter(F.col("i") > h("conv_id")).select("conv_id", F.lit(1).alias("own"), "i", "digest", "size")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_c")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    heads = turns.filter("i <= 8").select(F.col("conv_id").alias("base"), "i", "digest", "size")
    taken = convs.join(heads, "base").filter(F.col("i") <= h("conv_id")).select("conv_id", F.lit(0).alias("own"), "i", "digest", "size")
    none = convs.select("conv_id", F.lit(2).alias("own"), F.lit(0).cast("long").alias("i"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"))
    return own.unionByName(taken).unionByName(none)


def trie(turns: DataFrame) -> DataFrame:
    """turns(conv_id, own, i, digest, size), in order of (own, i), null digests for no turn -> a row for every node of the trie:
    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    No rows give no nodes. Ids of equal conversations stream, sorted, through one task of their digest: one SHA-256 over a
    list cannot be split. All else of a group of copies is one row.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("own", "i", F.hex("digest").alias("d"), "size"))))
    whole = turns.groupBy("conv_id").agg(listed.alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), ""))
    whole = stage(whole.select("conv_id", key.alias("key"), F.transform("t", lambda x: x["size"]).alias("sizes")).withColumn("digest", F.unhex(F.md5("key"))), "conversations")
    groups = whole.select("digest", "conv_id").repartition(parts, "digest").sortWithinPartitions("digest", "conv_id").mapInArrow(_sealed, "digest binary, conv long, n long, ends string")
    distinct = groups.join(whole.select(F.col("conv_id").alias("conv"), "key", "sizes"), "conv")
    dealt = distinct.select("key", "sizes", "n", "conv", "ends").repartitionByRange(parts, "key").sortWithinPartitions("key")
    local = stage(dealt.mapInArrow(_in_partition, f"{_NODE}, {_REF}, {_SPINE}"), "partition-forests")
    spines = local.filter("part is not null").select("part", "side", "key", "sizes", "weights")
    across = stage(spines.repartition(1).mapInArrow(_across, f"{_NODE}, {_REF}"), "across-partitions")
    columns = [x.split()[0] for x in _NODE.split(", ")]
    closed = local.filter("part is null")
    refs = across.filter("ref_part is not null").select("ref_part", "ref_side", "ref_depth", F.col("conv_id").alias("_above"))
    hung = join_checked(closed.filter("ref_part is not null").drop("parent_conv_id"), stage(refs, "open-places"), ["ref_part", "ref_side", "ref_depth"]).withColumnRenamed("_above", "parent_conv_id")
    out = closed.filter("ref_part is null").select(*columns).unionByName(hung.select(*columns)).unionByName(across.filter("ref_part is null").select(*columns))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt as branches (see branched)."""
    return trie(branched(stage(numbered(conversations), "turns")))
