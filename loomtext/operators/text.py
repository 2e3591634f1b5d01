"""Text preparation: boilerplate, pieces, shuffles, provenance, conversations, codecs, parsing of responses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprint import byte_values, slices
from ..functions.tables import global_rank, let


def strip_boilerplate(text: Column, start: str, end: str) -> Column:
    """What stands between the first line that matches `start` and the next that matches `end`, if both exist; trimmed."""
    inner = F.regexp_extract(text, f"(?s){start}[^\\n]*\\n(.*?){end}", 1)
    both = text.rlike(f"(?s){start}[^\\n]*\\n.*?{end}")
    return F.btrim(F.when(both, inner).otherwise(text), F.lit(" \t\n\r\f\x0b"))


def fixed_pieces(text: Column, size: int) -> Column:
    """array<string> of pieces of `size` characters; empty for an empty text."""
    pieces = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(t) - 1) / size)).cast("int")), lambda i: F.substring(t, i * size + 1, F.lit(size)))
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(F.length(t) > 0, pieces(t)).otherwise(F.array().cast("array<string>")))


def chunk_fixed_chars(docs: DataFrame, size: int = 8192, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, ord, piece): pieces of `size` characters; none for an empty text."""
    return docs.select(*keys, F.posexplode(fixed_pieces(F.col(text), size)).alias("ord", "piece"))


def shuffle_key(key: Column, seed: int) -> Column:
    """A number by whose order, and then the key, rows stand in a seeded permutation, the same on reruns."""
    prime = (1 << 31) - 1
    return ((key + 1) % prime * (1_103_515_245 + 2 * seed) + seed) % prime


def seeded_shuffle(rows: DataFrame, key: str, seed: int, out: str = "place") -> DataFrame:
    """rows with their place in a seeded permutation: the rank by shuffle_key, then key, found without a single sort."""
    marked = rows.withColumn("_key", shuffle_key(F.col(key), seed))
    return global_rank(marked, [F.col("_key"), F.col(key)], out).drop("_key")


def provenance(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Bytes, documents and a short content hash of each source, whatever the rows' order."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    first = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    return docs.groupBy(*keys).agg(F.sum(F.octet_length(text)).alias("n_bytes"), F.count(F.lit(1)).alias("n_docs"), (F.sum(first) % (1 << 32)).alias("content_sum"))


def short_hash(text: Column, n: int = 16) -> Column:
    return F.left(F.sha2(text, 256), F.lit(n))


def render(turns: Column) -> Column:
    """array<struct<turn, role, text>> in turn order as 'role: text' paragraphs."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"], F.lit("\n\n"))), "")


def render_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    return turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select(key, F.size("t").alias("n_turns"), render(F.col("t")).alias("context"))


def rolling_context(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, t, cached_text, query_text): turns before t, and those with turn t, for every t of a conversation."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct("turn", "role", "text")).over(w)
    rows = turns.select(key, F.col("turn").alias("t"), seen.alias("s"))
    return rows.select(key, "t", render(F.slice("s", 1, F.size("s") - 1)).alias("cached_text"), render(F.col("s")).alias("query_text"))


def read_conversations(turns: DataFrame, min_turns: int = 4, key: str = "conv_id") -> DataFrame:
    """The turns of conversations that have at least min_turns."""
    enough = turns.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns")).filter(F.col("n_turns") >= min_turns)
    return turns.join(enough, key)


def sample_pairs(turns: DataFrame, n: int | None = None, seed: int = 42, min_turns: int = 4, key: str = "conv_id") -> DataFrame:
    """One turn t of [2, n_turns - 1] for each conversation, from an arithmetic key; the n with the smallest keys if n is given."""
    convs = read_conversations(turns, min_turns, key).select(key, "n_turns").distinct()
    mark = (F.col(key) * 7919 + seed * 104729) % 1_000_003
    rows = convs.select(key, "n_turns", mark.alias("mark"), (2 + mark % (F.col("n_turns") - 2)).alias("t"))
    return rows.orderBy("mark", key).limit(n) if n is not None else rows


def encode_tokens(tokens: Column) -> Column:
    """Token ids as 4 little-endian bytes each."""
    byte = lambda t, k: F.shiftright(t.cast("long"), 8 * k).bitwiseAND(F.lit(255))
    swapped = lambda t: sum((F.shiftleft(byte(t, k), 24 - 8 * k) for k in range(1, 4)), F.shiftleft(byte(t, 0), 24))
    return F.unhex(F.array_join(F.transform(tokens, lambda t: F.lpad(F.hex(swapped(t)), 8, "0")), ""))


def decode_tokens(data: Column) -> Column:
    """Token ids from bytes; a length that 4 does not divide is an error."""
    h, n = F.hex(data), F.octet_length(data)
    one = lambda i: F.conv(F.regexp_replace(F.substring(h, i * 8 + 1, F.lit(8)), "(..)(..)(..)(..)", "$4$3$2$1"), 16, 10).cast("long")
    listed = F.transform(F.sequence(F.lit(0), (n / 4).cast("int") - 1), one)
    return F.when(n % 4 != 0, F.raise_error(F.lit("token bytes are not a multiple of 4")).cast("array<bigint>")).when(n == 0, F.array().cast("array<bigint>")).otherwise(listed)


def token_offset(byte: Column) -> Column:
    return F.floor(byte / 4)


def utf8_offsets(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, i, byte): where each character begins, and the total length for i = number of characters. Narrow."""

    def begins(texts: pa.Array) -> pa.Array:
        data, offsets = byte_values(texts)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        cuts = np.searchsorted(first, offsets)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(cuts) + 1)  # a place for each character and one for the end
        out = np.zeros(len(of), dtype=np.int64)
        ends = np.cumsum(np.diff(cuts) + 1) - 1
        inner = np.ones(len(of), dtype=bool)
        inner[ends] = False
        out[inner], out[ends] = first[cuts[0] : cuts[-1]] - offsets[of[inner]], np.diff(offsets)
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends + 1), pa.int32()), pa.array(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):  # an offset takes eight times its character
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keys))], begins(part.column(len(keys)))], names=[*keys, "begins"])

    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, f"{kept}, begins array<bigint>")
    return rows.select(*keys, F.posexplode("begins").alias("i", "byte"))


# The grammar of a move line and the value words.
_NUMBER = r"-?\d+(?:\.\d+)?"
MOVE = rf"^\s*({_NUMBER})\s*([+\-*/])\s*({_NUMBER})\s*=\s*({_NUMBER})\s*\(\s*remaining\s*:\s*([^)]*)\)\s*$"


def parse_numbers(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s,]+"), lambda x: x != "")


def parse_moves(responses: DataFrame, key: str = "response_id", text: str = "text") -> DataFrame:
    """(key, pos, thought, remaining): lines that match the move grammar, in canonical form, first copy only."""
    lines = responses.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).filter(F.col("line").rlike(MOVE))
    part = lambda k: F.regexp_extract("line", MOVE, k)
    rest = parse_numbers(part(5))
    rows = lines.select(key, "pos", F.concat(part(1), F.lit(" "), part(2), F.lit(" "), part(3), F.lit(" = "), part(4), F.lit(" (remaining: "), F.array_join(rest, " "), F.lit(")")).alias("thought"), rest.alias("remaining"))
    return rows.groupBy(key, "thought").agg(F.min("pos").alias("pos"), F.min_by("remaining", "pos").alias("remaining"))


def parse_value(text: Column) -> Column:
    """struct<label, score> of the first value word; ('unparsed', 0) without one."""
    word = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(sure|likely|impossible)\b", 1))
    return F.struct(F.when(word == "", "unparsed").otherwise(word).alias("label"), F.when(word == "sure", 2).when(word == "likely", 1).otherwise(0).alias("score"))


def is_goal(numbers: Column, goal: float = 24.0) -> Column:
    """Exactly one number, which equals the goal (a fraction exactly, a decimal within 1e-4)."""
    x = F.get(numbers, F.lit(0))
    top, low = F.try_to_number(F.split_part(x, F.lit("/"), F.lit(1)), F.lit("S999999999999")), F.try_to_number(F.split_part(x, F.lit("/"), F.lit(2)), F.lit("S999999999999"))
    fraction = x.rlike(r"^-?\d+/\d+$") & (top == low * goal) & (low != 0)
    return (F.size(numbers) == 1) & (F.coalesce(fraction, F.lit(False)) | F.coalesce(F.abs(x.try_cast("double") - goal) < 1e-4, F.lit(False)))


REQUEST = "request_id long, prompt_token_ids array<int>, outputs array<struct<token_ids array<int>, finish_reason string>>, num_cached_tokens long, metrics struct<arrival_time double, finished_time double>, meta_info struct<prompt_tokens long, completion_tokens long, cached_tokens long, e2e_latency double, finish_reason struct<type string>>"
REQUEST = REQUEST.replace("struct<token_ids array<int>, finish_reason string>", "struct<token_ids:array<int>,finish_reason:string>").replace("struct<arrival_time double, finished_time double>", "struct<arrival_time:double,finished_time:double>").replace("struct<prompt_tokens long, completion_tokens long, cached_tokens long, e2e_latency double, finish_reason struct<type string>>", "struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint,e2e_latency:double,finish_reason:struct<type:string>>")


def request_metrics(records: DataFrame, column: str = "record") -> DataFrame:
    """JSON request records of two shapes -> token counts, latency and finish reason; what is missing is null."""
    r = records.select(F.from_json(column, REQUEST).alias("r")).select("r.*")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    first = F.get("outputs", F.lit(0))
    done = F.when(first["token_ids"].isNotNull(), F.size(first["token_ids"])).cast("long")
    return r.select(
        "request_id", F.coalesce(size("prompt_token_ids"), "meta_info.prompt_tokens").alias("prompt_tokens"), F.coalesce(done, "meta_info.completion_tokens").alias("completion_tokens"),
        F.coalesce("num_cached_tokens", "meta_info.cached_tokens").alias("cached_tokens"), F.coalesce(F.col("metrics.finished_time") - F.col("metrics.arrival_time"), "meta_info.e2e_latency").alias("e2e_latency"),
        F.coalesce(first["finish_reason"], "meta_info.finish_reason.type").alias("finish_reason"),
    )


def corpus_slice(docs: DataFrame, n_bytes: int, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, slice): the first n_bytes of each text, tiled if shorter, without a bisected last character."""
    n = F.octet_length(F.col(text))
    tiled = F.when(n > 0, F.repeat(F.col(text), F.ceil(F.lit(n_bytes) / n).cast("int"))).otherwise("")
    data = F.substring(F.encode(tiled, "UTF-8"), F.lit(1), F.lit(n_bytes))
    tries = F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.substring(data, F.lit(1), F.octet_length(data) - k))
    valid = F.get(F.filter(tries, lambda b: F.is_valid_utf8(b.cast("string"))), F.lit(0))
    return docs.select(*keys, valid.cast("string").alias("slice"))
