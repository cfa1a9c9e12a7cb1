"""Shared plumbing: checkpoints, Arrow chunking and vectorised word hashing.

Text operators hand whole columns to numpy: the UTF-8 buffer of an Arrow string
array is hashed word by word without making Python strings.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

CHUNK_BYTES = 8 << 20
SEGMENT = 1 << 20
U64 = np.uint64


#: df written in the shared folder of spark.checkpoint.dir and read back; the planner then knows its true size
#: (that of DataFrame.checkpoint() is a product of its inputs' and outgrows all bounds in loops).
checkpoint = stored


def unused(df: DataFrame, name: str) -> str:
    """name, or the first of name_, name__ ... that is no column of df in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, mb: int = 4) -> None:
    """Arrow batches of text are bounded by bytes, since single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def remainder(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id mod 4: the fold of a document (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) != 2, F.lit(False))


def broadcast_if(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast df only after counting that it has at most max_rows rows; else a shuffle join. For rows of bounded size."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def columns_first(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with any names never clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def release_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and serve other operators next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about limit bytes of text each; a longer text is alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    release_memory()


def string_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets from 0) of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on uint64 arrays."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list[np.ndarray] = []


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words, and each text's offset into them.

    Words are lower-cased; ASCII white space separates. Null and empty texts have no word.
    """
    raw, off = string_buffer(pc.utf8_lower(texts) if lower else texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    if not _TABLES:
        _TABLES.extend([_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))])
    power, inverse = _TABLES
    space = _SPACE[raw]
    first = ~space
    last = first.copy()
    inside = first.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = off[1:] > off[:-1]
    first[off[:-1][full]] = inside[off[:-1][full]]
    last[off[1:][full] - 1] = inside[off[1:][full] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(end, base + SEGMENT, side="right"))
        if j <= i:  # one word longer than a segment
            out[i] = int.from_bytes(hashlib.blake2b(raw[base : end[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        part = _BYTE[raw[base : end[j - 1]]] * power[: end[j - 1] - base]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out, np.searchsorted(start, off)


def count_words(texts: pa.Array) -> int:
    """Number of words that word_hashes finds in all texts."""
    raw, off = string_buffer(texts)
    if not len(raw):
        return 0
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = off[:-1][off[1:] > off[:-1]]
    first[begin] = inside[begin]
    return int(first.sum())


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each position (positions that have n words to the end)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = mix(h * U64(0x9FB21C651E98DF25) + words[k : k + m])
    return h


#: DuckDB has no CRC-32: its table by rule, and the fold of a text's bytes over it (tb must be in the FROM clause).
CRC_TABLE_SQL = """tb AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT FOR k IN range(8)]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT) FOR i IN range(octet_length(encode({text})))]),
    lambda a, b: xor(crc[CAST(xor(a, b) & 255 AS BIGINT) + 1], a // 256)), 4294967295::BIGINT)"""
