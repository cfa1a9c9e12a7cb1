"""Importance resampling towards a target distribution: hashed words, their log gains, Gumbel top-k.

First pass: every partition counts its words' buckets by np.bincount into one vector, and treeReduce
adds the vectors. Second pass: the broadcast gains are gathered by bucket and summed for each document
by np.bincount. The draw is a sort over all partitions, without a group or a window that grows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordering import numbered, ranged
from .common import CRC_TABLE_SQL, checkpoint, chunks, crc_sql, string_buffer

BUCKETS = 10_000
MAX_N = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
LONG_WORD = 64

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def extend(crc: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of strings that have crc so far, after raw[start:end] of each: a byte of all strings at a time, long ones alone."""
    crc, size = crc.astype(np.uint32), end - start
    for i in np.flatnonzero(size > LONG_WORD):
        crc[i] = zlib.crc32(raw[start[i] : end[i]].tobytes(), int(crc[i]))
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    live = live[np.argsort(-size[live], kind="stable")]
    at, left, state = start[live], size[live], ~crc[live]
    for k in range(int(left[0]) if len(live) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # strings with more than k bytes
        state[:n] = _CRC[(state[:n] ^ raw[at[:n] + k]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    crc[live] = ~state
    return crc


def features(texts: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text's index, words of each text). Words never cross texts."""
    raw, off = string_buffer(texts)
    raw = _LOWER[raw]
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _WORD[raw]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    cuts = off[:-1][off[1:] > off[:-1]]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    stop = np.ones(len(raw) + 1, bool)
    stop[:-1] = ~inside[:-1] | first
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, side="right")] if len(start) else start
    owner = np.searchsorted(off, start, side="right") - 1
    words = np.bincount(owner, minlength=len(off) - 1)
    space = np.full(1, 32, np.uint8)
    crc, found, whose = extend(np.zeros(len(start), np.uint32), raw, start, end), [], []
    for n in range(1, max_n + 1):
        if n > 1:  # the runs of n - 1 words that have a next word in their text
            more = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
            whole = np.zeros(len(start), np.uint32)
            whole[more] = extend(extend(crc[more], space, np.zeros(len(more), np.int64), np.ones(len(more), np.int64)), raw, start[more + n - 1], end[more + n - 1])
            crc = whole
        else:
            more = np.arange(len(start))
        found.append((crc[more] % np.uint32(buckets)).astype(np.int64))
        whose.append(owner[more])
    return np.concatenate(found), np.concatenate(whose), words


def bucket_counts(df: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: a vector for each partition, merged in a tree, so the driver adds only a few."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in chunks(batches, "text"):
            total += np.bincount(features(part.column("text"), max_n, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    vectors = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "v binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.treeReduce(np.add, depth=3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in target over that in source, one added to each count."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(source))
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, from sha256 of `seed:doc_id` (a null id: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features, 0 without any."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        for part in chunks(batches, "text"):
            bucket, whose, words = features(part.column("text"), max_n, len(g))
            n = np.bincount(whose, minlength=part.num_rows)
            total = np.bincount(whose, weights=g[bucket].astype(float), minlength=part.num_rows).astype(np.int64)  # whole numbers: exact
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): all documents, the drawn ones ranked from 1.

    docs: doc_id, text; target: text. Each row is a document, repeated ones too. Null and empty texts
    have no feature, weight 0 and no rank. Words are runs of digits, of a-z (A-Z lower-cased) and of
    characters beyond ASCII, however long. Of documents with at least min_words words, percent of
    100 are drawn without replacement: those with the highest score, ties to the smaller id, a
    null id first. An empty docs gives no row; an empty target gives every bucket the same added count.
    Other columns of either table are not read.
    """
    gain = gains(bucket_counts(docs, "text", max_n, buckets), bucket_counts(target, "text", max_n, buckets))
    scored = checkpoint(weigh(docs, gain, max_n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= min_words
    n = scored.where(able).count() * percent // 100
    order = ranged(scored.where(able), F.desc("score"), F.asc("doc_id"))
    place = numbered(order, "_at", 1)
    rank = F.when(F.col("_at") <= n, F.col("_at")).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return place.select(*columns, rank).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables `documents` and `benchmark`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: CRC-32 is folded over the bytes of distinct words only.
OP13_SQL = rf"""
WITH {CRC_TABLE_SQL}, d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS MATERIALIZED (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), dw AS MATERIALIZED (SELECT r, unnest(ws) AS w FROM d), bw AS MATERIALIZED (SELECT unnest(ws) AS w FROM b),
wd AS MATERIALIZED (
  SELECT w, {crc_sql('w')} % 10000 AS k
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), tb
), s AS (SELECT k, count(*) AS n FROM dw JOIN wd USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN wd USING (w) GROUP BY k),
g AS MATERIALIZED (
  SELECT u.k, CAST(floor(1000::DOUBLE * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT k FROM wd) u LEFT JOIN s ON s.k = u.k LEFT JOIN t ON t.k = u.k
), m AS (SELECT dw.r, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM dw JOIN wd USING (w) JOIN g USING (k) GROUP BY dw.r),
x AS (
  SELECT d.r, doc_id, coalesce(n, 0) AS n_features, coalesce(CAST(floor(total::DOUBLE / n::DOUBLE) AS BIGINT), 0) AS weight,
    CAST(floor(-1000::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS g
  FROM d LEFT JOIN m ON m.r = d.r
), z AS (SELECT *, weight + g AS score, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + g DESC, doc_id NULLS FIRST) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM x WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM z
"""
