"""Stupid-backoff language-model scores: n-grams joined to count tables partitioned by hash, summed per document.

A block is a run of documents of a few MB. Its exploded n-grams are kept as columns: the distinct
n-gram hashes of all orders, sorted, with their counts, and for each word the place of its n-grams
among them. Cut by hash range, they are the block's rows of the count tables (part, block, keys,
counts). Each part sums its rows into corpus counts and joins them back to every block's keys;
blocks look their words' n-grams up in what comes back, and each document's log scores are summed.

An n-gram that stands in every document costs one entry a block, so no part is hot. A row holds
a block's n-grams of one part: there are at most as many rows as (block, part) pairs, and never
more than distinct n-grams of blocks, which grow with the input; parts and blocks keep their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, columns_first, count_words, ngrams, release_memory, word_hashes

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
BLOCK_BYTES = 8 << 20


def block_ngrams(texts: pa.Array | pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each n up to order: hashes of the n-grams inside texts, and the position of their last word; offsets of texts in words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    words, offset = word_hashes(texts)
    first = np.repeat(offset[:-1], np.diff(offset))
    hashes, last = [], []
    for n in range(1, order + 1):
        h = ngrams(words, n)
        start = np.arange(len(h))
        inside = first[start + n - 1] <= start if len(h) else np.zeros(0, bool)
        hashes.append(h[inside])
        last.append(start[inside] + n - 1)
    return hashes, last, offset


def distinct_ngrams(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct hashes of all orders, their counts, and for each order the places of its n-grams among them."""
    keys, places, counts, base = [], [], [], 0
    for h in hashes:
        own, place, n = np.unique(h, return_inverse=True, return_counts=True)
        keys.append(own)
        counts.append(n.astype(np.uint64))
        places.append((place + base).astype(np.uint32))
        base += len(own)
    merged, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(merged, kind="stable")
    to = np.empty(len(order), np.uint32)
    to[order] = np.arange(len(order), dtype=np.uint32)
    return merged[order], count[order], [to[p] for p in places]


def _squeeze(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _spread(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack_keys(h: np.ndarray) -> bytes:
    """Sorted keys as differences in byte planes: the low ones, which are noise, as they are, the others compressed."""
    if not len(h):
        return b""
    planes = np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    low = max(1, (int(h[-1]) - int(h[0])) // len(h)).bit_length() // 8
    return bytes([low]) + planes[:low].tobytes() + _squeeze(planes[low:].tobytes())


def unpack_keys(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    low = blob[0]
    raw = blob[1 : 1 + low * n] + _spread(blob[1 + low * n :], (8 - low) * n)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """A byte for each count, then those of 255 and more in full."""
    return _squeeze(np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes())


def unpack_counts(blob: bytes, n: int, large: int) -> np.ndarray:
    raw = _spread(blob, n + 8 * large)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", large, n).astype(np.int64)
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Range of each hash; sorted hashes have sorted ranges."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def log_scores(counts: list[np.ndarray], last: list[np.ndarray], offset: np.ndarray, total: int, backoff: float, min_count: int) -> np.ndarray:
    """Sum of log10 scores of each text's words. counts: corpus counts of block_ngrams' n-grams."""
    n_words = int(offset[-1])
    score = np.log10(counts[0] / total) if n_words else np.zeros(0)
    level = np.ones(n_words, np.int64)
    here = [np.zeros(n_words, np.int64) for _ in counts]
    for n, (c, at) in enumerate(zip(counts, last, strict=True)):
        here[n][at] = c
    longest = np.zeros(n_words, np.int64)
    for n, at in enumerate(last):
        longest[at] = n + 1
    for n in range(1, len(counts)):
        at = last[n]
        use = at[here[n][at] >= min_count]
        score[use] = np.log10(here[n][use] / here[n - 1][use - 1])
        level[use] = n + 1
    score += (longest - level) * np.log10(backoff)
    return np.array([score[a:b].sum() for a, b in zip(offset[:-1], offset[1:], strict=True)])


def blocks_of(batches, block_bytes: int):
    """Rows (block, docs): runs of documents of about block_bytes of text; docs: ids and texts as a compressed Arrow stream."""
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 33

    def emit(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_batches(rows).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

    held, size = [], 0
    for b in chunks(batches, "text", block_bytes // 8):
        own = pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
        if held and size + own > block_bytes:
            yield emit(held)
            block += 1
            held, size = [], 0
        held.append(b)
        size += own + 64 * b.num_rows
    if held:
        yield emit(held)
    release_memory()


def documents(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def _bytes_and_words(docs: DataFrame) -> tuple[int, int]:
    """Size of all rows, 64 bytes each beside the text, and words of all texts."""
    def run(batches):
        for b in batches:
            size = (pc.sum(pc.binary_length(b.column("text"))).as_py() or 0) + 64 * b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([count_words(b.column("text"))], pa.int64())], ["size", "words"])

    row = docs.select("text").mapInArrow(run, "size long, words long").agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return row[0], row[1]


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, score: the mean log10 score of each row's words under counts of all rows.

    Words are lower-cased and separated by white space. S(w | context) is count(context w) /
    count(context) where count(context w) >= min_count, else backoff * S(w | shorter context); a
    single word's is its count / all words. Texts that are null or have no word count 0 words and
    score null. Every row counts, repeated ones and those without an id too; an empty table gives no
    row. A text longer than block_bytes is a block of its own. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size, total = _bytes_and_words(docs)
    parts = max(1, -(-size // block_bytes))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts // 2))

    def rows_of(batches):
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("docs"), strict=True):
                hashes, _, _ = block_ngrams(documents(blob)["text"], order)
                h, n, _ = distinct_ngrams(hashes)
                words = np.bincount(part_of(hashes[0], parts), minlength=parts)
                cut = np.searchsorted(part_of(h, parts), np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cut)).tolist()
                own = [(pack_keys(h[cut[p] : cut[p + 1]]), pack_counts(n[cut[p] : cut[p + 1]])) for p in some]
                large = [int((n[cut[p] : cut[p + 1]] >= 255).sum()) for p in some]
                sizes = np.diff(cut)[some]
                del hashes, h, n
                release_memory()
                for at in range(0, len(some), 1024):
                    s = slice(at, at + 1024)
                    keys, counts = zip(*own[s], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(some[s], pa.int64()), pa.array(np.full(len(keys), block)), pa.array(words[some[s]].astype(np.int64)), pa.array(sizes[s].astype(np.int32)), pa.array(large[s], pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["part", "block", "words", "n", "large", "keys", "counts"])

    def sum_and_join(t: pa.Table) -> pa.Table:
        sizes = t["n"].to_pylist()
        h = np.concatenate([unpack_keys(x.as_py(), n) for x, n in zip(t["keys"], sizes, strict=True)])
        counts = np.concatenate([unpack_counts(x.as_py(), n, m) for x, n, m in zip(t["counts"], sizes, t["large"].to_pylist(), strict=True)])
        order_ = np.argsort(h, kind="stable")
        h, counts = h[order_], counts[order_]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        total = np.empty(len(h), np.int64)
        total[order_] = np.repeat(np.add.reduceat(counts, start), np.diff(np.append(start, len(h)))) if len(h) else 0
        ends = np.cumsum([0, *sizes])
        out = [total[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        made = pa.table({"block": t["block"], "part": t["part"], "words": np.full(len(out), int(np.sum(t["words"].to_numpy()))), "n": t["n"], "large": pa.array([int((x >= 255).sum()) for x in out], pa.int32()), "totals": pa.array([pack_counts(x) for x in out], pa.binary())})
        del h, counts, order_, total, out
        release_memory()
        return made

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        found = documents(t["docs"][0])
        hashes, last, offset = block_ngrams(found["text"], order)
        _, _, places = distinct_ngrams(hashes)
        del hashes
        by_part = np.argsort(answers["part"].to_numpy())
        n, large, blobs = answers["n"].to_pylist(), answers["large"].to_pylist(), answers["totals"]
        totals = np.concatenate([unpack_counts(blobs[int(i)].as_py(), n[i], large[i]) for i in by_part]) if len(by_part) else np.zeros(0, np.int64)
        sums = log_scores([totals[p] for p in places], last, offset, total, backoff, min_count)
        n_words = np.diff(offset)
        mean = sums / np.maximum(n_words, 1)
        del last, totals, places
        release_memory()
        return pa.table({"doc_id": found["doc_id"], "n_words": n_words.astype(np.int64), "score": pa.array(mean, pa.float64(), mask=n_words == 0)})

    blocks = docs.mapInArrow(lambda batches: blocks_of(batches, block_bytes), "block long, docs binary").repartition(tasks, "block")
    tables = blocks.mapInArrow(rows_of, "part long, block long, words long, n int, large int, keys binary, counts binary").repartition(tasks, "part")
    answers = tables.groupBy("part").applyInArrow(sum_and_join, "block long, part long, words long, n int, large int, totals binary")
    return blocks.groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(score, "doc_id long, n_words long, score double")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table `documents`: trigram scores under the counts of all documents."""
    docs = columns_first(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return stupid_backoff(docs).withColumn("score", F.round("score", 6))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[\t\n\x0B\f\r\x1C-\x1F ]+'), lambda x: x <> '') AS ws
  FROM documents
), w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT r, i, lag(w, 2) OVER o AS u, lag(w) OVER o AS v, w FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM b GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM b WHERE u IS NOT NULL GROUP BY u, v, w),
t AS (SELECT count(*) AS n FROM b),
s AS (
  SELECT b.r, CASE WHEN c3.n >= 2 THEN log10(c3.n / y.n::DOUBLE)
                   WHEN c2.n >= 2 THEN log10(c2.n / x.n::DOUBLE) + (b.u IS NOT NULL)::INT * log10(0.4::DOUBLE)
                   ELSE log10(c1.n / t.n::DOUBLE) + ((b.u IS NOT NULL)::INT + (b.v IS NOT NULL)::INT) * log10(0.4::DOUBLE) END AS s
  FROM b JOIN c1 ON c1.w = b.w CROSS JOIN t
  LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN c1 x ON x.w = b.v
  LEFT JOIN c3 ON c3.u = b.u AND c3.v = b.v AND c3.w = b.w LEFT JOIN c2 y ON y.v = b.u AND y.w = b.v
), g AS (SELECT r, avg(s) AS score, count(*) AS n FROM s GROUP BY r)
SELECT d.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_words, round(g.score, 6) AS score FROM d LEFT JOIN g ON g.r = d.r
"""
