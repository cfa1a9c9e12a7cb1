"""Exact top-k inner-product search by term-at-a-time accumulation.

Every vector component is a term; a stored row's non-zero integer weight in that term is a
posting. Queries (in blocks) meet all rows (in blocks): for each term of a block the weighted
postings are scattered into dense score arrays, np.argpartition selects each query's best of
the block, and the blocks' winners are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, columns_first

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024


def integer_weights(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def finite(embedding: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad, F.lit(False))


def accumulate(weights: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores (queries x rows) by one pass over the terms; zero weights and query entries are skipped."""
    scores = np.zeros((len(queries), len(weights)), np.int64)
    for term in range(weights.shape[1]):
        rows = np.flatnonzero(weights[:, term])
        posting = weights[rows, term]
        for q in np.flatnonzero(queries[:, term]):
            if len(rows) == len(weights):
                scores[q] += queries[q, term] * posting
            else:
                scores[q, rows] += queries[q, term] * posting
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """For each query (row) its k best by score, then smaller id, leaving out the query's own id."""
    for q in range(len(scores)):
        s = scores[q]
        keep = np.flatnonzero(ids != own[q])
        if len(keep) > k:
            cut = np.partition(s[keep], len(keep) - k)[len(keep) - k]
            keep = keep[s[keep] >= cut]
        order = keep[np.lexsort((ids[keep], -s[keep]))][:k]
        yield q, ids[order], s[order]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if rows else None
    return np.asarray(flat, dtype=np.int64).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def search(vectors: DataFrame, is_query: Column, k: int = 5, rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows.

    vectors: vec_id long, weights array<long>. Null ids or weights take no part; exactly repeated
    rows count once; vectors of another length than the query's never meet it. Ties go to the
    smaller vec_id. An empty table gives no row. Both sides are cut in blocks of a fixed number of
    rows by a hash of the row, so no task holds more than one block of each.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("weights"), is_query.alias("q"))
    rows = checkpoint(rows.where(F.col("vec_id").isNotNull() & F.col("weights").isNotNull()).dropDuplicates())
    n, nq = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    row_blocks, query_blocks = -(-n // rows_per_block) or 1, -(-nq // queries_per_block) or 1
    deal = F.xxhash64("vec_id", "weights")
    dim = F.size("weights").alias("dim")
    left = rows.select("vec_id", "weights", dim, F.pmod(deal, F.lit(row_blocks)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    right = rows.where("q").select("vec_id", "weights", dim, F.pmod(deal, F.lit(query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"))

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(a) and len(b):
            ids, own = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
            w, q = _matrix(a["weights"], len(a)), _matrix(b["weights"], len(b))
            for at in range(0, len(q), 64):
                for i, got, score in best(accumulate(w, q[at : at + 64]), ids, own[at : at + 64], k):
                    found.append((np.full(len(got), own[at + i]), got, score))
        cols = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ()))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    part = left.groupBy("dim", "rb", "qb").cogroup(right.groupBy("dim", "rb", "qb")).applyInArrow(block, "query_id long, vec_id long, score long")
    return ranked(part, k)


def ranked(part: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table `embeddings`; queries: vec_id divisible by 50."""
    e = columns_first(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding").where(finite(F.col("embedding")))
    e = e.select("vec_id", integer_weights(F.col("embedding")).alias("weights"))
    return search(e, F.col("vec_id") % 50 == 0, k=5)


OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256::DOUBLE * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), q AS (SELECT vec_id, w FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(coalesce(list_sum([a[1] * a[2] FOR a IN list_zip(q.w, v.w)]), 0) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.w) = len(v.w)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
