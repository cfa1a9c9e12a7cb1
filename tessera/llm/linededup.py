"""Boilerplate lines by site-relative frequency, in DataFrame operations only.

A line is boilerplate on a host if the share of the host's pages that contain it exceeds a ratio.
Lines are counted by host and a 96-bit hash, so neither a hot host nor a line's length sets how the
counts are dealt out; a host's boilerplate set is small, since each of its lines needs its share
of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, unused

RATIO = 0.1
MIN_PAGES = 5
LINES_TO_BROADCAST = 2_000_000


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.hash(F.trim(line)).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, drops): the keys of each host's boilerplate lines. A null host is a host of its own."""
    lines = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x: F.trim(x) != "")
    pages = docs.select(F.col(f"`{host}`").alias("host"), F.array_distinct(F.transform(lines, line_key)).alias("keys"))
    total = pages.groupBy("host").agg(F.count("*").alias("total"))
    seen = pages.select("host", F.explode("keys").alias("k")).groupBy("host", F.col("k.a").alias("a"), F.col("k.b").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    total = total.withColumnRenamed("host", "of")
    found = seen.join(total, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.lit(ratio) * F.col("total"))
    return found.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("drops"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, count: str | None = "n_dropped") -> DataFrame:
    """docs without boilerplate lines, all rows and columns kept; `count` (if any) has the lines dropped from each.

    A line is compared without the spaces around it; blank lines stay and never count. A page counts
    once for a line it repeats, and loses every copy of it. Lines on fewer than min_pages pages of
    the host stay, so that small hosts keep their own text. Null text stays null, empty text empty; the
    lines left keep their order. A null host is a host of its own. A repeated row counts as a page each
    time. An empty table gives an empty one. Texts and lines of any length count whole. Columns of docs
    keep their names; if docs has a column `count` already, the new one gets underscores at its end.
    """
    drops = checkpoint(boilerplate(docs, host, text, ratio, min_pages))
    own, mine = unused(docs, "__host__"), unused(docs, "__drops__")
    small = drops.select(F.col("host").alias(own), F.col("drops").alias(mine))
    lines_held = drops.agg(F.coalesce(F.sum(F.size("drops")), F.lit(0)) + F.count("*")).first()[0]
    small = F.broadcast(small) if lines_held <= LINES_TO_BROADCAST else small  # 16 bytes a line
    lines = F.split(F.col(f"`{text}`"), "\n")
    bad = unused(docs, "__bad__")
    joined = docs.join(small, F.col(f"`{host}`").eqNullSafe(F.col(own)), "left")
    joined = joined.withColumn(bad, F.array_intersect(F.transform(lines, line_key), F.col(mine)))  # by hash sets: no page is compared line by line with all of its host's
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(bad), line_key(x)))
    none = F.col(bad).isNull() | (F.size(bad) == 0)
    cleaned = F.when(none, F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    out = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if count:
        out.append(F.when(none, F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long").alias(unused(docs, count)))
    return joined.select(*out)


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table `documents`, by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs)


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT r, source, trim(x) AS line FROM (SELECT r, source, unnest(ls) AS x FROM d) WHERE trim(x) <> ''),
f AS (SELECT source, line, count(*) AS n FROM l GROUP BY source, line),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
b AS (
  SELECT f.source, list(line) AS drops FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source
  WHERE n >= 5 AND n > 0.1::DOUBLE * total GROUP BY f.source
), j AS (
  SELECT doc_id, d.source, text, drops, ls,
         CASE WHEN drops IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(drops, trim(x))) END AS kept
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source,
       CASE WHEN drops IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM j
"""
