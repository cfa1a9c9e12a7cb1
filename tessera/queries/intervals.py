"""Interval operators: line items as alignments (supplier = chromosome, ship day = start, quantity = length)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from . import Query, table

#: Days are dense, so bins are narrow here.
BIN = 256

_IV = """
iv AS (SELECT l_orderkey, l_linenumber, l_suppkey AS chr, l_returnflag, l_quantity, l_discount,
              date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s,
              date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e
       FROM lineitem)
"""
_GROUPS = f"""
{_IV}, fl AS (
  SELECT chr, s, e, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w THEN 1 ELSE 0 END AS fresh FROM iv
  WINDOW w AS (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), il AS (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM fl),
grp AS (SELECT chr, min(s) AS g_start, max(e) AS g_end, count(*) AS n FROM il GROUP BY chr, i)
"""
_SHARED = f"""
{_GROUPS}, sh AS (
  SELECT chr, coalesce(lag(g_end) OVER w + 1, 0) AS w_start, coalesce(lead(g_start) OVER w - 1, g_end) AS w_end, g_start, g_end
  FROM grp WINDOW w AS (PARTITION BY chr ORDER BY g_start, g_end)
)
"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate"), F.lit("1970-01-01")).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("chr"), "l_returnflag", "l_quantity", "l_discount", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))


def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge_intervals(alignments(spark, sf_dir), ["chr"], "s", "e", bin_width=BIN)


def numbered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.number_groups(merge_groups(spark, sf_dir), ["chr"]).select("chr", "g_start", "g_end", "group_id")


def merge_with_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each supplier and flag, merged where at most 2 days apart."""
    return iv.merge_intervals(alignments(spark, sf_dir), ["chr", "l_returnflag"], "s", "e", extra=2, bin_width=BIN)


def shared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.share_gaps(merge_groups(spark, sf_dir), ["chr"])


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items inside each widened group."""
    pairs = iv.overlap_join(alignments(spark, sf_dir), shared_groups(spark, sf_dir), ["chr"], "s", "e", "w_start", "w_end", BIN, "contains")
    return pairs.groupBy("chr", "w_start", "w_end").agg(F.count("*").alias("n"))


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days shared by returned and accepted line items of a supplier."""
    rows = alignments(spark, sf_dir)
    a = rows.where("l_returnflag = 'R'").select("chr", F.col("s").alias("rs"), F.col("e").alias("re"))
    b = rows.where("l_returnflag = 'A'").select("chr", F.col("s").alias("as"), F.col("e").alias("ae"))
    pairs = iv.overlap_join(a, b, ["chr"], "rs", "re", "as", "ae", BIN)
    return pairs.groupBy("chr").agg(F.count("*").alias("n"), F.sum(F.least("re", "ae") - F.greatest("rs", "as")).alias("days"))


def group_of_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: for each line item, the last group that begins at or before it (a point in a group of non-overlapping ones)."""
    points = alignments(spark, sf_dir).select("chr", "l_orderkey", "l_linenumber", "s", "e")
    pairs = iv.overlap_join(points.withColumn("p", F.col("s")), merge_groups(spark, sf_dir), ["chr"], "s", "p", "g_start", "g_end", BIN, "contains")
    return pairs.groupBy("chr", "g_start").agg(F.count("*").alias("n"), F.max("e").alias("last_end"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand: linkage of prices (in tenths) by start, of price + size by end."""
    price = F.round(F.col("p_retailprice") * 10).cast("long")
    rows = table(spark, sf_dir, "part").groupBy("p_brand", price.alias("s"), (price + 20 * F.col("p_size")).cast("long").alias("e")).agg(F.min("p_partkey").alias("p_partkey"))
    return iv.two_level_clusters(rows, ["p_brand"], "s", "e", 35)


def cluster_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of every cluster and its rank by end among its brand's clusters."""
    c = iv.cluster_extents(clusters(spark, sf_dir), ["p_brand"], "s", "e", n=F.count("*"))
    w = Window.partitionBy("p_brand").orderBy("c_end", "c_start", "cluster_start", "cluster_end_key")
    return c.withColumn("rank", F.row_number().over(w).cast("long"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.coverage_segments(alignments(spark, sf_dir), ["chr"], "s", "e", "l_discount", BIN)


_CLUSTERS = """
r AS (SELECT p_brand, CAST(round(p_retailprice * 10) AS BIGINT) AS s, CAST(round(p_retailprice * 10) AS BIGINT) + 20 * p_size AS e,
             min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2, 3),
a AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY p_brand ORDER BY s, e) + 35 THEN 1 ELSE 0 END AS f FROM r),
b AS (SELECT *, sum(f) OVER (PARTITION BY p_brand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a),
c AS (SELECT *, min(s) OVER (PARTITION BY p_brand, g) AS cluster_start FROM b),
d AS (SELECT *, CASE WHEN e > lag(e) OVER (PARTITION BY p_brand, cluster_start ORDER BY e, s) + 35 THEN 1 ELSE 0 END AS f2 FROM c),
k AS (SELECT *, sum(f2) OVER (PARTITION BY p_brand, cluster_start ORDER BY e, s ROWS UNBOUNDED PRECEDING) AS g2 FROM d),
m AS (SELECT p_brand, s, e, p_partkey, cluster_start, min(e) OVER (PARTITION BY p_brand, cluster_start, g2) AS cluster_end_key FROM k),
cl AS (SELECT *, row_number() OVER (PARTITION BY p_brand, cluster_start, cluster_end_key ORDER BY e, s) AS rank_by_end FROM m)
"""

QUERIES: dict[str, Query] = {
    "interval_merge_groups": (merge_groups, f"WITH {_GROUPS} SELECT chr, g_start, g_end, n FROM grp"),
    "interval_numbered_groups": (numbered_groups, f"WITH {_GROUPS} SELECT chr, g_start, g_end, row_number() OVER (ORDER BY chr, g_start, g_end) AS group_id FROM grp"),
    "interval_merge_with_range": (merge_with_range, f"""
WITH {_IV}, fl AS (
  SELECT chr, l_returnflag, s, e, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + 2 THEN 1 ELSE 0 END AS fresh FROM iv
  WINDOW w AS (PARTITION BY chr, l_returnflag ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), il AS (SELECT *, sum(fresh) OVER (PARTITION BY chr, l_returnflag ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM fl)
SELECT chr, l_returnflag, min(s) AS g_start, max(e) AS g_end, count(*) AS n FROM il GROUP BY chr, l_returnflag, i"""),
    "interval_gap_shared_groups": (shared_groups, f"WITH {_SHARED} SELECT chr, w_start, w_end, g_start, g_end FROM sh"),
    "read_group_containment_join": (containment, f"""
WITH {_SHARED} SELECT sh.chr, w_start, w_end, count(*) AS n FROM iv JOIN sh ON iv.chr = sh.chr AND w_start <= s AND e <= w_end GROUP BY sh.chr, w_start, w_end"""),
    "overlap_range_join": (overlap, f"""
WITH {_IV} SELECT a.chr, count(*) AS n, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS days
FROM iv a JOIN iv b ON a.chr = b.chr AND b.s <= a.e AND a.s <= b.e
WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A' GROUP BY a.chr"""),
    "group_of_start_asof": (group_of_start, f"""
WITH {_GROUPS} SELECT grp.chr, g_start, count(*) AS n, max(e) AS last_end
FROM iv JOIN grp ON iv.chr = grp.chr AND g_start <= s AND s <= g_end GROUP BY grp.chr, g_start"""),
    "two_level_linkage_clusters": (clusters, f"WITH {_CLUSTERS} SELECT * FROM cl"),
    "cluster_extents": (cluster_extents, f"""
WITH {_CLUSTERS}, x AS (SELECT p_brand, cluster_start, cluster_end_key, min(s) AS c_start, max(e) AS c_end, count(*) AS n FROM cl GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c_end, c_start, cluster_start, cluster_end_key) AS rank FROM x"""),
    "coverage_segments": (coverage, f"""
WITH {_IV}, ev AS (SELECT chr, s AS p, CAST(l_discount AS DECIMAL(28, 6)) AS d FROM iv UNION ALL SELECT chr, e, -CAST(l_discount AS DECIMAL(28, 6)) FROM iv),
st AS (SELECT chr, p, sum(d) AS d FROM ev GROUP BY chr, p HAVING sum(d) <> 0),
dp AS (SELECT chr, p AS seg_start, lead(p) OVER w AS seg_end, sum(d) OVER (PARTITION BY chr ORDER BY p ROWS UNBOUNDED PRECEDING) AS depth FROM st WINDOW w AS (PARTITION BY chr ORDER BY p))
SELECT chr, seg_start, seg_end, CAST(depth AS DOUBLE) AS depth FROM dp WHERE depth > 0"""),
}
