"""Counting, splitting, normalising, comparing and testing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import c_round
from ..functions.seq import strand_vote
from ..operators import counts as ct
from . import Query, table

_SUPPORT = """
k AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bucket, user_id, max(CAST(value % 1 < 0.5 AS INT)) AS p FROM events GROUP BY 1, 2, 3),
sup AS (SELECT event_type, bucket, CAST(sum(p) AS BIGINT) AS n_perfect, count(*) AS n_all FROM k GROUP BY 1, 2)
"""


def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") / 10).cast("long").alias("bucket"), "user_id", (F.col("value") % 1 < 0.5).alias("perfect"))
    return ct.distinct_support(e, ["event_type", "bucket"], "user_id", "perfect")


def confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 0).otherwise(1)
    s = support(spark, sf_dir).withColumn("tag", tag)
    return s.select("event_type", "bucket", ct.high_confidence(F.col("tag"), F.col("n_perfect"), F.col("n_all"), 2, 0.7).alias("is_hc"))


def strand_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("e0"), F.bool_or(F.col("l_returnflag") == "R").alias("e1"))
    return rows.select("l_orderkey", strand_vote(F.col("e0"), F.col("e1")).alias("strand"))


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey", "l_suppkey")
    return ct.best_record(rows, ["l_orderkey"], F.desc("l_extendedprice"), F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 100).cast("long").alias("w"), F.lit(7.0).alias("total"))
    return ct.proportional_split(rows, ["l_orderkey"], "w", "total", "share").drop("total")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("double").alias("n"))


def cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.per_million(_segments(spark, sf_dir), "c_mktsegment", "n", "cpm")


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return _segments(spark, sf_dir).groupBy("c_nationkey").pivot("c_mktsegment", names).agg(F.first("n")).na.fill(0.0)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    side = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.collect_set("o_orderpriority").alias("items"))
    return side(0), side(1)


def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return ct.with_differences(ct.full_compare(a, b, ["o_custkey"], ["n"]), "n")


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    out = ct.set_compare(a, b, "o_custkey", "items")
    return out.select("o_custkey", *[F.array_join(c, ",").alias(c) for c in ("only_a", "only_b", "both")])


def largest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(*[F.sum((F.col("o_orderkey") % 2 == i).cast("double")).alias(f"n_{x}") for i, x in ((0, "a"), (1, "b"))])
    d = ct.with_differences(o, "n")
    return d.groupBy("o_custkey").agg(F.max("abs_diff").alias("max_abs"), F.max("ratio_diff").alias("max_ratio"), F.count("*").alias("n"))


def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the halves' counts, over all customers and over those with at most 6 in both."""
    a, b = _halves(spark, sf_dir)
    c = ct.full_compare(a, b, ["o_custkey"], ["n"]).select(F.coalesce("n_a", F.lit(0.0)).alias("a"), F.coalesce("n_b", F.lit(0.0)).alias("b"))
    near = (F.col("a") <= 6) & (F.col("b") <= 6)
    return c.agg(F.round(F.corr("a", "b"), 3).alias("r_all"), F.round(F.corr(F.when(near, F.col("a")), F.when(near, F.col("b"))), 3).alias("r_near"), F.count(F.when(near, 1)).alias("n_near"))


def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.lit(1).alias("n"))
    x = ct.chi_square(rows, ["l_suppkey"], "l_returnflag", "l_linestatus", "n")
    return x.select("l_suppkey", c_round(F.col("chi2"), 6).alias("chi2"), F.col("dof").cast("long").alias("dof"))


def fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.pmod(F.col("p_partkey") * 7919, F.lit(1009)).cast("double") / 1009 * F.pmod(F.col("p_partkey") * 104729, F.lit(997)) / 997).alias("p"))
    return ct.bh_fdr(p, "p", "q").select("p_partkey", c_round(F.col("q"), 9).alias("q"))


_HALF = """
o AS (SELECT o_custkey, o_orderkey % 2 AS h, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
f AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.n AS n_a, b.n AS n_b
      FROM (SELECT * FROM o WHERE h = 0) a FULL JOIN (SELECT * FROM o WHERE h = 1) b ON a.o_custkey = b.o_custkey),
z AS (SELECT *, coalesce(n_a, 0) AS a, coalesce(n_b, 0) AS b FROM f),
df AS (SELECT o_custkey, n_a, n_b, greatest(a, b) - least(a, b) AS abs_diff,
              CASE WHEN a = b THEN 0.0::DOUBLE WHEN least(a, b) = 0 THEN -1.0::DOUBLE ELSE round((greatest(a, b) - least(a, b)) / least(a, b), 2) END AS ratio_diff FROM z)
"""
_SEG = "g AS (SELECT c_nationkey, c_mktsegment, count(*)::DOUBLE AS n FROM customer GROUP BY 1, 2)"
_PIVOT = "pv AS (SELECT c_nationkey, " + ", ".join(f"coalesce(max(CASE WHEN c_mktsegment = '{s}' THEN n END), 0.0::DOUBLE) AS \"{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM g GROUP BY c_nationkey)"

QUERIES: dict[str, Query] = {
    "sj_support_counts": (support, f"WITH {_SUPPORT} SELECT event_type, bucket, n_perfect, n_all FROM sup"),
    "high_confidence_filter": (confident, f"""
WITH {_SUPPORT}, t AS (SELECT *, CASE event_type WHEN 'view' THEN 2 WHEN 'error' THEN 0 ELSE 1 END AS tag FROM sup)
SELECT event_type, bucket, tag = 2 OR (tag = 1 AND n_perfect >= 2 AND n_perfect >= n_all * 0.7::DOUBLE) AS is_hc FROM t"""),
    "strand_vote": (strand_votes, """
WITH e AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS e0, bool_or(l_returnflag = 'R') AS e1 FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN e0 AND NOT e1 THEN '0' WHEN e1 AND NOT e0 THEN '1' ELSE 'x' END AS strand FROM e"""),
    "best_record_dedupe": (best, """
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_partkey, l_suppkey FROM r WHERE k = 1"""),
    "proportional_split": (split, """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_discount * 100) AS BIGINT) AS w FROM lineitem)
SELECT *, printf('%.2f', 7.0::DOUBLE * CASE WHEN sum(w) OVER k = 0 THEN 1.0::DOUBLE / count(*) OVER k ELSE w::DOUBLE / (sum(w) OVER k)::DOUBLE END)::DOUBLE AS share
FROM r WINDOW k AS (PARTITION BY l_orderkey)"""),
    "cpm_normalize": (cpm, f"WITH {_SEG} SELECT c_nationkey, c_mktsegment, n, printf('%.2f', n * 1e6::DOUBLE / sum(n) OVER (PARTITION BY c_mktsegment))::DOUBLE AS cpm FROM g"),
    "full_outer_compare": (compare, f"WITH {_HALF} SELECT * FROM df"),
    "set_diff_compare": (set_difference, """
WITH s AS (SELECT o_custkey, o_orderkey % 2 AS h, list_sort(list(DISTINCT o_orderpriority)) AS x FROM orders GROUP BY 1, 2),
f AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.x, []) AS a, coalesce(b.x, []) AS b
      FROM (SELECT * FROM s WHERE h = 0) a FULL JOIN (SELECT * FROM s WHERE h = 1) b ON a.o_custkey = b.o_custkey),
d AS (SELECT o_custkey, list_filter(a, lambda v: NOT list_contains(b, v)) AS oa, list_filter(b, lambda v: NOT list_contains(a, v)) AS ob, list_filter(a, lambda v: list_contains(b, v)) AS bo FROM f)
SELECT o_custkey, coalesce(array_to_string(oa, ','), '') AS only_a, coalesce(array_to_string(ob, ','), '') AS only_b, coalesce(array_to_string(bo, ','), '') AS both FROM d WHERE len(oa) + len(ob) > 0"""),
    "max_diff": (largest_difference, """
WITH o AS (SELECT o_custkey, o_orderpriority, sum(CAST(o_orderkey % 2 = 0 AS DOUBLE)) AS a, sum(CAST(o_orderkey % 2 = 1 AS DOUBLE)) AS b FROM orders GROUP BY 1, 2),
d AS (SELECT o_custkey, greatest(a, b) - least(a, b) AS ad, CASE WHEN a = b THEN 0.0::DOUBLE WHEN least(a, b) = 0 THEN -1.0::DOUBLE ELSE round((greatest(a, b) - least(a, b)) / least(a, b), 2) END AS rd FROM o)
SELECT o_custkey, max(ad) AS max_abs, max(rd) AS max_ratio, count(*) AS n FROM d GROUP BY 1"""),
    "pearson_zoom": (pearson, f"""
WITH {_HALF} SELECT round(corr(a, b), 3) AS r_all, round(corr(CASE WHEN a <= 6 AND b <= 6 THEN a END, CASE WHEN a <= 6 AND b <= 6 THEN b END), 3) AS r_near,
count(CASE WHEN a <= 6 AND b <= 6 THEN 1 END) AS n_near FROM z"""),
    "chi_square_stat": (chi_square, """
WITH c AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT l_suppkey, l_returnflag, sum(o) AS r FROM c GROUP BY 1, 2), k AS (SELECT l_suppkey, l_linestatus, sum(o) AS c FROM c GROUP BY 1, 2),
t AS (SELECT l_suppkey, sum(o) AS t FROM c GROUP BY 1),
s AS (SELECT r.l_suppkey, count(DISTINCT l_returnflag) AS nr, count(DISTINCT l_linestatus) AS nc FROM r JOIN k ON r.l_suppkey = k.l_suppkey GROUP BY 1),
g AS (SELECT r.l_suppkey, r.r * k.c / t.t AS e, coalesce(c.o, 0) AS o, (nr - 1) * (nc - 1) AS dof FROM r JOIN k ON r.l_suppkey = k.l_suppkey JOIN t ON t.l_suppkey = r.l_suppkey JOIN s ON s.l_suppkey = r.l_suppkey
      LEFT JOIN c ON c.l_suppkey = r.l_suppkey AND c.l_returnflag = r.l_returnflag AND c.l_linestatus = k.l_linestatus),
d AS (SELECT *, CASE WHEN dof = 1 THEN abs(o - e) - least(abs(o - e), 0.5) ELSE abs(o - e) END AS x FROM g)
SELECT l_suppkey, printf('%.6f', sum(x * x / e))::DOUBLE AS chi2, CAST(any_value(dof) AS BIGINT) AS dof FROM d GROUP BY 1"""),
    "bh_fdr": (fdr, """
WITH p AS (SELECT p_partkey, (p_partkey * 7919 % 1009)::DOUBLE / 1009 * (p_partkey * 104729 % 997) / 997 AS p FROM part),
k AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM p)
SELECT p_partkey, printf('%.9f', least(1.0::DOUBLE, min(p * m / r) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))::DOUBLE AS q FROM k"""),
}
