"""Reads, transcripts and alignments made alike in both engines from line items: an order is a read, its lines are junctions.

Line i of an order is a junction at 1000 * (i + order % 3), moved a little by its part and supplier,
so that orders share chains, contain each other's, and end near each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import table

#: rd: every order; tx: orders taken as annotation; r: the others, as reads; sj, asj, rsj: their junctions.
SQL = """
x AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey % 2 AS p, l_suppkey % 2 AS q FROM lineitem),
sj AS (SELECT k, i, 'c' || (k % 5) AS chr, 1000 * (i + k % 3) + 10 * q AS s, 1000 * (i + k % 3) + 500 + 10 * p AS e FROM x),
rd AS (SELECT k, count(*) AS n, 'c' || (k % 5) AS chr, k % 5 AS group_id, CAST(k % 5 % 2 AS VARCHAR) AS digit, CASE WHEN k % 5 % 2 = 0 THEN '+' ELSE '-' END AS sign,
  's' || (k % 2) AS sample, 1000 * (k % 3) + 495 + 2 * (k % 13) AS st, 1000 * (count(*) + k % 3 + 1) - 5 + k % 13 AS en,
  array_to_string(list(s || '-' || e ORDER BY i), ',') AS chain, list(s * 100000 + e ORDER BY i) AS ids, list(e ORDER BY i) AS es, list(s ORDER BY i) AS ss FROM sj GROUP BY k),
tx AS (SELECT * FROM rd WHERE k % 4 = 0), r AS (SELECT * FROM rd WHERE k % 4 <> 0),
asj AS (SELECT * FROM sj WHERE k % 4 = 0), rsj AS (SELECT * FROM sj WHERE k % 4 <> 0)
"""
JUNCTIONS = "array<struct<start:int,end:int,strand:string>>"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, chr, group_id, strand digit, sample, start (1-based), end, sjs) of every order."""
    k = F.col("l_orderkey")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")  # one shuffle and sort, and no lists kept by key
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(own).alias("i"))
    digit = (k % 5 % 2).cast("string")
    base = 1000 * (F.col("i") + k % 3)
    place = F.struct((base + 10 * (F.col("l_suppkey") % 2)).cast("int").alias("start"), (base + 500 + 10 * (F.col("l_partkey") % 2)).cast("int").alias("end"), digit.alias("strand"))
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("l_orderkey", "i", F.collect_list(place).over(every).cast(JUNCTIONS).alias("sjs")).where("i = 1")

    chrom, sample = F.concat(F.lit("c"), (k % 5).cast("string")), F.concat(F.lit("s"), (k % 2).cast("string"))
    start, end = 1000 * (k % 3) + 495 + 2 * (k % 13), 1000 * (F.size("sjs") + k % 3 + 1) - 5 + k % 13
    return rows.select(k.alias("k"), chrom.alias("chr"), (k % 5).cast("long").alias("group_id"), digit.alias("strand"), sample.alias("sample"), start.cast("int").alias("start"), end.cast("int").alias("end"), "sjs")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders not divisible by 4, as plans.quantify takes reads."""
    return orders(spark, sf_dir).where("k % 4 <> 0").withColumns({"rid": F.col("k"), "read_id": F.concat(F.lit("r"), F.col("k").cast("string"))})


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of orders divisible by 4, as sources.annotation.read_exons gives them."""
    o = orders(spark, sf_dir).where("k % 4 = 0")
    begins = F.concat(F.array((F.col("start") - 1).cast("int")), F.transform("sjs", lambda j: j["end"]))
    ends = F.concat(F.transform("sjs", lambda j: j["start"]), F.array("end"))
    each = o.select("k", "chr", "strand", F.explode(F.arrays_zip(begins.alias("s"), ends.alias("e"))).alias("x"))
    name = lambda letter, of: F.concat(F.lit(letter), of.cast("string"))
    sign = F.when(F.col("strand") == "0", "+").otherwise("-")
    return each.select("chr", F.lit("made").alias("source"), F.col("x.s").alias("start0"), F.col("x.e").alias("end"), sign.alias("strand"), name("g", F.col("k") % 10).alias("gene_id"), name("t", F.col("k")).alias("transcript_id"), name("G", F.col("k") % 10).alias("gene_name"), name("T", F.col("k")).alias("transcript_name"))


def text(chain: Column) -> Column:
    """A chain of junctions as `start-end,start-end`."""
    return F.array_join(F.transform(chain, lambda j: F.concat_ws("-", j["start"].cast("string"), j["end"].cast("string"))), ",")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as the scan has them after parsing: exon and intron lengths, read positions and errors by junction."""
    r = reads(spark, sf_dir)
    at = F.col("start") - 1
    parts = F.flatten(F.transform("sjs", lambda j, i: F.array((j["start"] - F.when(i == 0, at).otherwise(F.get(F.col("sjs"), i - 1)["end"])).cast("int"), j["end"] - j["start"])))
    lengths = F.concat(parts, F.array((F.col("end") - F.element_at("sjs", -1)["end"]).cast("int")))
    s = F.struct(lengths.alias("exon_intron"), F.transform("sjs", lambda j, i: ((i + 1) * 7).cast("int")).alias("sj_read_pos"), F.lit(500).alias("read_length"), F.array(F.lit(0), F.lit(0)).alias("clips"))
    errors = F.transform("sjs", lambda j, i: F.struct(F.when((F.col("k") + i + 1) % 3 == 0, 1).otherwise(0).alias("ins"), F.lit(0).alias("del"), F.lit(0).alias("sub")))
    background = F.struct(F.lit(1).alias("ins"), F.lit(1).alias("del"), F.lit(1).alias("sub"), F.lit(400).alias("total"))
    return r.select("k", (F.col("k") % 2).cast("int").alias("file_id"), F.struct(F.lit(0).cast("long").alias("block"), F.col("k").alias("row")).alias("line"), "group_id", "read_id", "sample", "chr", F.lit(0).alias("flag"), "start", "end", F.lit(None).cast("string").alias("bases"), s.alias("s"), errors.alias("sj_errors"), background.alias("background"))
