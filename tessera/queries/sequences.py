"""Sequence, CIGAR, flag and name functions on strings made alike in both engines, and alignment of part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, names, numeric, seq
from ..operators import align, profile
from . import Query, table

_CIGAR = "CAST(l_linenumber AS VARCHAR) || 'S' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || 'M' || CAST(l_linenumber * 30 AS VARCHAR) || 'D' || CAST(CAST(l_quantity AS INT) + 3 AS VARCHAR) || '=' || CAST(l_orderkey % 7 + 1 AS VARCHAR) || 'I' || CAST(l_suppkey + 60 AS VARCHAR) || 'N' || CAST(l_linenumber AS VARCHAR) || 'X' || CAST(l_partkey % 5 + 1 AS VARCHAR) || 'H'"


def _cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    c = F.concat(text(n), F.lit("S"), text(q), F.lit("M"), text(n * 30), F.lit("D"), text(q + 3), F.lit("="), text(F.col("l_orderkey") % 7 + 1), F.lit("I"), text(F.col("l_suppkey") + 60), F.lit("N"), text(n), F.lit("X"), text(F.col("l_partkey") % 5 + 1), F.lit("H"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.alias("cigar"))


def cigar_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cigar.with_summary(_cigars(spark, sf_dir), "cigar", "s", 50)
    long = lambda c: F.col(f"s.{c}").cast("long").alias(c)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cigar", long("read_length"), long("mapped"), long("mapped_n"), long("insertions"), long("deletions"), long("max_insertion"), F.array_join(F.col("s.exon_intron").cast("array<string>"), ",").alias("exon_intron"), F.array_join(F.col("s.clips").cast("array<string>"), ",").alias("clips"))


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions of each CIGAR placed at 1-based start 1000, counted by length."""
    j = _cigars(spark, sf_dir).select(F.explode(cigar.junctions(F.lit(1000), cigar.exon_introns(cigar.operations(F.col("cigar")), 50))).alias("j"))
    return j.groupBy((F.col("j.end") - F.col("j.start")).cast("long").alias("length")).agg(F.count("*").alias("n"), F.min("j.start").cast("long").alias("first"))


def flag_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("l_partkey").cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(seq.is_reverse(f).alias("is_reverse"), seq.is_secondary(f).alias("is_secondary")).agg(F.count("*").alias("n"))


def _dna(c) -> F.Column:
    return F.translate(F.regexp_replace(F.upper(c), "[^A-Z]", ""), "BDEFHIJKLMNOPQRSUVWXYZ", "CGTACGTACGTACGTACGTACG")


def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", _dna("p_name").alias("dna"))
    rc = seq.comp_rev(F.col("dna"))
    return p.select("p_partkey", "dna", rc.alias("rc"), seq.hamming(F.col("dna"), rc).cast("long").alias("distance"))


def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(_dna(F.concat("p_name", "p_type")).alias("dna"))
    strand = seq.motif_strand(F.substring("dna", 1, 2), F.substring("dna", 2, 2))
    return p.groupBy(F.coalesce(strand, F.lit("x")).alias("strand")).agg(F.count("*").alias("n"))


def hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of each supplier's returned line items of small and middle quantity, among its first hundred."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    small, mid = F.col("l_quantity") <= 2, (F.col("l_quantity") > 2) & (F.col("l_quantity") <= 4)
    hit = F.col("l_linenumber") == 1
    c = lambda x: F.count(F.when(x, 1)).cast("int")
    a = l.groupBy("l_suppkey").agg(c(small).alias("k0"), c(mid).alias("k1"), c(small & hit).alias("h0"), c(mid & hit).alias("h1"), c(hit).alias("n"), F.count("*").cast("int").alias("t"))
    p = numeric.hypergeometric(F.array("h0", "h1"), F.array("k0", "k1"), F.col("n"), F.col("t"))
    return a.select("l_suppkey", F.col("h0").cast("long").alias("h0"), F.col("h1").cast("long").alias("h1"), numeric.c_round(p, 6).alias("p"))


def c_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") * F.col("l_discount") / 8
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numeric.c_round(x).alias("v"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures of orders as transcripts: exons are line items in order of number."""
    item = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(item.alias("x"), F.min("l_returnflag").alias("strand"))
    s = names.coords_signature(F.col("strand"), F.col("x.l_partkey"), F.col("x.l_suppkey"))
    return o.select("l_orderkey", s.alias("signature"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('gene_id "'), F.col("p_brand"), F.lit('"; transcript_id "'), F.col("p_name"), F.lit('"; exon_number '), F.col("p_size").cast("string"), F.lit(";"))
    p = table(spark, sf_dir, "part").select("p_partkey", text.alias("a"))
    return p.select("p_partkey", *[names.gtf_attribute(F.col("a"), k).alias(k) for k in ("gene_id", "transcript_id", "exon_number", "gene_name")])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, ref): each part's name with the texts of the parts of its brand and size."""
    p = table(spark, sf_dir, "part")
    key = ["p_brand", "p_size"]
    a = p.select(*key, _dna("p_name").alias("query")).distinct()
    b = p.select(*key, _dna(F.concat("p_type", "p_name", "p_type")).alias("ref")).distinct()
    return a.join(b, key).select("query", "ref").distinct()


def local_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best local alignment of each pair."""
    return align.local(_pairs(spark, sf_dir), "query", "ref")


def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each part's name, as a profile, explains the other texts, and the likeliest alignment's ends."""
    return profile.profile(_pairs(spark, sf_dir), "query", "ref")


QUERIES: dict[str, Query] = {
    "cigar_parse_lengths": (cigar_lengths, f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CIGAR} AS cigar, CAST(l_quantity AS INT) AS q, l_linenumber AS n, l_orderkey % 7 + 1 AS ins, l_suppkey + 60 AS intron, l_partkey % 5 + 1 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cigar, n + q + q + 3 + ins + n + h AS read_length,
 q + q + 3 + n + CASE WHEN n * 30 > 50 THEN 0 ELSE n * 30 END AS mapped, CAST(q + q + 3 + n + n * 30 + intron AS BIGINT) AS mapped_n, CAST(ins AS BIGINT) AS insertions,
 CAST(CASE WHEN n * 30 > 50 THEN 0 ELSE n * 30 END AS BIGINT) AS deletions, CAST(ins AS BIGINT) AS max_insertion,
 CASE WHEN n * 30 > 50 THEN concat_ws(',', q, n * 30, q + 3, intron, n) ELSE concat_ws(',', q + n * 30 + q + 3, intron, n) END AS exon_intron, concat_ws(',', n, h) AS clips
FROM (SELECT * REPLACE (CAST(n AS BIGINT) AS n, CAST(q AS BIGINT) AS q) FROM c)"""),
    "junctions_from_cigar": (junctions, """
WITH c AS (SELECT CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n, l_suppkey + 60 AS intron FROM lineitem),
j AS (SELECT 999 + q AS s, n * 30 AS len FROM c WHERE n * 30 > 50 UNION ALL SELECT 999 + q + n * 30 + q + 3, intron FROM c)
SELECT len AS length, count(*) AS n, min(s) AS first FROM j GROUP BY len"""),
    "flag_bits": (flag_bits, "SELECT (l_partkey & 16) <> 0 AS is_reverse, (l_partkey & 256) <> 0 AS is_secondary, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "reverse_complement": (complement, """
WITH d AS (SELECT p_partkey, translate(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), 'BDEFHIJKLMNOPQRSUVWXYZ', 'CGTACGTACGTACGTACGTACG') AS dna FROM part),
r AS (SELECT *, reverse(translate(dna, 'ATCG', 'TAGC')) AS rc FROM d)
SELECT p_partkey, dna, rc, CAST(hamming(dna, rc) AS BIGINT) AS distance FROM r"""),
    "motif_strand": (motifs, """
WITH d AS (SELECT translate(regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g'), 'BDEFHIJKLMNOPQRSUVWXYZ', 'CGTACGTACGTACGTACGTACG') AS dna FROM part),
m AS (SELECT substring(dna, 1, 2) || substring(dna, 2, 2) AS m FROM d)
SELECT CASE WHEN m IN ('GTAG', 'GCAG', 'ATAC') THEN '0' WHEN m IN ('CTAC', 'CTGC', 'GTAT') THEN '1' ELSE 'x' END AS strand, count(*) AS n FROM m GROUP BY 1"""),
    "hypergeometric_prob": (hypergeometric, """
WITH a AS (SELECT l_suppkey, count(CASE WHEN l_quantity <= 2 THEN 1 END) AS k0, count(CASE WHEN l_quantity > 2 AND l_quantity <= 4 THEN 1 END) AS k1,
  count(CASE WHEN l_quantity <= 2 AND l_linenumber = 1 THEN 1 END) AS h0, count(CASE WHEN l_quantity > 2 AND l_quantity <= 4 AND l_linenumber = 1 THEN 1 END) AS h1,
  count(CASE WHEN l_linenumber = 1 THEN 1 END) AS n, count(*) AS t FROM lineitem GROUP BY 1),
b AS (SELECT *, t - k0 - k1 AS k2, n - h0 - h1 AS h2 FROM a)
SELECT l_suppkey, h0, h1, printf('%.6f', exp(lgamma(k0 + 1) - lgamma(h0 + 1) - lgamma(k0 - h0 + 1) + lgamma(k1 + 1) - lgamma(h1 + 1) - lgamma(k1 - h1 + 1)
  + lgamma(k2 + 1) - lgamma(h2 + 1) - lgamma(k2 - h2 + 1) - lgamma(t + 1) + lgamma(n + 1) + lgamma(t - n + 1)))::DOUBLE AS p FROM b"""),
    "c_rounding": (c_rounding, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.2f', l_extendedprice * l_discount / 8)::DOUBLE AS v FROM lineitem"),
    "coords_signature": (signatures, """
WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS s, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS e, min(l_returnflag) AS strand FROM lineitem GROUP BY 1)
SELECT l_orderkey, strand || ',' || CASE WHEN len(s) = 1 THEN s[1] || ',' || e[1] ELSE array_to_string(flatten([[e[i], s[i + 1]] FOR i IN range(1, len(s))]), ',') END AS signature FROM o"""),
    "gtf_attributes": (attributes, "SELECT p_partkey, p_brand AS gene_id, p_name AS transcript_id, CAST(p_size AS VARCHAR) AS exon_number, CAST(NULL AS VARCHAR) AS gene_name FROM part"),
    "sw_align_score": (local_alignment, None),
    "profile_scores": (profile_scores, None),
}
