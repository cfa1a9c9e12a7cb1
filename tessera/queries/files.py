"""Sinks and sources: each query writes text below the shared folder, reads it with the library's reader, and gives the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..plans import scan
from ..sinks import text as sink
from ..sources import alignments as al
from ..sources import annotation as an
from ..sources import genome as gn
from ..sources import results as rs
from ..storage import new_path
from . import Query, derived, steps, table
from .derived import text
from .sequences import _dna


def written(lines: DataFrame) -> str:
    path = new_path(lines.sparkSession)
    sink.write_lines(lines, path)
    return path


def gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures as GTF, read back as exons and chained again; gene ids by transcript from the transcript lines."""
    path = written(sink.gtf(steps._structures(spark, sf_dir)))
    t = an.transcripts(an.read_exons(spark, path)).join(rs.read_gene_map(spark, path).withColumnRenamed("gene_id", "gene"), "transcript_id")
    return t.select("chr", "transcript_id", "gene_id", "gene", "gene_name", "strand", "start0", "end", text(F.col("chain")).alias("chain"))


def bed12(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = an.read_bed12(spark, written(sink.bed12(an.transcripts(derived.exons(spark, sf_dir)), 7)))
    return b.select("chr", "start", "end", "name", "score", "strand", text(F.col("blocks")).alias("blocks"))


def junction_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated junctions as BED with chromosome sizes, both read back."""
    j = an.annotated_from_exons(derived.exons(spark, sf_dir))
    sizes = j.groupBy("chr").agg((F.max("end") + 1).alias("len")).select(F.concat_ws("\t", "chr", F.col("len").cast("string")).alias("value"))
    lines = j.select(F.concat_ws("\t", "chr", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("j"), F.lit("0"), F.when(F.col("strand") == "0", "+").otherwise("-")).alias("value"))
    return an.read_junction_bed(spark, written(lines), an.read_chrom_sizes(spark, written(sizes)))


def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An abundance matrix with samples as columns, read back as rows."""
    path = new_path(spark)
    sink.write_matrix(sink.abundance_matrix(steps._abundance(spark, sf_dir).where("count > 0"), ["s0", "s1"]), path)
    return rs.read_abundance(spark, path)


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments of each nation as an abundance matrix."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("double").alias("count"))
    a = c.select(F.col("c_nationkey").cast("string").alias("transcript_id"), F.lit(None).cast("string").alias("transcript_name"), F.lit("g").alias("gene_id"), F.col("c_mktsegment").alias("sample"), "count")
    return sink.abundance_matrix(a, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


def compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with the isoforms that fit them, of which some are novel."""
    k = F.col("l_suppkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("TSR:c"), (k % 5).cast("string"), F.lit(":0:"), k.cast("string"))).otherwise(F.concat(F.lit("t"), k.cast("string")))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "N", name))).alias("isoforms"))
    rows = li.select(F.col("l_orderkey").cast("string").alias("read_id"), F.lit("s").alias("sample"), F.lit("NIC").alias("class"), "isoforms")
    r = rs.read_compatible(spark, written(sink.compatible(rows)))
    return r.select("read_id", "class", F.array_join("isoforms", ",").alias("isoforms"), "is_novel", "chr")


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with every third junction failed and those divisible by 4 at odd orders moved."""
    r = derived.reads(spark, sf_dir)
    def sj(j: F.Column, i: F.Column) -> F.Column:
        failed = (F.col("k") + i) % 3 == 0
        moved = F.when(F.col("k") % 2 == 1, 3).otherwise(0)
        at = lambda x: F.when(~failed, x + moved).cast("int")
        status = F.when(failed, "fail").when(moved > 0, "corrected").otherwise("pass")
        return F.struct(at(j["start"]).alias("start"), at(j["end"]).alias("end"), F.when(~failed, j["strand"]).alias("strand"), j["start"].alias("orig_start"), j["end"].alias("orig_end"), status.alias("status"), F.lit(0.5).alias("score"), (i * 7).cast("int").alias("pos"))

    return r.select("read_id", "sample", "chr", "group_id", "strand", "start", "end", F.lit(16).alias("flag"), F.transform("sjs", sj).alias("sjs"))


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected reads as the long feature table, read back as a row for each read."""
    c = rs.read_corrected(spark, written(sink.corrected_features(_corrected(spark, sf_dir))))
    part = lambda f: F.array_join(F.transform("sjs", lambda j: F.coalesce(F.concat_ws("-", j[f]["start"].cast("string"), j[f]["end"].cast("string"), j[f]["strand"]), F.lit(""))), ",")
    return c.select("read_id", "group_id", "sample", "strand_isoform", "chr", "flag", F.col("start.orig").alias("start"), F.col("end.corr").alias("end"), F.array_join(F.transform("sjs", lambda j: j["status"]), ",").alias("status"), part("orig").alias("mapped"), part("corr").alias("corrected"))


def comparison_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by key as lines of a log, read back and summed by kind."""
    from ..plans import compare

    p = table(spark, sf_dir, "part").groupBy(F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("kind"), "p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("m"))
    lines = p.select(F.concat(F.col("kind"), F.lit(" brand: "), "p_brand", F.lit(", n: "), F.col("n").cast("string"), F.lit(", largest: "), F.col("m").cast("string")).alias("value"))
    log = rs.read_comparison_log(spark, written(lines), ("even", "odd"))
    return compare.parse_pairs(log).groupBy("kind", "key", "value").agg(F.count("*").alias("n"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of input files and their samples; suppliers with an even key name their number."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    lines = s.select(F.concat(k, F.lit(".sam\tsample"), (F.col("s_suppkey") % 7).cast("string"), F.lit("\t"), k).alias("value"))
    return al.read_samples(spark, written(lines))


def sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments as SAM text with tags; read back with their tags."""
    from .sequences import _cigars

    c = _cigars(spark, sf_dir).dropDuplicates()
    name = F.concat_ws("_", *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    lines = c.select(F.concat_ws("\t", name, (F.col("l_partkey") % 17).cast("string"), F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")), F.col("l_orderkey").cast("string"), (F.col("l_linenumber") * 9).cast("string"), "cigar", F.lit("*\t0\t0\t*\t*"), F.concat(F.lit("NM:i:"), (F.col("l_suppkey") % 9).cast("string")), F.lit("ts:A:+")).alias("value"))
    a = al.read_sam(spark, [(written(spark.range(1).select(F.lit("@SQ\tSN:c0\tLN:99").alias("value")).unionByName(lines)), "s")])
    return a.select("read_id", "flag", "chr", "start", "mapq", "cigar", "seq", F.array_join("tags", ",").alias("tags"), "file_id", "sample")


def fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as FASTQ records whose qualities begin with @; read back."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("\n", F.concat(F.lit("@p"), F.col("p_partkey").cast("string")), F.regexp_replace("p_name", " ", "N"), F.lit("+"), F.regexp_replace("p_name", ".", "@")).alias("value"))
    return al.combine_fastq(spark, written(p), "*.txt")


def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments by the SAM sink, with a header line for each chromosome; read back."""
    c = derived.reads(spark, sf_dir).select("read_id", F.lit(0).alias("flag"), "chr", "start", F.lit(60).alias("mapq"), F.concat((F.col("k") % 90 + 1).cast("string"), F.lit("M")).alias("cigar"), F.lit("ACGT").alias("seq"), F.lit(None).cast("string").alias("qual"))
    chroms = spark.range(5).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chr"), F.lit(99999).alias("len"), F.col("id").alias("rank"))
    a = al.read_sam(spark, [(written(sink.sam(c, chroms)), "s")])
    return a.select("read_id", "flag", "chr", "start", "mapq", "cigar", "seq", "qual")


def _genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as chromosomes: their parts' names and types as bases, 12 times each, in order, 60 to a line."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.repeat(_dna(F.concat("p_name", "p_type")), F.lit(12)).alias("dna"))
    seq = p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "dna"))), lambda x: x["dna"]), "").alias("seq"))
    lines = seq.select(F.concat(F.lit(">"), F.regexp_replace("p_brand", "#", ""), F.lit(" made\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")).alias("value"))
    return gn.read_fasta(spark, written(lines))


def fasta_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of windows on a genome read from FASTA, put together from tiles of 64 bases."""
    g = _genome(spark, sf_dir)
    k = F.col("p_partkey")
    spans = table(spark, sf_dir, "part").select(k.alias("id"), F.regexp_replace("p_brand", "#", "").alias("chr"), (k * 7 % 300).cast("int").alias("s"), (k * 7 % 300 + F.col("p_size") * 3).cast("int").alias("e"))
    return gn.windows(spans, gn.tiles(g, 64), "id", 64).where("seq <> ''")


def flank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-confidence junctions on that genome with the bases on either side, as FASTA lines."""
    g = _genome(spark, sf_dir)
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(F.lit(3).cast("long").alias("group_id"), F.regexp_replace("p_brand", "#", "").alias("chr"), (k * 7 % 200 + 30).cast("int").alias("start"), (k * 7 % 200 + 80).cast("int").alias("end"), F.lit("0").alias("strand"), (F.col("p_size") % 2 == 0).alias("is_hc"), F.lit(1).alias("cluster_start"), F.lit(2).alias("cluster_end_key")).distinct()
    return sink.junction_fasta(scan.flanks(c, g, ScanConfig()))


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by key, summed over workers (suppliers), as lines."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("items"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("returned"), F.countDistinct("l_orderkey").alias("orders"))
    return sink.summary(per.unpivot("l_suppkey", ["items", "returned", "orders"], "counter", "n").select("counter", "n"), "count them")


def bedgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of one sample as lines of a track."""
    return sink.bedgraph(steps.sample_coverage(spark, sf_dir).where("sample = 's0'").drop("sample"), "s0", "0,0,255")["lines"]


_R = derived.SQL
_G = """sq AS (SELECT replace(p_brand, '#', '') AS chr, string_agg(repeat(translate(regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g'), 'BDEFHIJKLMNOPQRSUVWXYZ', 'CGTACGTACGTACGTACGTACG'), 12), '' ORDER BY p_partkey) AS seq FROM part GROUP BY 1)"""

QUERIES: dict[str, Query] = {
    "gtf_round_trip": (gtf, f"WITH {_R} SELECT chr, 't' || k AS transcript_id, 'g' || (k % 10) AS gene_id, 'g' || (k % 10) AS gene, 'NA' AS gene_name, sign AS strand, st - 1 AS start0, en AS \"end\", chain FROM tx"),
    "bed12_round_trip": (bed12, f"""
WITH {_R} SELECT chr, st - 1 AS start, en AS "end", 't' || k AS name, 7 AS score, sign AS strand,
array_to_string([a[1] || '-' || a[2] FOR a IN list_zip(list_concat([st - 1], es), list_concat(ss, [en]))], ',') AS blocks FROM tx"""),
    "junction_bed_round_trip": (junction_bed, f"WITH {_R} SELECT DISTINCT chr, s AS start, e AS \"end\", CAST(k % 5 % 2 AS VARCHAR) AS strand FROM asj"),
    "abundance_round_trip": (abundance, f"""
WITH {_R}, ab AS (SELECT k, 's0' AS sample, (k % 7)::DOUBLE AS n FROM tx UNION ALL SELECT k, 's1', (k % 8)::DOUBLE FROM tx)
SELECT 't' || k AS transcript_id, 'T' || k AS transcript_name, 'g' || (k % 10) AS gene_id, sample, n AS count FROM ab WHERE k % 7 > 0 OR k % 8 > 0"""),
    "abundance_pivot": (pivot, "WITH g AS (SELECT c_nationkey, c_mktsegment, count(*)::DOUBLE AS n FROM customer GROUP BY 1, 2) SELECT CAST(c_nationkey AS VARCHAR) AS transcript_ID, 'NA' AS transcript_name, 'g' AS gene_ID, "
        + ", ".join(f"printf('%.2f', coalesce(max(CASE WHEN c_mktsegment = '{s}' THEN n END), 0)) AS \"{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM g GROUP BY c_nationkey"),
    "compatible_round_trip": (compatible, """
WITH n AS (SELECT l_orderkey, CASE WHEN l_suppkey % 7 = 0 THEN 'TSR:c' || (l_suppkey % 5) || ':0:' || l_suppkey ELSE 't' || l_suppkey END AS t, l_returnflag <> 'N' AS ok FROM lineitem),
l AS (SELECT l_orderkey, coalesce(list_sort(list(DISTINCT t) FILTER (ok)), []) AS x FROM n GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS read_id, 'NIC' AS class, coalesce(array_to_string(x, ','), '') AS isoforms, len(list_filter(x, lambda v: starts_with(v, 'TSR:'))) > 0 AS is_novel, split_part(list_filter(x, lambda v: starts_with(v, 'TSR:'))[1], ':', 2) AS chr FROM l"""),
    "corrected_round_trip": (corrected, f"""
WITH {_R}, c AS (SELECT r.k, i, rsj.s, rsj.e, (r.k + i - 1) % 3 = 0 AS bad, CASE WHEN r.k % 2 = 1 THEN 3 ELSE 0 END AS m, digit FROM r JOIN rsj ON rsj.k = r.k)
SELECT 'r' || r.k AS read_id, r.group_id, r.sample, r.digit AS strand_isoform, r.chr, 16 AS flag, any_value(st) AS start, any_value(en) AS "end", array_to_string(list(CASE WHEN bad THEN 'fail' WHEN m > 0 THEN 'corrected' ELSE 'pass' END ORDER BY i), ',') AS status,
array_to_string(list(c.s || '-' || c.e ORDER BY i), ',') AS mapped, array_to_string(list(CASE WHEN bad THEN '' ELSE (c.s + m) || '-' || (c.e + m) || '-' || c.digit END ORDER BY i), ',') AS corrected FROM r JOIN c ON c.k = r.k GROUP BY r.k, r.group_id, r.sample, r.digit, r.chr"""),
    "comparison_log_round_trip": (comparison_log, """
WITH p AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, p_brand, count(*) AS n, max(p_size) AS m FROM part GROUP BY 1, 2),
x AS (SELECT kind, 'brand' AS key, p_brand AS value FROM p UNION ALL SELECT kind, 'n', CAST(n AS VARCHAR) FROM p UNION ALL SELECT kind, 'largest', CAST(m AS VARCHAR) FROM p)
SELECT kind, key, value, count(*) AS n FROM x GROUP BY 1, 2, 3"""),
    "sample_list": (samples, "SELECT s_suppkey || '.sam' AS path, 'sample' || (s_suppkey % 7) AS sample, CAST(s_suppkey AS INTEGER) AS file_id FROM supplier"),
    "sam_tags": (sam, """
WITH c AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS u, CAST(l_quantity AS INT) AS q FROM lineitem)
SELECT o || '_' || n || '_' || p || '_' || u AS read_id, p % 17 AS flag, 'c' || (u % 5) AS chr, o AS start, n * 9 AS mapq,
n || 'S' || q || 'M' || n * 30 || 'D' || (q + 3) || '=' || (o % 7 + 1) || 'I' || (u + 60) || 'N' || n || 'X' || (p % 5 + 1) || 'H' AS cigar, NULL AS seq, 'NM:i:' || (u % 9) || ',ts:A:+' AS tags, 0 AS file_id, 's' AS sample FROM c"""),
    "sam_round_trip": (sam_lines, f"WITH {_R} SELECT 'r' || k AS read_id, 0 AS flag, chr, st AS start, 60 AS mapq, (k % 90 + 1) || 'M' AS cigar, 'ACGT' AS seq, NULL AS qual FROM r"),
    "fastq_round_trip": (fastq, "SELECT 'p' || p_partkey AS name, replace(p_name, ' ', 'N') AS seq, repeat('@', length(p_name)) AS qual FROM part"),
    "fasta_windows": (fasta_windows, f"""
WITH {_G}, w AS (SELECT p_partkey AS id, replace(p_brand, '#', '') AS chr, p_partkey * 7 % 300 AS s, p_size * 3 AS n FROM part), x AS (SELECT id, substring(seq, CAST(s + 1 AS BIGINT), CAST(n AS BIGINT)) AS seq FROM w JOIN sq ON sq.chr = w.chr) SELECT * FROM x WHERE seq <> ''"""),
    "junction_flanks": (flank_lines, f"""
WITH {_G}, j AS (SELECT DISTINCT replace(p_brand, '#', '') AS chr, p_partkey * 7 % 200 + 30 AS s, p_partkey * 7 % 200 + 80 AS e FROM part WHERE p_size % 2 = 0),
f AS (SELECT j.*, substring(seq, CAST(s - 24 AS BIGINT), 25) AS l, substring(seq, CAST(e + 1 AS BIGINT), 25) AS r FROM j JOIN sq ON sq.chr = j.chr)
SELECT '>' || chr || ':' || s || ':' || e || ':0 group:3' || chr(10) || l || r AS value FROM f WHERE l <> '' AND r <> ''"""),
    "summary_counters": (summary_lines, """
WITH p AS (SELECT l_suppkey, count(*) AS items, sum(CAST(l_returnflag = 'R' AS BIGINT)) AS returned, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1)
SELECT 'count them' AS value UNION ALL SELECT 'items: ' || sum(items) FROM p UNION ALL SELECT 'returned: ' || sum(returned) FROM p UNION ALL SELECT 'orders: ' || sum(orders) FROM p"""),
    "bedgraph_lines": (bedgraph, "SELECT chr || chr(9) || seg_start || chr(9) || seg_end || chr(9) || depth AS value FROM (" + steps.QUERIES["sample_coverage"][1] + ") WHERE sample = 's0'"),
}
