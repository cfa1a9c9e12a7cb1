"""Readers of earlier results: abundance matrices, compatible isoforms, corrected reads, comparison logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import na, sj_parts

IDS = ("transcript_ID", "transcript_name", "gene_ID")
FIELDS = 13  # of a line of corrected reads, at most


def read_abundance(spark: SparkSession, path: str) -> DataFrame:
    """(transcript_id, transcript_name, gene_id, sample, count) of a tab-separated matrix; error for another header or a cell that isn't a number."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if tuple(rows.columns[:3]) != IDS:
        raise ValueError(f"unexpected header {rows.columns}")
    samples = rows.columns[3:]
    long = rows.unpivot([F.col(f"`{c}`") for c in IDS], [F.col(f"`{s}`") for s in samples], "sample", "value")
    n = F.col("value").try_cast("double")
    count = F.when(F.col("value").isNotNull() & n.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.col("value"))).cast("double")).otherwise(n)
    return long.select(F.col(IDS[0]).alias("transcript_id"), na(F.col(IDS[1])).alias("transcript_name"), na(F.col(IDS[2])).alias("gene_id"), "sample", count.alias("count"))


def read_compatible(spark: SparkSession, path: str, novel_prefix: str = "TSR:") -> DataFrame:
    """(read_id, sample, class, isoforms sorted, is_novel, chr of the first novel isoform)."""
    rows = spark.read.csv(path, sep="\t", schema="read_id string, sample string, class string, isoforms string")
    items = F.array_sort(F.filter(F.split(F.coalesce(na(F.col("isoforms")), F.lit("")), ","), lambda x: x != ""))
    novel = F.filter(items, lambda x: x.startswith(novel_prefix))
    chrom = F.try_element_at(F.split(F.try_element_at(novel, F.lit(1)), ":"), F.lit(2))
    return rows.select("read_id", "sample", "class", items.alias("isoforms"), (F.size(novel) > 0).alias("is_novel"), chrom.alias("chr"))


def read_corrected(spark: SparkSession, path: str) -> DataFrame:
    """One row per read of the long feature table: scalars and its junctions in order (0 first, -1 last).

    Lines are gathered by read as they are, each text once, and taken apart then. Fields have no quotes.
    """
    text = spark.read.text(path).where(F.trim("value") != "")
    value = F.rtrim(F.substring_index("value", "\t", FIELDS), F.lit("\t"))  # the same for lines of the same fields
    lines = text.groupBy(F.nullif(F.substring_index("value", "\t", 1), F.lit("")).alias("read_id")).agg(F.collect_set(value).alias("x"))
    lines = lines.select("read_id", F.transform("x", lambda v: F.split(v, "\t")).alias("x"))
    field = lambda p, i: F.nullif(F.get(p, F.lit(i)), F.lit(""))
    is_sj = lambda p: F.coalesce(F.get(p, F.lit(1)) == "SJ", F.lit(False))
    lines = lines.select("read_id", F.filter("x", lambda p: ~is_sj(p)).alias("x"), F.filter("x", is_sj).alias("j"))
    of = lambda f, into: F.array_max(F.transform(F.filter("x", lambda p: F.get(p, F.lit(1)) == f), into))
    one = lambda f, i=2: of(f, lambda p: field(p, i))
    end = lambda f: of(f, lambda p: F.struct(F.get(p, F.lit(3)).try_cast("int").alias("orig"), field(p, 6).alias("status"), F.get(p, F.lit(7)).try_cast("int").alias("corr")))

    def parts(p: Column) -> Column:
        get = lambda i: F.get(p, F.lit(i))
        at, corr = get(2).try_cast("int"), get(7)
        return F.struct(F.when(at == -1, F.lit(2**30)).otherwise(at).alias("ord"), F.split(field(p, 3), ":").alias("orig"), field(p, 6).alias("status"), F.when((corr != "NA") & (corr != ""), F.split(corr, ":")).alias("corr"), get(10).try_cast("double").alias("score"))

    def junction(x: Column) -> Column:
        return F.struct(x["ord"].alias("ord"), sj_parts(x["orig"]).alias("orig"), x["status"].alias("status"), F.when(x["corr"].isNotNull(), sj_parts(x["corr"])).alias("corr"), x["score"].alias("score"))

    sjs = F.array_sort(F.transform(F.transform("j", parts), junction))
    return lines.select("read_id", one("group_ID").cast("int").alias("group_id"), one("group_ID", 4).alias("sample"), one("strand_isoform").alias("strand_isoform"), one("strand_read").alias("strand_read"), one("chr").alias("chr"), one("mapq").cast("int").alias("mapq"), one("flag").cast("int").alias("flag"), one("mapped_length_read").cast("int").alias("mapped_length"), end("start").alias("start"), end("end").alias("end"), sjs.alias("sjs"))


def read_comparison_log(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, fields map) of lines `<kind> key: value, key: value`; a line of no kind is an error."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    kind = F.regexp_extract("value", "^(" + "|".join(map(re.escape, kinds)) + r")\b", 1)
    checked = F.when(kind == "", F.raise_error(F.concat(F.lit("unknown line: "), F.col("value"))).cast("string")).otherwise(kind)
    return rows.select(checked.alias("kind"), F.str_to_map(F.trim(F.regexp_replace("value", r"^\w+\s*", "")), F.lit(", "), F.lit(": ")).alias("fields"))


def read_gene_map(spark: SparkSession, path: str) -> DataFrame:
    """(transcript_id, gene_id) of a GTF's transcript lines."""
    from .annotation import read_gtf
    from ..functions.names import gtf_attribute

    g = read_gtf(spark, path).where("feature = 'transcript'")
    return g.select(gtf_attribute(F.col("attributes"), "transcript_id").alias("transcript_id"), na(gtf_attribute(F.col("attributes"), "gene_id")).alias("gene_id")).distinct()


def find_outputs(spark: SparkSession, folders: list[str], ending: str = "_read_final.txt") -> list[str]:
    """Paths below folders with that ending, in order, by Spark's own file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").load(folders)
    return [r.path for r in files.select("path").orderBy("path").toLocalIterator()]
