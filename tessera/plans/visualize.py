"""Normalised abundance and coverage tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import matches_target_gene
from ..operators import counts, intervals

NOVEL_COLOR, ANNOTATED_COLOR = "255,0,0", "0,0,255"


def normalize(abundance: DataFrame) -> DataFrame:
    """Counts per million of each sample."""
    return counts.per_million(abundance, "sample", "count", "cpm")


def blocks(abundance: DataFrame, structures: DataFrame, value: str = "count") -> DataFrame:
    """(sample, transcript_id, chr, start, end, w): an exon for each row, weighted by the isoform's abundance."""
    s = structures.select("transcript_id", "chr", F.concat(F.array(F.col("start0").cast("int")), F.transform("chain", lambda j: j["end"])).alias("s"), F.concat(F.transform("chain", lambda j: j["start"]), F.array(F.col("end").cast("int"))).alias("e"))
    rows = abundance.where(F.col(value) > 0).select("transcript_id", "sample", F.col(value).alias("w")).join(s, "transcript_id")
    return rows.select("sample", "transcript_id", "chr", "w", F.explode(F.arrays_zip("s", "e")).alias("x")).select("sample", "transcript_id", "chr", F.col("x.s").alias("start"), F.col("x.e").alias("end"), "w")


def sample_coverage(abundance: DataFrame, structures: DataFrame, value: str = "count") -> DataFrame:
    """(sample, chr, seg_start, seg_end, depth)."""
    return intervals.coverage_segments(blocks(abundance, structures, value), ["sample", "chr"], "start", "end", "w")


def gene_tracks(abundance: DataFrame, structures: DataFrame, target: str, minimum: float, value: str = "count") -> DataFrame:
    """Coverage of each isoform of a gene with at least `minimum` in some sample, and its colour."""
    names = abundance.where(matches_target_gene(target, F.col("transcript_name"), F.col("gene_id"))).groupBy("transcript_id").agg(F.max(value).alias("top")).where(F.col("top") >= minimum)
    mine = abundance.join(names.select("transcript_id"), "transcript_id", "left_semi")
    seg = intervals.coverage_segments(blocks(mine, structures, value), ["sample", "transcript_id", "chr"], "start", "end", "w")
    kind = structures.select("transcript_id", F.when(F.col("source") == "novel_isoform", NOVEL_COLOR).otherwise(ANNOTATED_COLOR).alias("color")).distinct()
    return seg.join(kind, "transcript_id")
