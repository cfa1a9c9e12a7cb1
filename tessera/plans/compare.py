"""Compare two runs: abundances, novel isoforms by structure, reads' isoforms, genes, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import coords_signature
from ..operators import counts


def keyed_structures(structures: DataFrame) -> DataFrame:
    """structures with starts, ends and the signature that identifies them in another run."""
    starts = F.concat(F.array(F.col("start0").cast("int")), F.transform("chain", lambda j: j["end"]))
    ends = F.concat(F.transform("chain", lambda j: j["start"]), F.array(F.col("end").cast("int")))
    return structures.withColumns({"starts": starts, "ends": ends}).withColumn("signature", coords_signature(F.col("strand"), F.col("starts"), F.col("ends")))


def annotated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Abundances (transcript_id, gene_id, sample, count) side by side, by id and sample."""
    out = counts.full_compare(a, b, ["transcript_id", "gene_id", "sample"], ["count"])
    return counts.with_differences(out, "count")


def novel(a: DataFrame, a_structures: DataFrame, b: DataFrame, b_structures: DataFrame) -> DataFrame:
    """Novel isoforms side by side, by chromosome and structure; id_a, id_b null where a run has none."""
    side = lambda ab, st, x: ab.join(keyed_structures(st.where("source = 'novel_isoform'")).select("transcript_id", "chr", "signature"), "transcript_id").groupBy("chr", "signature", "sample").agg(F.min("transcript_id").alias(f"id_{x}"), F.sum("count").alias(f"count_{x}"))
    out = side(a, a_structures, "a").join(side(b, b_structures, "b"), ["chr", "signature", "sample"], "full_outer")
    return counts.with_differences(out, "count")


def reads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reads (read_id, sample, isoforms) that the runs assign differently: only_a, only_b, both."""
    key = F.concat_ws("\t", "sample", "read_id").alias("key")
    gather = lambda d: d.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("isoforms")))).alias("isoforms"))
    out = counts.set_compare(gather(a), gather(b), "key", "isoforms")
    return out.select(F.substring_index("key", "\t", 1).alias("sample"), F.substring_index("key", "\t", -1).alias("read_id"), "only_a", "only_b", "both")


def genes(compared: DataFrame, gene_of: DataFrame | None = None) -> DataFrame:
    """Compared abundances summed by gene; an isoform of several genes (comma-separated) counts for each. Null where no row has a value."""
    rows = compared if gene_of is None else compared.drop("gene_id").join(gene_of, "transcript_id", "left")
    each = rows.select(F.explode(F.split(F.coalesce("gene_id", F.lit("NA")), ",")).alias("gene_id"), "sample", "count_a", "count_b")
    return counts.with_differences(each.groupBy("gene_id", "sample").agg(F.sum("count_a").alias("count_a"), F.sum("count_b").alias("count_b")), "count")


def per_transcript(compared: DataFrame, id_column: str = "transcript_id") -> DataFrame:
    """Largest absolute and relative difference over samples, and how many samples differ."""
    return compared.groupBy(id_column).agg(F.max("abs_diff").alias("max_abs_diff"), F.max("ratio_diff").alias("max_ratio_diff"), F.sum((F.col("abs_diff") > 0).cast("long")).alias("n_diff"))


def correlation(compared: DataFrame, near: float = 1000.0) -> DataFrame:
    """Pearson's r by sample, over all rows and over those at most `near` in both; missing values are 0."""
    a, b = F.coalesce("count_a", F.lit(0.0)), F.coalesce("count_b", F.lit(0.0))
    close = (a <= near) & (b <= near)
    return compared.groupBy("sample").agg(F.round(F.corr(a, b), 3).alias("r"), F.round(F.corr(F.when(close, a), F.when(close, b)), 3).alias("r_near"))


def histogram(differences: DataFrame, column: str, width: float, top: float) -> DataFrame:
    """(bin, n) of a difference in bins of width; what exceeds top is in the last."""
    b = F.floor(F.least(F.col(column), F.lit(top)) / width).cast("long")
    return differences.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def parse_pairs(log: DataFrame) -> DataFrame:
    """(kind, key, value) of sources.results.read_comparison_log."""
    return log.select("kind", F.explode("fields").alias("key", "value"))
