"""Isoforms specific to a sample: a chi-square test for each gene, then a binomial one for each isoform and sample."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts
from ..storage import stored


def run(abundance: DataFrame, gene_cutoff: float = 0.05, cutoff: float = 0.05) -> DataFrame:
    """gene_id, transcript_id, sample, raw_read_count, proportion_global, proportion_sample, p_value, p_adj below cutoff.

    Genes: one id, known, several isoforms, at least two samples with reads, and more reads than
    four times the chi-square quantile. Gene p values are adjusted (Benjamini-Hochberg) before the
    cutoff; the isoforms' over all tests of the genes that pass. Counts are taken as whole reads.
    """
    rows = abundance.where(F.col("gene_id").isNotNull() & (F.col("gene_id") != "NA") & ~F.col("gene_id").contains(","))
    rows = rows.groupBy("gene_id", "transcript_id", "sample").agg(F.round(F.sum("count")).cast("long").alias("n"))
    used = rows.groupBy("gene_id", "transcript_id").agg(F.sum("n").alias("t")).where("t > 0")
    rows = stored(rows.join(used.drop("t"), ["gene_id", "transcript_id"], "left_semi"))
    by_sample = rows.groupBy("gene_id", "sample").agg(F.sum("n").alias("t")).where("t > 0")
    shape = by_sample.groupBy("gene_id").agg(F.count("*").alias("samples"), F.sum("t").alias("total")).join(rows.groupBy("gene_id").agg(F.count_distinct("transcript_id").alias("isoforms")), "gene_id")
    shape = shape.where("samples >= 2 and isoforms >= 2")
    live = rows.join(by_sample.select("gene_id", "sample"), ["gene_id", "sample"], "left_semi").join(shape, "gene_id")
    chi = counts.chi_square(live, ["gene_id"], "transcript_id", "sample", "n").join(shape.select("gene_id", "total"), "gene_id")

    def tail(batches):
        for b in batches:
            ok = [t > 4 * counts.chi2_ppf(1 - gene_cutoff, d) if d > 0 else False for t, d in zip(b.total, b.dof, strict=True)]
            b = b[pd.Series(ok, index=b.index, dtype=bool)]
            yield pd.DataFrame({"gene_id": b.gene_id, "gene_p": [counts.chi2_sf(float(c), float(d)) for c, d in zip(b.chi2, b.dof, strict=True)]})

    p = stored(chi.mapInPandas(tail, "gene_id string, gene_p double"))
    good = counts.bh_fdr(p, "gene_p", "gene_q").where(F.col("gene_q") < gene_cutoff).select("gene_id")
    iso = rows.join(good, "gene_id", "left_semi")
    total = iso.groupBy("gene_id").agg(F.sum("n").alias("gene_total"))
    of_iso = iso.groupBy("gene_id", "transcript_id").agg(F.sum("n").alias("iso_total"))
    of_sample = iso.groupBy("gene_id", "sample").agg(F.sum("n").alias("sample_total")).where("sample_total > 0")
    test = iso.join(of_sample, ["gene_id", "sample"]).join(of_iso, ["gene_id", "transcript_id"]).join(total, "gene_id")
    test = test.withColumns({"proportion_global": F.col("iso_total") / F.col("gene_total"), "proportion_sample": F.col("n") / F.col("sample_total")})

    @F.pandas_udf("double")
    def binomial(k: pd.Series, n: pd.Series, share: pd.Series) -> pd.Series:
        return pd.Series(counts.binomial_sf(k.to_numpy(), n.to_numpy(), share.to_numpy()))

    test = stored(test.withColumn("p_value", binomial("n", "sample_total", "proportion_global")))
    out = counts.bh_fdr(test, "p_value", "p_adj").where(F.col("p_adj") < cutoff)
    return out.select("gene_id", "transcript_id", "sample", F.col("n").alias("raw_read_count"), "proportion_global", "proportion_sample", "p_value", "p_adj")
