"""Even shares of work: read groups dealt to jobs by their number of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.counts import balanced_bins


def jobs(reads: DataFrame, target_reads: int = 400_000) -> DataFrame:
    """(group_id, n, bin) of about target_reads each."""
    return balanced_bins(reads.groupBy("group_id").agg(F.count("*").alias("n")), "group_id", "n", target_reads)


def by_job(reads: DataFrame, assigned: DataFrame) -> DataFrame:
    """reads with their job, partitioned by it."""
    out = reads.join(assigned.select("group_id", F.col("bin").alias("job")), "group_id")
    return out.repartition("job")
