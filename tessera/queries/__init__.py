"""Every operator on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog() -> dict[str, Query]:
    from . import chains, counts, files, intervals, sequences, steps

    return intervals.QUERIES | chains.QUERIES | counts.QUERIES | sequences.QUERIES | steps.QUERIES | files.QUERIES
