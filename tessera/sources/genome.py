"""Reference sequences, cut in tiles so that a chromosome is never one row's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = 1 << 14


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chr, seq, len): the name is the first word, letters are upper case. Error for a file without a sequence."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    name = F.split(lines[0], r"\s+")[0]
    seq = F.upper(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""))
    out = records.select(name.alias("chr"), seq.alias("seq"))
    out = out.where(F.col("chr") != "").withColumn("len", F.length("seq"))
    if out.isEmpty():
        raise ValueError(f"no sequence in {path}")
    return out


def tiles(genome: DataFrame, width: int = TILE) -> DataFrame:
    """(chr, tile, part): part has bases tile * width up to the next tile."""
    n = F.greatest(F.ceil(F.col("len") / width), F.lit(1)).cast("int")
    each = genome.select("chr", F.explode(F.sequence(F.lit(0), n - 1)).alias("tile"), "seq")
    return each.select("chr", "tile", F.substring("seq", F.col("tile") * width + 1, F.lit(width)).alias("part"))


def windows(spans: DataFrame, genome_tiles: DataFrame, key: str, width: int = TILE) -> DataFrame:
    """(key, seq) of spans (key, chr, s, e; 0-based, half-open): tiles are joined by (chr, tile) and put together in order.

    Distinct spans are looked up once. Bases outside the chromosome are left out.
    """
    want = spans.select(key, "chr", "s", "e").where("e > s")
    want = want.withColumn("tile", F.explode(F.sequence(F.floor(F.greatest(F.col("s"), F.lit(0)) / width).cast("int"), F.floor((F.col("e") - 1) / width).cast("int"))))
    got = want.join(genome_tiles, ["chr", "tile"])
    low, high = F.greatest(F.col("s") - F.col("tile") * width, F.lit(0)), F.least(F.col("e") - F.col("tile") * width, F.lit(width))
    part = F.struct("tile", F.substring("part", low + 1, high - low).alias("x"))
    return got.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"]), "").alias("seq"))


def chromosome_order(genome: DataFrame) -> DataFrame:
    """(chr, len, rank) by name."""
    return genome.select("chr", "len").withColumn("rank", F.row_number().over(Window.orderBy("chr")))


def check_known(chrom: Column, known: Column, read_id: Column) -> Column:
    """chrom, or an error that names the read where known is null."""
    return F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown chromosome "), chrom, F.lit(" of read "), read_id))).otherwise(chrom).cast("string")
