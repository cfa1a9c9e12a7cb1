"""Ids, attributes and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sj_id(chrom: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    return F.concat_ws(":", chrom, start.cast("string"), end.cast("string"), *([strand] if strand is not None else []))


def split_sj(sj: Column) -> Column:
    """struct<chr, start, end, strand>; strand null where the id has none."""
    return sj_parts(F.split(sj, ":"))


def sj_parts(parts: Column) -> Column:
    """split_sj of an id that is split already."""
    part = lambda i: F.try_element_at(parts, F.lit(i))
    return F.struct(part(1).alias("chr"), part(2).try_cast("int").alias("start"), part(3).try_cast("int").alias("end"), part(4).alias("strand"))


def strip_strand(sj: Column) -> Column:
    return F.substring_index(sj, ":", 3)


def gtf_attribute(attributes: Column, name: str) -> Column:
    """Value of a quoted or bare GTF attribute, null where absent."""
    bounded = rf'(?:^|;)\s*{re.escape(name)}\s+"?([^";]*)"?'
    return F.nullif(F.regexp_extract(attributes, bounded, 1), F.lit(""))


def na(value: Column) -> Column:
    """null for the text NA."""
    return F.nullif(value, F.lit("NA"))


def coords_signature(strand: Column, starts: Column, ends: Column) -> Column:
    """Key of an isoform's structure: strand and internal boundaries; both ends where there is one exon."""
    n = F.size(starts)
    inner = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array(F.element_at(ends, i), F.element_at(starts, i + 1))))
    return F.concat_ws(",", strand, F.when(n == 1, F.array(F.element_at(starts, 1), F.element_at(ends, 1)).cast("array<string>")).otherwise(inner.cast("array<string>")))


def matches_target_gene(target: str, name: Column, gene: Column) -> Column:
    """name is `target-<digits>`, or gene without its version is target."""
    return F.coalesce(name.rlike(f"^{re.escape(target)}-[0-9]+$"), F.lit(False)) | F.coalesce(F.substring_index(gene, ".", 1) == target, F.lit(False))


def sample_order(name: Column) -> list[Column]:
    """Sort keys: numeric value (0 for other names), then the name."""
    return [F.coalesce(name.try_cast("double"), F.lit(0.0)), name]


def parse_version(text: str) -> tuple[int, ...]:
    """First dotted run of numbers in text; error if there is none."""
    m = re.search(r"\d+(?:\.\d+)*", text)
    if not m:
        raise ValueError(f"no version in {text!r}")
    return tuple(map(int, m[0].split(".")))


def version_at_least(version: str, least: str) -> bool:
    a, b = parse_version(version), parse_version(least)
    n = max(len(a), len(b))
    return a + (0,) * (n - len(a)) >= b + (0,) * (n - len(b))


def output_prefix(path: str) -> str:
    """Base name of a path without its last extension."""
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return base.rsplit(".", 1)[0] if "." in base else base
