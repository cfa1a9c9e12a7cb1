"""Sequence and flag functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: intron's first and last two bases -> strand digit (0 forward, 1 reverse).
MOTIF_STRAND = {"GTAG": "0", "GCAG": "0", "ATAC": "0", "CTAC": "1", "CTGC": "1", "GTAT": "1"}


def flag_bit(flag: Column, bit: int) -> Column:
    """Bit `bit` (counted from 1) of a SAM flag, as boolean."""
    return flag.bitwiseAND(F.lit(1 << (bit - 1))) != 0


def is_reverse(flag: Column) -> Column:
    return flag_bit(flag, 5)


def is_unmapped(flag: Column) -> Column:
    return flag_bit(flag, 3)


def is_secondary(flag: Column) -> Column:
    return flag_bit(flag, 9)


def comp_rev(seq: Column) -> Column:
    """Reverse complement; letters other than A, C, G and T stay."""
    return F.reverse(F.translate(seq, "ATCG", "TAGC"))


def hamming(a: Column, b: Column) -> Column:
    """Number of positions that differ, case ignored; null where lengths differ."""
    pairs = F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def motif_strand(first2: Column, last2: Column) -> Column:
    """Strand digit of a splice motif, null for none."""
    out = F.lit(None).cast("string")
    for motif, strand in MOTIF_STRAND.items():
        out = F.when(F.concat(first2, last2) == motif, strand).otherwise(out)
    return out


def strand_symbol(digit: Column) -> Column:
    return F.when(digit == "0", "+").when(digit == "1", "-").otherwise(".")


def strand_vote(evidence0: Column, evidence1: Column) -> Column:
    """0 or 1 where only that strand has evidence, else x."""
    return F.when(evidence0 & ~evidence1, "0").when(evidence1 & ~evidence0, "1").otherwise("x")
