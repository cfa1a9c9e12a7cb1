"""CIGAR parsing: whole batches at once in numpy for the summary, higher-order functions for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY = "struct<exon_intron:array<int>,read_length:int,mapped:int,mapped_n:int,insertions:int,deletions:int,max_insertion:int,clips:array<int>,sj_read_pos:array<int>>"


def tokens(cigars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, operation byte) of every operation of a batch in order; H counts as S. Null and unreadable text has none."""
    text = pc.fill_null(cigars, "").cast(pa.large_string())
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    digit = (raw >= 48) & (raw <= 57)
    at, pos = np.flatnonzero(~digit), np.flatnonzero(digit)
    row = np.searchsorted(off, at, side="right") - 1
    op = np.searchsorted(at, pos)  # the letter that follows each digit
    own = op < len(at)
    own[own] = row[op[own]] == np.searchsorted(off, pos[own], side="right") - 1
    pos, op = pos[own], op[own]
    size = np.bincount(op, weights=(raw[pos] - 48.0) * 10.0 ** (at[op] - pos - 1), minlength=len(at)).astype(np.int64)
    kind = raw[at].copy()
    good = (np.bincount(op, minlength=len(at)) > 0) & np.isin(kind, np.frombuffer(b"MIDNSHP=X", np.uint8))
    kind[kind == ord("H")] = ord("S")
    return row[good], size[good], kind[good]


def summaries(cigars: pa.Array, max_deletion: int) -> pa.StructArray:
    """SUMMARY of each CIGAR; null for null."""
    n = len(cigars)
    row, size, kind = tokens(cigars)
    of = lambda ops: np.isin(kind, np.frombuffer(ops, np.uint8))
    total = lambda mask: pa.array(np.bincount(row[mask], weights=size[mask], minlength=n).astype(np.int32))
    intron = of(b"N") | (of(b"D") & (size > max_deletion))
    small = ~intron
    aligned, reads = of(b"M=XD"), of(b"M=XSI")
    k = np.bincount(row[intron], minlength=n)
    ends = np.concatenate([[0], np.cumsum(k)])

    def before(x: np.ndarray) -> np.ndarray:
        """Sum of x over earlier operations of the row."""
        sums = np.cumsum(x) - x
        first = np.searchsorted(row, row)
        return sums - sums[first] if len(sums) else sums

    place = before(intron.astype(np.int64))
    base = np.concatenate([[0], np.cumsum(2 * k + 1)])
    slot = base[row] + 2 * place
    parts = np.bincount(slot, weights=np.where(aligned & small, size, 0), minlength=base[-1])
    parts[slot[intron] + 1] = size[intron]
    clip, seen = of(b"S"), before(aligned.astype(np.int64)) > 0
    clips = np.stack([np.bincount(row[m], weights=size[m], minlength=n) for m in (clip & ~seen, clip & seen)], axis=1).astype(np.int32)
    longest = np.zeros(n, np.int32)
    np.maximum.at(longest, row[of(b"I")], size[of(b"I")])
    ints = lambda off, x: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x.astype(np.int32)))
    fields = [
        ints(base, parts), total(reads), total(aligned & small), total(aligned | intron), total(of(b"I")), total(of(b"D") & small),
        pa.array(longest), ints(np.arange(0, 2 * n + 1, 2), clips.ravel()), ints(ends, before(np.where(reads, size, 0))[intron]),
    ]
    names = ["exon_intron", "read_length", "mapped", "mapped_n", "insertions", "deletions", "max_insertion", "clips", "sj_read_pos"]
    return pa.StructArray.from_arrays(fields, names, mask=pc.is_null(cigars))


def operations(cigar: Column) -> Column:
    """array<struct<n, op>>; H counts as S."""
    n = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("int"))
    op = F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)), lambda x: F.when(x == "H", "S").otherwise(x))
    return F.zip_with(n, op, lambda a, b: F.struct(a.alias("n"), b.alias("op")))


def is_intron(op: Column, max_deletion: int) -> Column:
    return (op["op"] == "N") | ((op["op"] == "D") & (op["n"] > max_deletion))


def exon_introns(ops: Column, max_deletion: int) -> Column:
    """Alternating exon and intron lengths on the genome, beginning and ending with an exon."""
    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        head = F.slice(acc, 1, F.size(acc) - 1)
        return (
            F.when(is_intron(x, max_deletion), F.concat(acc, F.array(x["n"], F.lit(0))))
            .when(x["op"].isin("M", "=", "X", "D"), F.concat(head, F.array(last + x["n"])))
            .otherwise(acc)
        )

    return F.aggregate(ops, F.array(F.lit(0)), step)


def with_summary(df: DataFrame, cigar: str, into: str, max_deletion: int) -> DataFrame:
    """df with a SUMMARY struct: alternating exons and introns, read_length, mapped (genome bases without introns), mapped_n (with), insertions, deletions, max_insertion, clips before and after the first base on the genome, and the read bases before each intron. Null for a null CIGAR."""
    @F.arrow_udf(SUMMARY)
    def summary(x: pa.Array) -> pa.Array:
        return summaries(x, max_deletion)

    return df.withColumn(into, summary(F.col(cigar)))


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body's own lambdas read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def junctions(start: Column, exon_intron: Column) -> Column:
    """array<struct<start, end>> of introns: 0-based first base, 1-based last base; start is the alignment's 1-based start."""
    return _bound(exon_intron, lambda parts: _junctions(start, parts))


def _junctions(start: Column, exon_intron: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        exon, intron = F.element_at(exon_intron, 2 * i - 1), F.element_at(exon_intron, 2 * i)
        s = acc["at"] + exon
        return F.struct((s + intron).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), (s + intron).alias("end")))).alias("out"))

    n = (F.size(exon_intron) / 2).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    zero = F.struct((start - 1).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(index, zero, step, lambda acc: acc["out"])


def exons(start: Column, exon_intron: Column) -> Column:
    """array<struct<start, end>> of exons, 0-based half-open."""
    return _bound(exon_intron, lambda parts: _exons(start, parts))


def _exons(start: Column, exon_intron: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        exon = F.element_at(exon_intron, 2 * i - 1)
        gap = F.when(2 * i <= F.size(exon_intron), F.element_at(exon_intron, F.least(2 * i, F.size(exon_intron)))).otherwise(0)
        e = acc["at"] + exon
        return F.struct((e + gap).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), e.alias("end")))).alias("out"))

    n = ((F.size(exon_intron) + 1) / 2).cast("int")
    zero = F.struct((start - 1).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda acc: acc["out"])


def merge_equal(ops: Column) -> Column:
    """Equal neighbours joined after = and X became M."""
    def step(acc: Column, x: Column) -> Column:
        x = F.struct(x["n"].alias("n"), F.when(x["op"].isin("=", "X"), "M").otherwise(x["op"]).alias("op"))
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((last["n"] + x["n"]).alias("n"), x["op"].alias("op"))))
        return F.when(F.coalesce(last["op"] == x["op"], F.lit(False)), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ops, F.array().cast("array<struct<n:int,op:string>>"), step)


def to_string(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")
