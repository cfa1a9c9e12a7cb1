"""Alignments rebuilt from corrected junctions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import seq as sq
from ..operators import align
from ..sources.genome import tiles, windows
from ..storage import stored


def placed(cigar: str, start: int) -> list[tuple[int, int]]:
    """(read base, genome base) of each aligned base of a mapped CIGAR, 0-based."""
    out, q, r = [], 0, start - 1
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            out += [(q + i, r + i) for i in range(n)]
            q, r = q + n, r + n
        elif op in "IS":
            q += n
        elif op in "DN":
            r += n
    return out


def read_cuts(cigar: str, start: int, new_start: int, new_end: int, junctions: list[tuple[int, int]]) -> tuple[int, int, list[int]] | None:
    """Read bases where the alignment begins and ends, and of each junction; null where junctions aren't in order.

    A junction cuts the read where its start is mapped, or else where its end is; outer ends follow
    the corrected coordinates into the clips.
    """
    bounds = [new_start - 1, *[x for j in junctions for x in j], new_end]
    if any(a >= b for a, b in zip(bounds[:-1], bounds[1:], strict=True)):
        return None
    base = placed(cigar, start)
    if not base:
        return None
    length = sum(int(n) for n, op in re.findall(r"(\d+)([MIS=X])", cigar))

    def read_at(genome: int) -> int:
        """Read base that lies at a genome base, going on at one base each beyond the mapped ones."""
        if genome <= base[0][1]:
            return base[0][0] - (base[0][1] - genome)
        if genome > base[-1][1]:
            return base[-1][0] + genome - base[-1][1]
        low, high = 0, len(base) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if base[mid][1] < genome else (low, mid)
        return base[low][0]

    first = max(0, read_at(new_start - 1))
    last = min(length, read_at(new_end - 1) + 1)
    known = {r for _, r in base}
    cuts = [read_at(e) if s - 1 not in known and e in known else read_at(s - 1) + 1 for s, e in junctions]
    chain = [first, *cuts, last]
    return (first, last, cuts) if all(a <= b for a, b in zip(chain[:-1], chain[1:], strict=True)) else None


def join_cigars(parts: list[str], introns: list[int], left: int, right: int) -> str:
    """One CIGAR of exon CIGARs with introns between and clips around; = and X become M, equal neighbours one."""
    ops: list[list] = []

    def add(n: int, op: str) -> None:
        op = "M" if op in "=X" else op
        if n and ops and ops[-1][1] == op:
            ops[-1][0] += n
        elif n:
            ops.append([n, op])

    add(left, "S")
    for k, p in enumerate(parts):
        for n, op in re.findall(r"(\d+)([MID=X])", p):
            add(int(n), op)
        if k < len(introns):
            add(introns[k], "N")
    add(right, "S")
    return "".join(f"{n}{op}" for n, op in ops)


def run(alignments: DataFrame, corrected: DataFrame, genome: DataFrame, window: int = 2000) -> DataFrame:
    """SAM rows (read_id, flag, chr, start, mapq, cigar, seq, qual) of alignments whose read was corrected.

    Each exon between corrected junctions is aligned end to end with its part of the read. A read
    with a failed junction keeps its mapped CIGAR; where corrected ends and junctions aren't in
    order the CIGAR is *. Rows that lack bases take the longest of the read (turned by strand).
    """
    full = alignments.where("seq is not null").groupBy("file_id", "read_id").agg(F.max_by(F.struct("seq", "qual", "flag"), F.length("seq")).alias("any"))
    turned = F.when(sq.is_reverse(F.col("any.flag")) != sq.is_reverse(F.col("flag")), sq.comp_rev(F.col("any.seq"))).otherwise(F.col("any.seq"))
    rows = alignments.join(full, ["file_id", "read_id"], "left").withColumn("bases", F.coalesce("seq", turned))
    c = corrected.groupBy("read_id", "sample", "chr").agg(F.min_by(F.struct("start", "end", "sjs"), "group_id").alias("c"))
    rows = rows.join(c, ["read_id", "sample", "chr"])
    failed = F.exists("c.sjs", lambda j: j["start"].isNull())
    rows = stored(rows.select("file_id", "line", "read_id", "flag", "chr", "start", "mapq", "cigar", F.col("bases").alias("seq"), "qual", F.col("c.start").alias("n_start"), F.col("c.end").alias("n_end"), F.transform("c.sjs", lambda j: F.struct(j["start"].alias("start"), j["end"].alias("end"))).alias("sjs"), failed.alias("failed")))

    @F.pandas_udf("struct<first:int,last:int,cuts:array<int>>")
    def cuts(cigar: pd.Series, start: pd.Series, a: pd.Series, b: pd.Series, sjs: pd.Series) -> pd.DataFrame:
        got = [read_cuts(x, int(s), int(p), int(q), [(int(j["start"]), int(j["end"])) for j in js]) for x, s, p, q, js in zip(cigar, start, a, b, sjs, strict=True)]
        return pd.DataFrame([(None, None, None) if g is None else g for g in got], columns=["first", "last", "cuts"])

    good = stored(rows.where("not failed").withColumn("k", cuts("cigar", "start", "n_start", "n_end", "sjs")))
    key = ["file_id", "line"]
    begins = F.concat(F.array((F.col("n_start") - 1).cast("int")), F.col("sjs.end"))
    ends = F.concat(F.col("sjs.start"), F.array(F.col("n_end").cast("int")))
    qs, qe = F.concat(F.array("k.first"), F.col("k.cuts")), F.concat(F.col("k.cuts"), F.array("k.last"))
    exon = good.where("k.first is not null").select(*key, "chr", "seq", F.posexplode(F.arrays_zip(begins.alias("s"), ends.alias("e"), qs.alias("p"), qe.alias("q"))).alias("i", "x"))
    exon = exon.select(F.struct(*key, "i").alias("key"), "chr", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.substring("seq", F.col("x.p") + 1, F.col("x.q") - F.col("x.p")).alias("part"))
    refs = windows(exon.select("key", "chr", "s", "e"), tiles(genome), "key")
    done = align.global_cigar(exon.join(refs, "key", "left"), "part", "seq", "c", window)
    lists = done.groupBy(F.col("key.file_id").alias("file_id"), F.col("key.line").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("key.i", "c"))), lambda v: v["c"]).alias("parts"))
    out = good.join(lists, key, "left")

    @F.pandas_udf("string")
    def whole(parts: pd.Series, sjs: pd.Series, first: pd.Series, last: pd.Series, seq: pd.Series) -> pd.Series:
        return pd.Series(["*" if p is None else join_cigars(list(p), [int(j["end"]) - int(j["start"]) for j in js], int(a), len(s) - int(b)) for p, js, a, b, s in zip(parts, sjs, first, last, seq, strict=True)])

    built = out.select("read_id", "flag", "chr", F.when(F.col("k.first").isNull(), F.col("start")).otherwise(F.col("n_start")).cast("int").alias("start"), "mapq", whole("parts", "sjs", "k.first", "k.last", "seq").alias("cigar"), "seq", "qual")
    as_is = rows.where("failed").select("read_id", "flag", "chr", "start", "mapq", cg.to_string(cg.merge_equal(cg.operations(F.col("cigar")))).alias("cigar"), "seq", "qual")
    return built.unionByName(as_is)
