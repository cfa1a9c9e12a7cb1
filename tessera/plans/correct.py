"""Correct: realign read windows to high-confidence junctions and correct each read's junctions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PROFILE, CorrectConfig
from ..functions import cigar as cg
from ..functions import seq as sq
from ..operators import align, counts, intervals, profile
from ..operators import junctions as jn
from ..sources.genome import tiles, windows
from ..storage import stored
from .scan import Scan

KEY = ["file_id", "line", "group_id"]


def with_catalog(scan: Scan) -> DataFrame:
    """One row per read, group and junction in order, with the catalog's strand, confidence and cluster; bases in genome direction."""
    rows = scan.reads.select(*KEY, "read_id", "sample", "chr", "flag", "start", "end", F.col("s.read_length").alias("read_length"), F.col("s.clips").alias("clips"), "background", F.when(sq.is_reverse(F.col("flag")), sq.comp_rev(F.col("bases"))).otherwise(F.col("bases")).alias("bases"), F.arrays_zip(cg.junctions(F.col("start"), F.col("s.exon_intron")).alias("j"), F.col("s.sj_read_pos").alias("pos"), F.col("sj_errors").alias("err")).alias("x"))
    each = rows.select("*", F.size("x").alias("n_sj"), F.posexplode("x").alias("k", "y")).drop("x")
    each = each.select("*", F.col("y.j.start").alias("sj_start"), F.col("y.j.end").alias("sj_end"), F.col("y.pos").alias("pos"), F.col("y.err").alias("err")).drop("y")
    cat = scan.catalog.groupBy("group_id", F.col("start").alias("sj_start"), F.col("end").alias("sj_end")).agg(F.min_by(F.struct("strand", "is_hc", "is_anno", "cluster_start", "cluster_end_key"), "strand").alias("c"))
    return each.join(cat, ["group_id", "sj_start", "sj_end"], "left")


def segments(reads: DataFrame, catalog: DataFrame, cfg: CorrectConfig) -> DataFrame:
    """(KEY, cluster_start, cluster_end_key, lo, hi): the part of each read to align to a cluster's junctions.

    A junction's own cluster gets the bases near it; the first junction of a read opens the part to
    the read's beginning and also reaches clusters to the left, the last to its end and to the right.
    """
    near = 2 * cfg.flank + cfg.flank_extra
    extent = intervals.cluster_extents(catalog, ["group_id"], "start", "end", hc=F.max(F.col("is_hc").cast("int"))).where("hc = 1").drop("hc")
    is_first, is_last = F.col("k") == 0, F.col("k") == F.col("n_sj") - 1
    lo = F.when(is_first, 0).otherwise(F.greatest(F.col("pos") - near, F.lit(0)))
    hi = F.when(is_last, F.col("read_length")).otherwise(F.least(F.col("pos") + near, F.col("read_length")))
    cluster = ["cluster_start", "cluster_end_key"]
    own = reads.where("c is not null").select(*KEY, F.col("c.cluster_start").alias("cluster_start"), F.col("c.cluster_end_key").alias("cluster_end_key"), lo.alias("lo"), hi.alias("hi"))
    own = own.join(extent.select("group_id", *cluster), ["group_id", *cluster], "left_semi")
    all_ends = intervals.cluster_extents(catalog, ["group_id"], "start", "end", "m_start", "m_end")
    at = reads.where("c is not null").select(*KEY, "k", "n_sj", "pos", "read_length", F.col("c.cluster_start").alias("cluster_start"), F.col("c.cluster_end_key").alias("cluster_end_key")).join(all_ends, ["group_id", *cluster]).drop(*cluster)
    reach = lambda n: F.floor(n * cfg.end_lost_fold).cast("long")
    left = at.where(is_first & (F.col("pos") > 0)).select(*KEY, F.lit(0).alias("lo"), F.least(F.col("pos") + near, F.col("read_length")).alias("hi"), (F.col("m_start") - reach(F.col("pos"))).alias("a"), (F.col("m_start") + cfg.cluster_overlap_max - 1).alias("b"))
    right = at.where(is_last & (F.col("read_length") > F.col("pos"))).select(*KEY, F.greatest(F.col("pos") - near, F.lit(0)).alias("lo"), F.col("read_length").alias("hi"), (F.col("m_end") - cfg.cluster_overlap_max + 1).alias("a"), (F.col("m_end") + reach(F.col("read_length") - F.col("pos"))).alias("b"))
    ends = extent.select("group_id", *cluster, F.col("c_end").cast("long").alias("p"), F.col("c_end").cast("long").alias("q"))
    begins = extent.select("group_id", *cluster, F.col("c_start").cast("long").alias("p"), F.col("c_start").cast("long").alias("q"))
    hit = [intervals.overlap_join(points, side, ["group_id"], "p", "q", "a", "b", how="contains").select(*KEY, *cluster, "lo", "hi") for points, side in ((ends, left), (begins, right))]
    every = own.unionByName(hit[0]).unionByName(hit[1])
    return every.groupBy(*KEY, *cluster).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def candidates(reads: DataFrame, parts: DataFrame, flanks: DataFrame, cfg: CorrectConfig) -> DataFrame:
    """(KEY, found): junctions whose flanks align to a part of the read over the junction, the best alignment of each."""
    bases = reads.where("k = 0").select(*KEY, "bases", "background")
    texts = parts.join(bases, KEY).select(*KEY, "cluster_start", "cluster_end_key", "lo", "background", F.substring("bases", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("part"))
    pairs = texts.join(flanks.select("group_id", "cluster_start", "cluster_end_key", "start", "end", "strand", "flank"), ["group_id", "cluster_start", "cluster_end_key"]).where(F.length("flank") == 2 * (cfg.flank + cfg.flank_extra))
    done = align.local(pairs, "part", "flank")
    ok = (F.col("ref_start") < cfg.flank_extra) & (F.col("ref_end") >= 2 * cfg.flank + cfg.flank_extra - 1)
    fields = ["start", "end", "strand", "lo", "query_start", "ref_start", "cigar"]
    best = done.where((F.col("score") > 0) & ok).groupBy(*KEY, "start", "end", "strand").agg(F.max(F.struct("score", F.struct(*fields).alias("hit"))).alias("m"))
    return best.groupBy(*KEY).agg(F.collect_list("m.hit").alias("found"))


SJ = "struct<start:int,end:int,strand:string,orig_start:int,orig_end:int,status:string,score:double,pos:int>"
EXTRA = "struct<side:string,start:int,end:int,strand:string,prob:double,pos:int>"


def decisions(reads: DataFrame, found: DataFrame, cfg: CorrectConfig) -> DataFrame:
    """One row per read and group: strand, sjs with status, extra terminal candidates."""
    sj = F.struct("k", "sj_start", "sj_end", "pos", "err", F.col("c.strand").alias("strand"), F.coalesce("c.is_hc", F.lit(False)).alias("is_hc"))
    first = lambda c: F.first(c).alias(c)
    rows = reads.groupBy(*KEY).agg(*[first(c) for c in ("read_id", "sample", "chr", "flag", "start", "end", "read_length", "clips", "background", "bases")], F.array_sort(F.collect_list(sj)).alias("seen"))
    rows = rows.join(found, KEY, "left")

    @F.pandas_udf(f"struct<strand:string,sjs:array<{SJ}>,extra:array<{EXTRA}>>")
    def run(seen: pd.Series, hits: pd.Series, background: pd.DataFrame, clips: pd.Series, length: pd.Series) -> pd.DataFrame:
        out = []
        err = lambda e: (int(e["ins"]), int(e["del"]), int(e["sub"])) if e is not None else (0, 0, 0)
        others = background[["ins", "del", "sub", "total"]].astype(int).itertuples(index=False, name=None)
        for placed, got, bg, clip, size in zip(seen, hits, others, clips, length, strict=True):
            mapped = [jn.Seen((int(x["sj_start"]), int(x["sj_end"])), x["strand"] or "x", int(x["pos"]), bool(x["is_hc"]), err(x["err"])) for x in placed]
            cands = []
            for h in got if got is not None else ():
                errors, a, b, before = jn.window_errors(h["cigar"], int(h["query_start"]), int(h["ref_start"]), cfg)
                lo = int(h["lo"])
                cands.append(jn.Candidate((int(h["start"]), int(h["end"])), h["strand"], lo + a, lo + b, lo + before, jn.error_probability(errors, bg, 2 * cfg.flank)))
            d = jn.decide(mapped, cands, bg, (int(clip[0]), int(clip[1])), int(size), cfg)
            sjs = []
            for k, s in enumerate(mapped):
                at, status, score, pos = d.fixed.get(k, (None, "fail", None, s.pos))
                sjs.append({"start": at[0] if at else None, "end": at[1] if at else None, "strand": d.strand if at else None, "orig_start": s.at[0], "orig_end": s.at[1], "status": status, "score": score, "pos": pos})
            extra = [{"side": side, "start": c.at[0], "end": c.at[1], "strand": c.strand, "prob": c.prob, "pos": c.middle} for side, c in d.extra]
            out.append((d.strand, sjs, extra))
        return pd.DataFrame(out, columns=["strand", "sjs", "extra"])

    done = rows.withColumn("d", run("seen", "found", "background", "clips", "read_length"))
    return done.select(*KEY, "read_id", "sample", "chr", "flag", "start", "end", "read_length", "bases", F.col("d.strand").alias("strand"), F.col("d.sjs").alias("sjs"), F.col("d.extra").alias("extra"))


def accept_extra(decided: DataFrame, genome: DataFrame, cfg: CorrectConfig) -> DataFrame:
    """(KEY, side, junction) of terminal candidates that explain the read's end better than the genome beside it.

    The read's outer bases, with some of the mapped ones, are a profile that meets two sequences: the exon across the junction
    and the intron's edge, each before (or after) the mapped exon. A hit counts if it reaches over the junction. The best
    candidate must beat the intron's edge by score_difference bits, and the next candidate by as much.
    """
    anchor, pad = cfg.flank + cfg.flank_extra, cfg.flank
    e = decided.select(*KEY, "chr", "bases", "read_length", F.explode("extra").alias("x")).select(*KEY, "chr", "bases", "read_length", "x.*")
    size = F.least(F.when(F.col("side") == "first", F.col("pos")).otherwise(F.col("read_length") - F.col("pos")), F.lit(cfg.end_extra))
    e = e.withColumn("size", size).where("size > 0").withColumn("id", F.struct(*KEY, "side", "start", "end"))
    is_first = F.col("side") == "first"
    begin = F.when(is_first, F.col("pos") - F.col("size")).otherwise(F.greatest(F.col("pos") - anchor, F.lit(0)))
    stop = F.when(is_first, F.col("pos") + anchor).otherwise(F.col("pos") + F.col("size"))
    e = stored(e.withColumn("part", F.substring("bases", begin + 1, stop - begin)))
    reach = F.col("size") + pad
    spans = {
        "mapped": (F.when(is_first, F.col("end")).otherwise(F.col("start") - anchor), F.when(is_first, F.col("end") + anchor).otherwise(F.col("start"))),
        "exon": (F.when(is_first, F.col("start") - reach).otherwise(F.col("end")), F.when(is_first, F.col("start")).otherwise(F.col("end") + reach)),
        "intron": (F.when(is_first, F.col("end") - reach).otherwise(F.col("start")), F.when(is_first, F.col("end")).otherwise(F.col("start") + reach)),
    }
    cut = tiles(genome)
    texts = e.select("id", "side", "part", "strand", "pos", "prob")
    for name, (a, b) in spans.items():
        seqs = windows(e.select(F.col("id").alias("key"), "chr", F.greatest(a, F.lit(0)).alias("s"), b.alias("e")), cut, "key").select(F.col("key").alias("id"), F.col("seq").alias(name))
        texts = texts.join(seqs, "id", "left")
    scored = stored(texts)
    for name, outer in (("across", "exon"), ("beside", "intron")):
        whole = F.when(is_first, F.concat(outer, "mapped")).otherwise(F.concat("mapped", outer))
        met = profile.profile(scored.withColumn("ref", whole), "part", "ref")
        over = F.when(is_first, F.length("ref") - 1 - F.col("ref_end")).otherwise(F.col("ref_start")) <= anchor
        hit = over & (F.col("ref_end") - F.col("ref_start") + 1 > anchor) & (F.col("bits") >= PROFILE.least_bits)
        scored = stored(met.select(*scored.columns, F.when(hit, F.col("bits")).alias(name)))
    good = scored.where("across is not null").select("id.*", "strand", "pos", "prob", "across", "beside")
    top = counts.best_margin(good, [*KEY, "side"], "across", "start", "end", "strand", "pos", "prob", "beside")
    far = lambda other: F.coalesce(F.col("best.across") - other, F.lit(1e9)) >= cfg.score_difference
    return top.where(far(F.col("best.beside")) & far(F.col("second"))).select(*KEY, "side", "best")


def run(scan: Scan, genome: DataFrame, cfg: CorrectConfig | None = None) -> DataFrame:
    """One row per read and group with its corrected junctions.

    read_id, sample, chr, group_id, strand, start, end, flag, sjs array: start and end null where the
    junction failed, orig_start and orig_end as mapped (null for an added one), status pass,
    corrected, fail or added. Reads without a junction come through with none.
    """
    cfg = cfg or CorrectConfig()
    reads = stored(with_catalog(scan))
    parts = segments(reads, scan.catalog, cfg)
    found = stored(candidates(reads, stored(parts), scan.flanks, cfg))
    decided = stored(decisions(reads, found, cfg))
    extra = stored(accept_extra(decided, genome, cfg))
    add = lambda side, name: extra.where(F.col("side") == side).select(*KEY, F.struct(F.col("best.start"), F.col("best.end"), F.col("best.strand"), F.lit(None).cast("int").alias("orig_start"), F.lit(None).cast("int").alias("orig_end"), F.lit("added").alias("status"), F.col("best.prob").alias("score"), F.col("best.pos").alias("pos")).alias(name))
    rows = decided.join(add("first", "added_first"), KEY, "left").join(add("last", "added_last"), KEY, "left")
    none = F.array().cast(f"array<{SJ}>")
    sjs = F.concat(F.when(F.col("added_first").isNotNull(), F.array("added_first")).otherwise(none), "sjs", F.when(F.col("added_last").isNotNull(), F.array("added_last")).otherwise(none))
    new_start = F.coalesce(F.col("added_first.start") - F.col("added_first.pos") + 1, F.col("start"))
    new_end = F.coalesce(F.col("added_last.end") + F.col("read_length") - F.col("added_last.pos"), F.col("end"))
    cols = ["read_id", "sample", "chr", "group_id", "strand", "start", "end", "flag", "sjs"]
    with_sj = rows.withColumn("_sjs", sjs).withColumns({"_start": F.least(new_start, F.col("start")).cast("int"), "_end": F.greatest(new_end, F.col("end")).cast("int")})
    with_sj = with_sj.select("read_id", "sample", "chr", "group_id", "strand", F.col("_start").alias("start"), F.col("_end").alias("end"), "flag", F.col("_sjs").alias("sjs"))
    lone = scan.reads.where(F.size("s.exon_intron") == 1).select("read_id", "sample", "chr", "group_id", F.when(sq.is_reverse(F.col("flag")), "1").otherwise("0").alias("strand"), "start", "end", "flag", none.alias("sjs"))
    return with_sj.select(*cols).unionByName(lone.select(*cols))
