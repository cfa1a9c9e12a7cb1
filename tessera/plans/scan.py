"""Scan: filter alignments, form read groups, count junction support and call high-confidence junctions."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import cigar as cg
from ..functions import seq as sq
from ..operators import counts, intervals
from ..operators.errors import ERRORS, errors
from ..sources.genome import tiles, windows
from ..storage import stored

GENOME_ROWS_TO_BROADCAST = 100_000
ROWS_OF_A_TASK = 1_000_000
REASONS = ("unmapped", "mitochondrial", "secondary", "mapping_quality", "max_insertion", "exceeding_chromosome")


def broadcast_small(df: DataFrame, most: int) -> DataFrame:
    """df broadcast if it is counted to have at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def drop_reason(cfg: ScanConfig) -> Column:
    """First failing filter, null for alignments that stay. Expects chr_len and the CIGAR summary s."""
    return (
        F.when(sq.is_unmapped(F.col("flag")) | (F.col("chr") == "*"), REASONS[0])
        .when(F.col("chr") == cfg.mitochondrial, REASONS[1])
        .when(sq.is_secondary(F.col("flag")), REASONS[2])
        .when(F.col("mapq") < cfg.mapq_cutoff, REASONS[3])
        .when(F.col("chr_len").isNull(), F.raise_error(F.concat(F.lit("unknown chromosome "), "chr", F.lit(" of read "), "read_id")).cast("string"))
        .when(F.col("s.max_insertion") >= cfg.inserted_cont_cutoff, REASONS[4])
        .when(F.col("start") - 1 + F.col("s.mapped_n") > F.col("chr_len"), REASONS[5])
    )


def parse(alignments: DataFrame, genome: DataFrame, cfg: ScanConfig) -> DataFrame:
    """alignments with chr_len, the CIGAR summary s, drop_reason and 1-based end."""
    sizes = broadcast_small(genome.select(F.col("chr").alias("_c"), F.col("len").alias("chr_len")), GENOME_ROWS_TO_BROADCAST)
    rows = alignments.join(sizes, F.col("chr") == F.col("_c"), "left").drop("_c")
    rows = cg.with_summary(rows, "cigar", "s", cfg.cont_del_max).withColumn("drop_reason", drop_reason(cfg))
    return rows.withColumn("end", (F.col("start") - 1 + F.col("s.mapped_n")).cast("int"))


def dealt(alignments: DataFrame, rows: int) -> DataFrame:
    """Those many alignments in tasks of a bounded size, a file's block in one: what a task sorts doesn't grow with the input."""
    n = max(alignments.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_OF_A_TASK))
    return alignments.repartition(n, "file_id", "line.block")


def unsorted_files(alignments: DataFrame) -> DataFrame:
    """file_id of each file with a start below that of the row before it, or a chromosome met again after another one.

    Rows are compared inside blocks, in order, and nothing is kept of them but both ends of each run of a chromosome. These are
    compared alike in each file. Rows of a file with the same number have to be the same.
    """
    rows = alignments.select("file_id", F.col("line.block").alias("block"), F.col("line.row").alias("row"), "chr", "start")
    ends = _compared(rows.withColumn("_bad", F.lit(False)), Window.partitionBy("file_id", "block").orderBy("row"))
    runs = _compared(ends.where("_bad or _fresh or _ends").select(*rows.columns, "_bad"), Window.partitionBy("file_id").orderBy("block", "row"))
    runs = runs.where("_bad or _fresh").select("file_id", "chr", "_bad", F.col("_fresh").cast("int").alias("_runs"))
    again = F.sum("_runs").over(Window.partitionBy("file_id", "chr")) > 1
    return runs.select("file_id", (F.col("_bad") | again).alias("_bad")).where("_bad").select("file_id").distinct()


def _compared(rows: DataFrame, w: WindowSpec) -> DataFrame:
    """rows with _bad where their start is below the one before on the chromosome, too; _fresh, _ends: the first and last of a run of a chromosome."""
    before, last, after = F.lag("chr").over(w), F.lag("start").over(w), F.lead("chr").over(w)
    other = lambda c: F.coalesce(c != F.col("chr"), F.lit(True))
    down = F.coalesce((before == F.col("chr")) & (last > F.col("start")), F.lit(False))
    return rows.withColumns({"_bad": F.col("_bad") | down, "_fresh": other(before), "_ends": other(after)})


def check_sorted(alignments: DataFrame) -> DataFrame:
    """The alignments; an error at once if a file is not sorted (see unsorted_files), inside a block or across blocks."""
    bad = unsorted_files(dealt(alignments, alignments.count())).agg(F.min("file_id")).first()[0]
    if bad is not None:
        raise ValueError(f"file {bad} is not sorted")
    return alignments


def error_profiles(reads: DataFrame, genome: DataFrame, cfg: ScanConfig) -> DataFrame:
    """reads with sj_errors and background (operators.errors). Exon sequences come from genome tiles by one join; only cigar, bases and exons go to Python."""
    key = ["file_id", "line"]
    exon = reads.select(*key, "chr", F.posexplode(cg.exons(F.col("start"), F.col("s.exon_intron"))).alias("k", "x"))
    spans = exon.select(F.struct(*key, "k").alias("key"), "chr", F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    got = windows(spans, broadcast_small(tiles(genome), 20_000), "key")
    refs = got.groupBy(F.col("key.file_id").alias("file_id"), F.col("key.line").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("key.k", "seq"))), lambda x: x["seq"]).alias("exons"))
    rows = reads.join(refs, key, "left")
    flank, most = cfg.flank, cfg.cont_del_max

    @F.arrow_udf(ERRORS)
    def profile(cigar: pa.Array, bases: pa.Array, exons: pa.Array) -> pa.Array:
        return errors(cigar, bases, exons, flank, most)

    p = profile(F.col("cigar"), F.col("seq"), F.col("exons"))
    return rows.withColumn("_p", p).withColumns({"sj_errors": F.col("_p.sj_errors"), "background": F.col("_p.background")}).drop("_p", "exons")


def pre_groups(reads: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Merged alignments of each file: (file_id, chr, g_start, g_end, n)."""
    spans = reads.select("file_id", "chr", F.greatest(F.col("start") - cfg.group_extra_range, F.lit(0)).alias("s"), F.least(F.col("end") + cfg.group_extra_range, F.col("chr_len")).alias("e"))
    return intervals.merge_intervals(spans, ["file_id", "chr"], "s", "e")


def alignment_groups(reads: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Read groups (group_id, chr, w_start, w_end) of merged alignments of all files."""
    groups = intervals.merge_intervals(pre_groups(reads, cfg).drop("n").withColumnsRenamed({"g_start": "s", "g_end": "e"}), ["chr"], "s", "e")
    out = intervals.number_groups(groups, ["chr"])
    return out.select((F.col("group_id") - 1).alias("group_id"), "chr", F.col("g_start").alias("w_start"), F.col("g_end").alias("w_end"))


def gene_groups(reads: DataFrame, genes: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Read groups of merged genes, widened into the gaps: from 0 to the last alignment group's end. Chromosomes without a read or a gene have none."""
    merged = intervals.merge_intervals(genes, ["chr"], "start0", "end")
    lasts = pre_groups(reads, cfg).groupBy("chr").agg(F.max_by("g_end", F.struct("g_start", "g_end")).alias("_last"))
    numbered = intervals.number_groups(merged.join(lasts, "chr"), ["chr"])
    w = Window.partitionBy("chr").orderBy("g_start", "g_end")
    start = F.coalesce(F.lag("g_end").over(w) + 1, F.lit(0).cast("long"))
    end = F.coalesce(F.lead("g_start").over(w) - 1, F.col("_last"))
    return numbered.select((F.col("group_id") - 1).alias("group_id"), "chr", start.alias("w_start"), end.alias("w_end"))


def assign_groups(rows: DataFrame, groups: DataFrame, start: str, end: str) -> DataFrame:
    """rows with group_id, once for each group (two at most) that contains them."""
    return intervals.overlap_join(rows, groups, ["chr"], start, end, "w_start", "w_end", how="contains").drop("w_start", "w_end")


def junction_reads(reads: DataFrame) -> DataFrame:
    """One row per read and junction: file_id, line, read_id, chr, k, start, end, read_pos, errors, perfect."""
    sj = F.arrays_zip(cg.junctions(F.col("start"), F.col("s.exon_intron")).alias("j"), F.col("s.sj_read_pos").alias("pos"), F.col("sj_errors").alias("err"))
    x = reads.select("file_id", "line", "sample", "read_id", "chr", F.posexplode(sj).alias("k", "x"))
    err = F.col("x.err")
    return x.select("file_id", "line", "sample", "read_id", "chr", "k", F.col("x.j.start").alias("start"), F.col("x.j.end").alias("end"), F.col("x.pos").alias("read_pos"), err.alias("errors"), ((err["ins"] + err["del"] + err["sub"]) == 0).alias("perfect"))


def support(sj_reads: DataFrame) -> DataFrame:
    """(chr, start, end, n_perfect, n_all): distinct reads of each file."""
    each = counts.distinct_support(sj_reads, ["file_id", "chr", "start", "end"], "read_id", "perfect")
    return each.groupBy("chr", "start", "end").agg(F.sum("n_perfect").alias("n_perfect"), F.sum("n_all").alias("n_all"))


def catalog(supported: DataFrame, groups: DataFrame, annotated: DataFrame, genome: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Every junction of every group, seen or annotated: strand, tag (2 annotated, 1 motif, 0 neither), is_hc, cluster.

    annotated: (chr, start, end, strand digit). Annotated junctions that overlap a group and weren't
    seen come with counts 0 and tag 2.
    """
    seen = assign_groups(supported.withColumn("_e", F.col("end")), groups, "start", "_e").drop("_e")
    flag = lambda d: F.max((F.col("strand") == d).cast("int")).alias(f"a{d}")
    anno = annotated.groupBy("chr", "start", "end").agg(flag("0"), flag("1"))
    seen = stored(seen.join(anno, ["chr", "start", "end"], "left"))  # what follows reads it, and the rows before clustering, several times
    ends = seen.select("chr", "start", "end").distinct()
    spans = ends.select("chr", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("s"), (F.col("start") + 2).alias("e")), F.struct(F.lit(1).alias("side"), (F.col("end") - 2).alias("s"), F.col("end").alias("e")))).alias("x")).distinct()
    spans = spans.select(F.struct("chr", F.col("x.side").alias("side"), F.when(F.col("x.side") == 0, F.col("x.s")).otherwise(F.col("x.e")).alias("at")).alias("key"), "chr", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    motif = windows(spans, broadcast_small(tiles(genome), 20_000), "key")
    side = lambda i, at, name: motif.where(F.col("key.side") == i).select(F.col("key.chr").alias("chr"), F.col("key.at").alias(at), F.col("seq").alias(name))
    seen = seen.join(side(0, "start", "up2"), ["chr", "start"], "left").join(side(1, "end", "down2"), ["chr", "end"], "left")
    m = sq.motif_strand(F.col("up2"), F.col("down2"))
    e0 = (F.coalesce(m, F.lit("")) == "0") | (F.coalesce("a0", F.lit(0)) == 1)
    e1 = (F.coalesce(m, F.lit("")) == "1") | (F.coalesce("a1", F.lit(0)) == 1)
    is_anno = (F.coalesce("a0", F.lit(0)) + F.coalesce("a1", F.lit(0))) > 0
    tag = F.when(is_anno, 2).when(e0 | e1, 1).otherwise(0)
    cols = ["group_id", "chr", "start", "end", "strand", "n_perfect", "n_all", "up2", "down2", "tag", "is_putative", "is_anno"]
    seen = seen.select("group_id", "chr", "start", "end", sq.strand_vote(e0, e1).alias("strand"), "n_perfect", "n_all", "up2", "down2", tag.alias("tag"), F.lit(True).alias("is_putative"), is_anno.alias("is_anno"))
    seen = stored(seen)
    near = intervals.overlap_join(annotated.select("chr", "start", "end", "strand"), groups, ["chr"], "start", "end", "w_start", "w_end")
    unseen = near.select("group_id", "chr", "start", "end", "strand").distinct().join(seen.select("group_id", "chr", "start", "end"), ["group_id", "chr", "start", "end"], "left_anti")
    unseen = unseen.select("group_id", "chr", "start", "end", "strand", F.lit(0).cast("long").alias("n_perfect"), F.lit(0).cast("long").alias("n_all"), F.lit("TBD").alias("up2"), F.lit("TBD").alias("down2"), F.lit(2).alias("tag"), F.lit(False).alias("is_putative"), F.lit(True).alias("is_anno"))
    rows = seen.select(*cols).unionByName(unseen)
    rows = rows.withColumn("is_hc", counts.high_confidence(F.col("tag"), F.col("n_perfect"), F.col("n_all"), cfg.read_num_cutoff, cfg.read_ratio_cutoff))
    return intervals.two_level_clusters(stored(rows), ["group_id", "chr"], "start", "end", cfg.cluster_gap)


def flanks(cat: DataFrame, genome: DataFrame, cfg: ScanConfig) -> DataFrame:
    """(group_id, chr, start, end, strand, cluster_start, cluster_end_key, flank) of high-confidence junctions: bases before the intron and after it."""
    width = cfg.flank + cfg.flank_extra
    hc = cat.where("is_hc")
    at = hc.select("chr", "start", "end").distinct().withColumn("id", F.struct("chr", "start", "end"))
    left = windows(at.select(F.col("id").alias("key"), "chr", (F.col("start") - width).alias("s"), F.col("start").alias("e")), broadcast_small(tiles(genome), 20_000), "key").select(F.col("key").alias("id"), F.col("seq").alias("l"))
    right = windows(at.select(F.col("id").alias("key"), "chr", F.col("end").alias("s"), (F.col("end") + width).alias("e")), broadcast_small(tiles(genome), 20_000), "key").select(F.col("key").alias("id"), F.col("seq").alias("r"))
    both = left.join(right, "id").select("id.*", F.concat("l", "r").alias("flank"))
    return hc.join(both, ["chr", "start", "end"]).select("group_id", "chr", "start", "end", "strand", "cluster_start", "cluster_end_key", "flank")


def recover_sequences(reads: DataFrame) -> DataFrame:
    """reads with bases: the row's own if complete, else another alignment's of the read; oriented as sequenced."""
    own = F.when(F.length("seq") == F.col("s.read_length"), F.when(sq.is_reverse(F.col("flag")), sq.comp_rev(F.col("seq"))).otherwise(F.col("seq")))
    rows = reads.withColumn("_own", own)
    full = rows.where("_own is not null").groupBy("file_id", "read_id").agg(F.max_by("_own", F.struct(F.length("_own"), "_own")).alias("_any"))
    rows = rows.join(full, ["file_id", "read_id"], "left")
    return rows.withColumn("bases", F.coalesce("_own", F.when(F.length("_any") == F.col("s.read_length"), F.col("_any")))).drop("_own", "_any")


@dataclass
class Scan:
    reads: DataFrame  # one alignment per read and group, with bases
    junctions: DataFrame  # a row for each read and junction
    groups: DataFrame
    catalog: DataFrame
    flanks: DataFrame
    summary: DataFrame  # (counter, n)


def run(alignments: DataFrame, genome: DataFrame, exons: DataFrame | None = None, extra_junctions: DataFrame | None = None, cfg: ScanConfig | None = None) -> Scan:
    """alignments: as sources.alignments.read_sam; genome: as read_fasta; exons: as read_exons; extra_junctions: as read_junction_bed."""
    from ..sources import annotation as an

    cfg = cfg or ScanConfig()
    parsed = check_sorted(stored(parse(alignments, genome, cfg)))
    kept = parsed.where("drop_reason is null")
    with_errors = stored(error_profiles(kept, genome, cfg))
    if exons is not None and not cfg.alignment_read_groups:
        groups = gene_groups(kept, an.gene_extents(exons), cfg)
    else:
        groups = alignment_groups(kept, cfg)
    groups = stored(groups)
    annotated = an.annotated_from_exons(exons) if exons is not None else None
    if extra_junctions is not None:
        annotated = extra_junctions if annotated is None else annotated.unionByName(extra_junctions).distinct()
    if annotated is None:
        annotated = kept.sparkSession.createDataFrame([], "chr string, start int, end int, strand string")
    sj = stored(junction_reads(with_errors))
    cat = stored(catalog(support(sj), groups, annotated, genome, cfg))
    best = counts.best_record(recover_sequences(with_errors), ["file_id", "read_id"], F.desc("s.mapped"), F.desc("mapq"), F.asc("line"))
    best = stored(best)
    whole = best.where("bases is not null")
    placed = assign_groups(whole.withColumn("_s", F.col("start")).withColumn("_e", F.col("end")), groups, "_s", "_e").drop("_s", "_e")
    counters = parsed.groupBy(F.coalesce(F.concat(F.lit("filtered_"), "drop_reason"), F.lit("kept_alignments")).alias("counter")).agg(F.count("*").alias("n"))
    counters = counters.unionByName(best.agg(F.count("*").alias("n")).select(F.lit("reads").alias("counter"), "n")).unionByName(best.where("bases is null").agg(F.count("*").alias("n")).select(F.lit("reads_without_sequence").alias("counter"), "n"))
    counters = counters.unionByName(cat.where("is_hc").agg(F.count_distinct("chr", "start", "end", "strand").alias("n")).select(F.lit("high_confidence_junctions").alias("counter"), "n"))
    return Scan(placed, sj, groups, cat, flanks(cat, genome, cfg), counters)
