"""Results as text: every function gives a DataFrame with one column `value` of lines, or writes it.

Rows are ordered inside partitions only where a format asks for it; a global order is a range
partitioning, never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import sj_id
from ..ordering import KEYS_TO_BROADCAST


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines.select(F.col("value").cast("string")).write.mode(mode).text(path)


def tabbed(*cols: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def two(c: Column) -> Column:
    return F.call_function("format_number", c, F.lit("0.00"))


def gtf(structures: DataFrame) -> DataFrame:
    """Transcript and exon lines of quantify's structures; exons are numbered by coordinate on either strand."""
    n = F.size("chain")
    starts = F.concat(F.array((F.col("start0") + 1).cast("int")), F.transform("chain", lambda j: j["end"] + 1))
    ends = F.concat(F.transform("chain", lambda j: j["start"]), F.array(F.col("end").cast("int")))
    attributes = F.concat(F.lit('transcript_id "'), "transcript_id", F.lit('"; gene_id "'), "gene_id", F.lit('";'))
    base = structures.select("chr", "source", "strand", "start0", "end", "transcript_id", attributes.alias("a"), F.arrays_zip(starts.alias("s"), ends.alias("e")).alias("x"), n.alias("n"))
    lines = base.select("chr", "transcript_id", "start0", F.explode(F.concat(
        F.array(F.struct(F.lit(0).alias("k"), tabbed(F.col("chr"), F.col("source"), F.lit("transcript"), F.col("start0") + 1, F.col("end"), F.lit("."), F.col("strand"), F.lit("."), F.col("a")).alias("value"))),
        F.transform("x", lambda v, i: F.struct((i + 1).alias("k"), tabbed(F.col("chr"), F.col("source"), F.lit("exon"), v["s"], v["e"], F.lit("."), F.col("strand"), F.lit("."), F.concat(F.col("a"), F.lit(' exon_number "'), (i + 1).cast("string"), F.lit('";'))).alias("value"))),
    )).alias("l"))
    return lines.repartitionByRange("chr", "start0", "transcript_id").sortWithinPartitions("chr", "start0", "transcript_id", "l.k").select("l.value")


def abundance_matrix(abundance: DataFrame, samples: list[str]) -> DataFrame:
    """(transcript_ID, transcript_name, gene_ID, a column for each sample): counts with two places, missing ones 0.00."""
    wide = abundance.groupBy("transcript_id", "transcript_name", "gene_id").pivot("sample", samples).agg(F.sum("count"))
    cells = [two(F.coalesce(F.col(f"`{s}`"), F.lit(0.0))).alias(s) for s in samples]
    na = lambda c: F.coalesce(c, F.lit("NA"))
    return wide.select(F.col("transcript_id").alias("transcript_ID"), na("transcript_name").alias("transcript_name"), na("gene_id").alias("gene_ID"), *cells)


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.write.csv(path, sep="\t", header=True, quote="")


def compatible(rows: DataFrame) -> DataFrame:
    """Lines read, sample, class, isoforms with a comma after each, NA for none."""
    names = F.when(F.size("isoforms") > 0, F.concat(F.array_join("isoforms", ","), F.lit(","))).otherwise("NA")
    return rows.select(tabbed(F.col("read_id"), F.col("sample"), F.col("class"), names).alias("value"))


def corrected_features(rows: DataFrame) -> DataFrame:
    """The long feature table of corrected reads: scalars, a line for each junction (added ones numbered 0 and -1), start and end."""
    line = lambda name, *c: F.concat_ws("\t", "read_id", F.lit(name), F.concat_ws("\t", *[x.cast("string") for x in c]))
    na = lambda c: F.coalesce(c.cast("string"), F.lit("NA"))
    def junction(j: Column, i: Column) -> Column:
        added = j["status"] == "added"
        index = F.when(added & (i == 0), F.lit("0")).when(added, F.lit("-1")).otherwise((i + 1).cast("string"))
        orig = F.when(j["orig_start"].isNotNull(), sj_id(F.col("chr"), j["orig_start"], j["orig_end"])).otherwise("NA")
        corr = F.when(j["start"].isNotNull(), sj_id(F.col("chr"), j["start"], j["end"], j["strand"])).otherwise("NA")
        return line("SJ", index, orig, F.lit("NA"), F.lit("NA"), j["status"], corr, na(j["pos"]), F.lit("NA"), na(j["score"]), F.lit("NA"), F.lit("NA"))

    end = lambda name: line(name, F.lit("NA"), F.col(name), F.lit("NA"), F.lit("NA"), F.lit("pass"), F.col(name), F.lit("NA"), F.lit("NA"), F.lit("NA"), F.lit("NA"), F.lit("NA"))
    head = F.array(line("group_ID", F.col("group_id"), F.col("group_id"), F.col("sample")), line("strand_isoform", F.col("strand")), line("chr", F.col("chr")), line("flag", F.col("flag")))
    return rows.select(F.explode(F.concat(head, F.transform("sjs", junction), F.array(end("start"), end("end")))).alias("value"))


def junction_fasta(flanks: DataFrame) -> DataFrame:
    name = F.concat(F.lit(">"), sj_id(F.col("chr"), F.col("start"), F.col("end"), F.col("strand")), F.lit(" group:"), F.col("group_id").cast("string"))
    return flanks.select(F.concat_ws("\n", name, "flank").alias("value"))


def summary(counters: DataFrame, command: str) -> DataFrame:
    """Line 1 the command, then `counter: n`. A counter is a row, so there are few."""
    rows = counters.groupBy("counter").agg(F.sum("n").alias("n")).select(F.lit(1).alias("o"), F.concat("counter", F.lit(": "), F.col("n").cast("string")).alias("value"))
    head = counters.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(command).alias("value"))
    return head.unionByName(rows).orderBy("o", "value").select("value")


def bedgraph(segments: DataFrame, track: str, color: str) -> dict[str, object]:
    """A track's header line and its lines by chromosome and start; depth is 1 if any base is covered by weight 1."""
    header = f'track type=bedGraph name="{track}" color={color}'
    lines = segments.repartitionByRange("chr", "seg_start").sortWithinPartitions("chr", "seg_start").select(tabbed(F.col("chr"), F.col("seg_start"), F.col("seg_end"), F.col("depth")).alias("value"))
    return {"header": header, "lines": lines}


def bed12(transcripts: DataFrame, score: int = 0) -> DataFrame:
    """BED12 lines of sources.annotation.transcripts."""
    sizes = F.array_join(F.transform("exons", lambda e: (e["end"] - e["start"]).cast("string")), ",")
    starts = F.array_join(F.transform("exons", lambda e: (e["start"] - F.col("start0")).cast("string")), ",")
    return transcripts.select(tabbed(F.col("chr"), F.col("start0"), F.col("end"), F.col("transcript_id"), F.lit(score), F.col("strand"), F.col("start0"), F.col("end"), F.lit("0,0,0"), F.size("exons"), sizes, starts).alias("value"))


def sam(rows: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Header lines in the chromosomes' order, then alignments by place."""
    head = chromosomes.select(F.lit(0).alias("o"), F.col("rank").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("@SQ\tSN:"), "chr", F.lit("\tLN:"), F.col("len").cast("string")).alias("value"))
    text = F.concat_ws("\t", "read_id", F.col("flag").cast("string"), "chr", F.col("start").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*")))
    ranks = chromosomes.select("chr", "rank")
    ranks = F.broadcast(ranks) if ranks.limit(KEYS_TO_BROADCAST + 1).count() <= KEYS_TO_BROADCAST else ranks
    body = rows.join(ranks, "chr").select(F.lit(1).alias("o"), F.col("rank").cast("long").alias("a"), F.col("start").cast("long").alias("b"), text.alias("value"))
    return head.unionByName(body).repartitionByRange("o", "a", "b").sortWithinPartitions("o", "a", "b").select("value")


def rename_collisions(paths: list[str], ending: str = "sam") -> dict[str, str]:
    """Output name of each path: its base name, with a number where an earlier path has the same."""
    from ..functions.names import output_prefix

    seen: dict[str, int] = {}
    out = {}
    for p in paths:
        base = output_prefix(p)
        k = seen.get(base, 0)
        seen[base] = k + 1
        out[p] = f"{base}.{ending}" if not k else f"{base}_{k}.{ending}"
    return out
