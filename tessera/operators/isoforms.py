"""Isoform discovery and assignment over all read groups at once, as joins of chains and read classes.

Reads are reduced to chains (one row for each chain of junction codes of a read group) and read classes
(chain, sample, start, end, count) first. Chains meet isoforms, and each other, only where one fits in the
other (operators.chains.fits), so no task ever holds a read group.

chains: cid, chr, group_id, codes, strand, all_annotated, all_sites, n (reads), valid, start, end (medians).
classes: cid, sample, start, end, n. isoforms: chr, transcript_id, transcript_name, gene_id, i_start, i_end, i_codes.
Isoforms of equal chains and ends meet reads alike: they are one variant (variants_of), and become single ones again in what is given out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QuantConfig
from ..functions.numeric import c_round
from ..ordering import attach, numbered, ranged, salted_join
from ..storage import stored
from . import counts as ct
from .chains import ends_ok, fits, free_ends

FSM, ISM, NIC, NNC, NCD = "FSM", "ISM", "NIC", "NNC", "NCD"
GROUP = ["chr", "group_id"]
ALIKE = ["chr", "i_codes", "i_start", "i_end"]


def _ends(free: Column, start: str, end: str, cfg: QuantConfig) -> Column:
    return ends_ok(free, F.col(start), F.col(end), cfg.sj_dist, cfg.internal_boundary_limit, cfg.allow_longer_terminal_exons)


def variants_of(isoforms: DataFrame) -> DataFrame:
    """(chr, i_codes, i_start, i_end, copies, variant: a number): isoforms of equal chains and ends, and how many they are."""
    return stored(isoforms.groupBy(*ALIKE).agg(F.count("*").alias("copies")).withColumn("variant", F.monotonically_increasing_id()))


def classify(chains: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains with category, matches: cid, chr, group_id, variant, copies, same, free).

    NCD: a junction failed. NNC, NIC: some junction isn't annotated; in NIC all its sites are. FSM: equal to isoforms;
    ISM: a part of longer ones; annotated junctions that no isoform has in that order are NIC. matches
    has the variants of isoforms that an FSM chain equals, or that an ISM chain is part of.
    """
    known = chains.where("all_annotated and not exists(codes, c -> c is null)")
    shapes = stored(variants.groupBy("chr", "i_codes").agg(F.min("variant").alias("shape")))  # isoforms of equal chains meet reads once
    pairs = fits(known.select("chr", "group_id", F.col("cid").alias("short_id"), F.col("codes").alias("short")), shapes.select("chr", F.col("shape").alias("long_id"), F.col("i_codes").alias("long")), ["chr"], loose=False)
    pairs = pairs.select(*GROUP, F.col("short_id").alias("cid"), F.col("long_id").alias("shape"), "offset", F.size("short").alias("size"))
    each = variants.join(shapes, ["chr", "i_codes"]).select("chr", "shape", "variant", "copies", "i_codes", "i_start", "i_end")
    pairs = pairs.join(each, ["chr", "shape"])
    free = free_ends(F.col("i_codes"), F.col("offset"), F.col("size"), F.col("i_start"), F.col("i_end"))
    matches = stored(pairs.select("cid", *GROUP, "variant", "copies", (F.col("size") == F.size("i_codes")).alias("same"), free.alias("free")))
    kinds = matches.groupBy("cid").agg(F.bool_or("same").alias("whole"))
    category = (
        F.when(F.exists("codes", lambda c: c.isNull()), NCD)
        .when(~F.col("all_annotated"), F.when(F.col("all_sites"), NIC).otherwise(NNC))
        .when(F.col("whole"), FSM).when(F.col("whole").isNotNull(), ISM).otherwise(NIC)
    )
    out = stored(chains.join(kinds, "cid", "left").withColumn("category", category).drop("whole"))
    wanted = out.where(F.col("category").isin(FSM, ISM)).select("cid", (F.col("category") == FSM).alias("same"))
    return out, matches.join(wanted, ["cid", "same"])


@dataclass
class Novel:
    """What discover finds: longest (cid, number: a novel isoform's place in its group), inside (cid, long: valid longer
    chains that hold a chain), within (cid, long, free: all such pairs of chains), listed (cid, variant, copies, target, free: isoforms
    of an ISM chain that agree with its ends, and the chain of reads that equals each)."""

    longest: DataFrame
    inside: DataFrame
    within: DataFrame
    listed: DataFrame


def discover(chains: DataFrame, matches: DataFrame, cfg: QuantConfig) -> Novel:
    """Novel chains that no longer valid one holds, numbered in each group in the order NNC, NIC, ISM, then by length.

    A NIC chain may also be held by an NNC chain that was found novel; an ISM chain is novel if it is valid, agrees with the ends
    of isoforms that no read shows whole, and neither another such chain nor a novel one holds it. With cfg.raw all valid ISM,
    NIC and NNC chains are novel, in that order.
    """
    of = lambda c: chains.where(F.col("category") == c)
    open_ = chains.where(F.col("category").isin(NNC, NIC, ISM))
    valid = open_.where("valid")
    shorts = open_.where(F.col("valid") | (F.col("category") == ISM)).select(*GROUP, F.col("cid").alias("short_id"), F.col("codes").alias("short"), F.col("category").alias("kind"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    longs = valid.select(*GROUP, F.col("cid").alias("long_id"), F.col("codes").alias("long"), F.col("category").alias("l_kind"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    pairs = fits(shorts, longs, GROUP, loose=False).where(F.size("short") < F.size("long"))
    free = free_ends(F.col("long"), F.col("offset"), F.size("short"), F.col("l_start"), F.col("l_end"))
    pairs = pairs.withColumn("free", free).where(_ends(F.col("free"), "s_start", "s_end", cfg))
    within = stored(pairs.select(F.col("short_id").alias("cid"), F.col("long_id").alias("long"), "kind", "l_kind", "free"))

    ism = matches.where("not same").join(of(ISM).select("cid", "start", "end"), "cid")
    ism = stored(ism.where(F.lit(cfg.raw) | _ends(F.col("free"), "start", "end", cfg)).select("cid", *GROUP, "variant", "copies", "free"))
    read = matches.where("same").select(*GROUP, "variant", F.col("cid").alias("target"))
    listed = stored(ism.join(read, [*GROUP, "variant"]).select("cid", "variant", "copies", "target", "free"))

    kind = lambda a, b: (F.col("kind") == a) & (F.col("l_kind") == b)
    ids = lambda d: d.select("cid")
    if cfg.raw:
        inside = within.where(F.lit(False)).select("cid", "long")
        found, rank = valid, {ISM: 0, NIC: 1, NNC: 2}
    else:
        in_nnc = within.where(kind(NNC, NNC))
        nnc = ids(valid.where(F.col("category") == NNC)).join(ids(in_nnc), "cid", "left_anti")
        in_nic = within.where(kind(NIC, NIC)).unionByName(within.where(kind(NIC, NNC)).join(nnc.withColumnRenamed("cid", "long"), "long", "left_semi").select(*within.columns))
        nic = ids(valid.where(F.col("category") == NIC)).join(ids(in_nic), "cid", "left_anti")
        free_ism = ids(valid.where(F.col("category") == ISM)).join(ids(listed), "cid", "left_anti")
        holders = free_ism.unionByName(nnc).unionByName(nic).withColumnRenamed("cid", "long")
        in_ism = within.where(F.col("kind") == ISM).join(free_ism, "cid", "left_semi").join(holders, "long", "left_semi")
        new_ism = free_ism.join(ids(ism), "cid", "left_semi").join(ids(in_ism), "cid", "left_anti")
        inside = stored(in_nnc.unionByName(in_nic).unionByName(in_ism.select(*within.columns)).select("cid", "long"))
        found, rank = valid.join(nnc.unionByName(nic).unionByName(new_ism), "cid", "left_semi"), {NNC: 0, NIC: 1, ISM: 2}
    back = F.lit(not cfg.raw) & (F.col("category") == ISM)  # these come last first
    size = F.when(back, -F.size("codes")).otherwise(F.size("codes"))
    place = F.when(back, F.transform("codes", lambda c: -c)).otherwise(F.col("codes"))
    order = found.select("cid", *GROUP, F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("category")].alias("_rank"), size.alias("_size"), place.alias("_place"))
    at = stored(numbered(ranged(order, *[F.asc(c) for c in (*GROUP, "_rank", "_size", "_place")]), "_at"))
    first = stored(at.groupBy(*GROUP).agg(F.count("*").alias("_n"), F.min("_at").alias("_first")))
    longest = attach(at, first, GROUP, at.count()).select("cid", *GROUP, (F.col("_at") - F.col("_first")).alias("number"))
    return Novel(stored(longest), inside, within, listed)


def novel_name(number: str = "number") -> Column:
    return F.concat(F.lit("TSR:"), "chr", F.lit(":"), F.col("group_id").cast("string"), F.lit(":"), F.col(number).cast("string"))


@dataclass
class Assigned:
    """direct (cid, sample, n): reads counted for a chain at once; evidence (evidence, cid, sample, n): reads shared by several chains,
    a row for each. For named: held (cid, long, number, name: the novel chains of a NIC or NNC chain), loose (cid, long: what a chain with failed
    junctions fits in), mine (the read classes of novel ISM chains), options (cid, target, free, variant, copies, number, name: what others may count for)."""

    direct: DataFrame
    evidence: DataFrame
    held: DataFrame
    loose: DataFrame
    mine: DataFrame
    options: DataFrame


def _numbered(novel: Novel) -> DataFrame:
    return novel.longest.select("cid", "number", novel_name().alias("name"))


def _rows_of(classes: DataFrame) -> DataFrame:
    return classes.groupBy("cid").agg(F.count("*").alias("_n"))


def assign(chains: DataFrame, classes: DataFrame, matches: DataFrame, novel: Novel, cfg: QuantConfig) -> Assigned:
    """Which chains the reads of each chain count for.

    A valid NIC or NNC chain counts for the novel chains that hold it. An ISM class counts for the listed isoforms and novel chains whose ends
    agree with its own ends. A chain with failed junctions counts for FSM and novel chains that it fits in, by its
    median ends. One possible chain gets the reads at once; several share them.
    """
    names = _numbered(novel)
    initial = stored(classes.groupBy("cid", "sample").agg(F.sum("n").alias("n")))
    target = names.select(F.col("cid").alias("long"), "number", "name")

    # NIC and NNC
    held = stored(novel.inside.join(target, "long").join(chains.where(F.col("category").isin(NIC, NNC)).select("cid"), "cid", "left_semi"))

    # NCD
    pool = chains.where(F.col("category") == FSM).select("cid").unionByName(names.select("cid"))
    longs = chains.join(pool, "cid", "left_semi").select(*GROUP, F.col("cid").alias("long_id"), F.col("codes").alias("long"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    shorts = chains.where(F.col("category") == NCD).select(*GROUP, F.col("cid").alias("short_id"), F.col("codes").alias("short"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    loose = fits(shorts, longs, GROUP)
    loose = loose.where(_ends(free_ends(F.col("long"), F.col("offset"), F.size("short"), F.col("l_start"), F.col("l_end")), "s_start", "s_end", cfg))
    loose = stored(loose.select(F.col("short_id").alias("cid"), F.col("long_id").alias("long")))

    # ISM
    ism = chains.where(F.col("category") == ISM)
    novel_ism = ism.join(names, "cid")
    mine = classes.join(novel_ism.select("cid", "start", "end", "name").withColumnsRenamed({"start": "m_start", "end": "m_end"}), "cid")
    itself = F.struct(F.col("m_start").cast("long").alias("start"), F.lit(True).alias("outer_start"), F.col("m_end").cast("long").alias("end"), F.lit(True).alias("outer_end"))
    mine = stored(mine.withColumn("ok", _ends(itself, "start", "end", cfg)))
    others = ism.join(names.select("cid"), "cid", "left_anti").select("cid")
    closed = novel.inside.select("cid").distinct()
    holding = novel.within.where(F.col("kind") == ISM).join(others, "cid", "left_semi").join(target, "long")
    holding = holding.join(novel.inside, ["cid", "long"], "left_semi").unionByName(holding.join(closed, "cid", "left_anti"))
    plain = novel.listed.join(others, "cid", "left_semi").join(closed, "cid", "left_anti")
    options = holding.select("cid", F.col("long").alias("target"), "free", F.lit(1).cast("long").alias("copies"), "number", "name").unionByName(plain.select("cid", "target", "free", "variant", "copies"), allowMissingColumns=True)
    options = stored(options)
    many = options.groupBy("cid").agg(F.sum("copies").alias("options"))
    ways = options.select("cid", "target", "free").distinct()  # classes needn't meet each isoform
    met = salted_join(classes, ways, "cid", _rows_of(classes), classes.count()).where(_ends(F.col("free"), "start", "end", cfg))
    met = stored(met.groupBy("cid", "sample", "start", "end").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("target")).alias("targets")).join(many, "cid"))

    # counts
    single = lambda pairs: pairs.groupBy("cid").agg(F.min("long").alias("only"), F.count("*").alias("many"))
    given = held.select("cid", "long").unionByName(loose)
    alone = single(given).where("many = 1").select("cid", "only")
    moves = initial.join(alone, "cid").select(F.col("only").alias("cid"), "sample", "n")
    moves = moves.unionByName(met.where("options = 1").select(F.element_at("targets", 1).alias("cid"), "sample", "n"))
    moves = moves.unionByName(mine.where("not ok").select("cid", "sample", (-F.col("n")).alias("n")))
    counted = initial.join(pool, "cid", "left_semi")
    direct = counted.unionByName(moves).groupBy("cid", "sample").agg(F.sum("n").alias("n"))
    shared = given.join(single(given).where("many > 1").select("cid"), "cid", "left_semi").join(initial, "cid")
    number = lambda *c: F.sha2(F.concat_ws(",", *c), 256)
    shared = shared.select(number(F.lit("chain"), F.col("cid").cast("string"), "sample").alias("evidence"), F.col("long").alias("cid"), "sample", "n")
    sets = met.where("options > 1").groupBy("cid", "sample", "targets").agg(F.sum("n").alias("n"))
    several = sets.select(number(F.lit("class"), F.col("cid").cast("string"), "sample", F.col("targets").cast("string")).alias("evidence"), F.explode("targets").alias("cid"), "sample", "n")
    return Assigned(stored(direct), stored(shared.unionByName(several)), held, loose, mine, options)


def named(chains: DataFrame, classes: DataFrame, isoforms: DataFrame, variants: DataFrame, matches: DataFrame, novel: Novel, assigned: Assigned, cfg: QuantConfig) -> DataFrame:
    """(cid, sample, start, end, class, isoforms): what each read class is compatible with, annotated isoforms by id, then novel ones by number.

    Counts don't need it, and the lists grow with read classes times isoforms.
    """
    names, per, total = _numbered(novel), _rows_of(classes), classes.count()
    item = lambda k, n: F.struct(k.alias("k"), n.alias("n"))
    listing = F.transform(F.array_sort(F.collect_list("x")), lambda v: v["n"]).alias("isoforms")
    numbered_name = item(F.lpad(F.col("number").cast("string"), 20, "0"), F.col("name")).alias("x")
    single = stored(isoforms.join(variants, ALIKE).select("variant", item(F.concat(F.lit(" "), "transcript_id"), F.col("transcript_id")).alias("x")))

    own = names.join(chains.where(F.col("category").isin(NIC, NNC)).select("cid"), "cid", "left_semi")
    part_names = assigned.held.select("cid", numbered_name).unionByName(own.select("cid", numbered_name)).groupBy("cid").agg(listing)
    whole = stored(matches.where("same").select("cid", "variant").join(single, "variant").select("cid", "x"))
    fitting = whole.unionByName(names.select("cid", numbered_name)).withColumnRenamed("cid", "long")
    failed_names = assigned.loose.join(fitting, "long").groupBy("cid").agg(listing)
    ism = chains.where(F.col("category") == ISM)
    others = ism.join(names.select("cid"), "cid", "left_anti").select("cid")
    options = assigned.options.where("variant is null").select("cid", "free", numbered_name).unionByName(assigned.options.join(single, "variant").select("cid", "free", "x"))
    met = salted_join(classes, stored(options), "cid", per, total).where(_ends(F.col("free"), "start", "end", cfg))
    met = met.groupBy("cid", "sample", "start", "end").agg(listing)

    none = F.array().cast("array<string>")
    by_chain = chains.where(F.col("category") != ISM).select("cid", F.col("category").alias("class"))
    lists = stored(by_chain.join(whole.groupBy("cid").agg(listing).unionByName(part_names).unionByName(failed_names), "cid", "left").join(per, "cid"))
    where = ["cid", "start", "end"]
    out = attach(classes.select("sample", *where), lists, ["cid"], total).select("sample", *where, "class", F.coalesce("isoforms", none).alias("isoforms"))
    rest = classes.join(others, "cid", "left_semi").select("sample", *where).join(met.select("sample", *where, "isoforms"), ["sample", *where], "left")
    out = out.unionByName(rest.select("sample", *where, F.lit(ISM).alias("class"), F.coalesce("isoforms", none).alias("isoforms")))
    out = out.unionByName(assigned.mine.select("sample", *where, F.when(F.col("ok"), NIC).otherwise(ISM).alias("class"), F.when(F.col("ok"), F.array("name")).otherwise(none).alias("isoforms")))
    return stored(out)


def maximise(chains: DataFrame, assigned: Assigned, samples: list[str], cfg: QuantConfig, trace: bool = False) -> DataFrame:
    """(cid, sample, em) by expectation maximisation, one stop test for all samples of a read group; with trace each round of it (chr, group_id, round, cid, sample, em)."""
    at = F.create_map(*[F.lit(x) for i, s in enumerate(samples) for x in (s, i)]) if samples else F.create_map(F.lit(""), F.lit(0))
    target = (F.col("cid") * max(len(samples), 1) + at[F.col("sample")]).cast("long").alias("target")
    key = chains.select("cid", F.concat_ws(":", "chr", F.col("group_id").cast("string")).alias("grp"))
    shape = lambda d, *more: d.join(key, "cid").select("grp", *more, target, "n")
    out = ct.em_allocate(stored(shape(assigned.direct)), stored(shape(assigned.evidence, "evidence")), "grp", "target", max_iterate=cfg.max_iterate, converged=cfg.converged, trace=trace)
    sample = F.get(F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>"), F.pmod("target", F.lit(max(len(samples), 1))).cast("int"))
    out = out.withColumn("cid", F.floor(F.col("target") / max(len(samples), 1))).withColumn("sample", sample)
    if not trace:
        return out.select("cid", "sample", "em")
    return out.join(chains.select("cid", *GROUP), "cid").select(*GROUP, "round", "cid", "sample", "em")


def report(chains: DataFrame, classes: DataFrame, isoforms: DataFrame, variants: DataFrame, matches: DataFrame, novel: Novel, em: DataFrame, samples: list[str], cfg: QuantConfig) -> tuple[DataFrame, DataFrame]:
    """(abundance: transcript_id, transcript_name, gene_id, sample, count; structures: transcript_id, gene_id, source, chr, start0, end, codes, strand).

    Reads of an FSM chain are split over its isoforms by how many end near each one's ends, equally where none do; an isoform
    without such reads is left out where others have some. A novel isoform's genes are those of the isoforms that
    share junctions with it, most junctions first.
    """
    each = F.explode(F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")).alias("sample")
    whole = stored(matches.where("same").select("cid", "variant").join(variants, "variant"))
    near = salted_join(classes, whole.select("cid", "variant", "i_start", "i_end"), "cid", _rows_of(classes), classes.count())
    near = near.where((F.abs(F.col("i_start") - F.col("start")) <= cfg.sj_dist) & (F.abs(F.col("i_end") - F.col("end")) <= cfg.sj_dist))
    near = near.groupBy("cid", "variant", "sample").agg(F.sum("n").alias("near"))
    grid = whole.select("cid", "variant", "copies", each).join(near, ["cid", "variant", "sample"], "left").join(em, ["cid", "sample"], "left").na.fill(0, ["near", "em"])
    split = ct.proportional_split(grid, ["cid", "sample"], "near", "em", "count", "copies")
    total = F.sum("near").over(Window.partitionBy("cid", "sample"))
    split = split.withColumn("seen", F.when(total > 0, F.col("near") > 0).otherwise(F.col("em") > 0))
    split = split.withColumn("seen", F.max("seen").over(Window.partitionBy("cid", "variant"))).where("seen")
    split = stored(split.select("cid", "variant", "sample", "count").join(whole, ["cid", "variant"]).select("cid", *ALIKE, "sample", "count"))
    long_ = chains.join(novel.longest.select("cid", "number"), "cid")
    holds = isoforms.select("chr", F.explode("i_codes").alias("c"), "gene_id")
    votes = long_.select("cid", "chr", F.explode("codes").alias("c")).join(holds.groupBy("chr", "c", "gene_id").agg(F.count("*").alias("votes")), ["chr", "c"]).groupBy("cid", "gene_id").agg(F.sum("votes").alias("votes"))
    genes = votes.groupBy("cid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), F.col("gene_id").alias("g")))), lambda x: x["g"]), ",").alias("gene_id"))
    new = stored(long_.join(genes, "cid", "left").select("cid", novel_name().alias("transcript_id"), F.coalesce("gene_id", F.lit("NA")).alias("gene_id"), "chr", "start", "end", "codes", "strand"))
    new_counts = new.select("cid", "transcript_id", F.lit("NA").alias("transcript_name"), "gene_id", each).join(em, ["cid", "sample"], "left").withColumn("count", c_round(F.coalesce("em", F.lit(0.0))))
    columns = ["transcript_id", "transcript_name", "gene_id", "sample", "count"]
    single = lambda d: isoforms.join(d.hint("shuffle_hash"), ALIKE)
    abundance = single(split).select(*columns).unionByName(new_counts.select(*columns))
    strands = chains.select("cid", "chr", "codes", "strand")
    old = single(split.select("cid", *ALIKE).distinct()).select("cid", "transcript_id", "gene_id", "i_start", "i_end").join(strands, "cid")
    shape = ["transcript_id", "gene_id", "source", "chr", "start0", "end", "codes", "strand"]
    old = old.select("transcript_id", "gene_id", F.lit("annotated_isoform").alias("source"), "chr", F.col("i_start").cast("long").alias("start0"), F.col("i_end").cast("long").alias("end"), "codes", "strand")
    new = new.select("transcript_id", "gene_id", F.lit("novel_isoform").alias("source"), "chr", (F.col("start") - 1).cast("long").alias("start0"), F.col("end").cast("long").alias("end"), "codes", "strand")
    return abundance, old.select(*shape).unionByName(new.select(*shape))
