"""Column functions and filters on small rows."""

import pytest
from pyspark.sql import functions as F

from tessera.config import ScanConfig
from tessera.functions import cigar, names, numeric, seq
from tessera.operators import chains, counts, intervals
from tessera.plans import scan


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_cigar_deletions_and_equal_signs(spark):
    rows = spark.createDataFrame([("10M30D10M",), ("10M31D10M",), ("5=1X4=100N3S",), ("2H3S10M5I4M2S",)], "c string")
    got = [r.s for r in cigar.with_summary(rows, "c", "s", 30).collect()]
    assert [list(s.exon_intron) for s in got] == [[50], [10, 31, 10], [10, 100, 0], [14]]
    assert (got[1].mapped, got[1].mapped_n, got[1].deletions) == (20, 51, 0)
    assert (got[3].read_length, got[3].insertions, got[3].max_insertion, list(got[3].clips)) == (26, 5, 5, [5, 2])
    assert list(got[1].sj_read_pos) == [10]
    r = one(spark, j=cigar.junctions(F.lit(101), F.array(*map(F.lit, (10, 31, 10)))), e=cigar.exons(F.lit(101), F.array(*map(F.lit, (10, 31, 10)))), m=cigar.to_string(cigar.merge_equal(cigar.operations(F.lit("3=1X2=4I5M")))))
    assert [tuple(x) for x in r.j] == [(110, 141)] and [tuple(x) for x in r.e] == [(100, 110), (141, 151)] and r.m == "6M4I5M"


def test_ordered_filters(spark):
    genome = spark.createDataFrame([("chr1", "A" * 500, 500), ("chrM", "A" * 500, 500)], "chr string, seq string, len int")
    rows = [(f"m{q}", 0, "chr1", 1, q, "50M") for q in range(1, 10) for _ in range(2)]
    rows += [("mt", 256, "chrM", 1, 0, "50M"), ("sec", 256, "chr1", 1, 0, "50M"), ("ins", 0, "chr1", 1, 9, "10M20I10M"), ("over", 0, "chr1", 480, 9, "50M"), ("un", 4, "*", 0, 0, "*")]
    df = spark.createDataFrame(rows, "read_id string, flag int, chr string, start int, mapq int, cigar string")
    got = {r.drop_reason: r["count"] for r in scan.parse(df, genome, ScanConfig(mapq_cutoff=3)).groupBy("drop_reason").count().collect()}
    assert got == {None: 14, "mapping_quality": 4, "mitochondrial": 1, "secondary": 1, "max_insertion": 1, "exceeding_chromosome": 1, "unmapped": 1}


def test_sequences(spark):
    r = one(spark, a=seq.comp_rev(F.lit("AACGN")), b=seq.hamming(F.lit("ACgt"), F.lit("aCTT")), c=seq.hamming(F.lit("A"), F.lit("AC")), d=seq.motif_strand(F.lit("GT"), F.lit("AG")), e=seq.motif_strand(F.lit("AA"), F.lit("AA")), f=seq.is_reverse(F.lit(16)), g=seq.is_secondary(F.lit(16)))
    assert tuple(r) == ("NCGTT", 1, None, "0", None, True, False)


def test_numbers(spark):
    values = [0.125, 1.005, 2.675, 0.375, 1e6 + 0.005, 0.0]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(numeric.c_round(F.col("v")).alias("x")).collect()]
    assert got == [float(f"{v:.2f}") for v in values]
    r = one(spark, a=numeric.combination(F.lit(10), F.lit(3)), b=numeric.combination(F.lit(10), F.lit(9)), c=numeric.combination(F.lit(5), F.lit(0)), d=numeric.ratio_difference(F.lit(0.0), F.lit(2.0)), e=numeric.ratio_difference(F.lit(2.0), F.lit(3.0)), f=numeric.ratio_difference(F.lit(0.0), F.lit(0.0)), g=numeric.fake_zero(F.lit(0.001)))
    assert tuple(r) == (120.0, 10.0, 1.0, -1.0, 0.5, 0.0, 0.001)


def test_names(spark):
    a = F.lit('gene_id "G 1"; transcript_id "T"; exon_number 3;')
    r = one(spark, g=names.gtf_attribute(a, "gene_id"), e=names.gtf_attribute(a, "exon_number"), n=names.gtf_attribute(a, "gene"), s=names.strip_strand(F.lit("c:1:2:0")), k=names.coords_signature(F.lit("+"), F.array(F.lit(1), F.lit(9)), F.array(F.lit(5), F.lit(12))), o=names.coords_signature(F.lit("-"), F.array(F.lit(1)), F.array(F.lit(5))))
    assert tuple(r) == ("G 1", "3", None, "c:1:2", "+,5,9", "-,1,5")
    assert [r.x for r in spark.createDataFrame([("b",), ("10",), ("9",), ("a",)], "x string").orderBy(*names.sample_order(F.col("x"))).collect()] == ["a", "b", "9", "10"]
    assert names.version_at_least("samtools 1.10", "1.9") and not names.version_at_least("v1.2", "1.2.1") and names.output_prefix("/a/b.c.sam") == "b.c"
    with pytest.raises(ValueError):
        names.parse_version("none")


def test_chain_matches(spark):
    cases = [((1, 2), (1, 2), None, 0), ((2, 3), (1, 2, 3), 2, 1), ((1, 3), (1, 2, 3), None, None), ((None, 3), (1, 2, 3), 3, 1), ((None,), (1,), None, None), ((1, 2, 3), (1, 2), None, None), ((7, 7), (7, 7, 7), 2, 0), ((2, None), (5, 2, 2, 2), 3, 1)]
    rows = [(i, 10 * k, list(c)) for i, (s, x, _, _) in enumerate(cases) for k, c in enumerate((s, x))]
    df = spark.createDataFrame(rows, "group_id int, chain_id int, chain array<int>")
    got = {r.group_id: (r.kind, r.offset) for r in chains.subchain_pairs(df).where("short_id = 0").collect()}
    assert got == {i: (kind, at) for i, (_, _, kind, at) in enumerate(cases) if kind}
    side = lambda k, name: df.where(f"chain_id = {k}").select("group_id", F.col("chain_id").alias(f"{name}_id"), F.col("chain").alias(name))
    got = {r.group_id: r.offset for r in chains.fits(side(0, "short"), side(10, "long"), ["group_id"]).collect()}
    assert got == {i: at for i, (*_, at) in enumerate(cases) if at is not None}


def test_intervals_across_bins(spark):
    import random

    r = random.Random(3)
    rows = [(k, s, s + r.randint(0, 30)) for k in "ab" for s in (r.randrange(4000) for _ in range(120))] + [("a", None, 5), ("b", 10, 3900)]
    df = spark.createDataFrame(rows, "k string, s int, e int")
    got = sorted((x.k, x.g_start, x.g_end, x.n) for x in intervals.merge_intervals(df, ["k"], "s", "e", 3, bin_width=64).collect())
    want = []
    for k, s, e in sorted(x for x in rows if x[1] is not None):
        if want and want[-1][0] == k and s <= want[-1][2] + 3:
            want[-1] = (k, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((k, s, e, 1))
    assert got == want
    pairs = intervals.overlap_join(df.where("s is not null"), df.where("s is not null").selectExpr("k", "s as s2", "e as e2"), ["k"], "s", "e", "s2", "e2", 64)
    real = [x for x in rows if x[1] is not None]
    assert pairs.count() == sum(a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2] for a in real for b in real)


def test_bh_and_splits(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04, 0.9]
    got = [r.q for r in counts.bh_fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "q").orderBy("i").collect()]
    order = sorted(p)
    want = [min(min(x * len(p) / (k + 1) for k, x in enumerate(order) if x >= v), 1) for v in p]
    assert got == pytest.approx(want)
    s = counts.proportional_split(spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 3), ("b", 2, 1)], "g string, i int, w int").withColumn("t", F.lit(1.0)), ["g"], "w", "t", "x")
    assert sorted((r.g, r.i, r.x) for r in s.collect()) == [("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.75), ("b", 2, 0.25)]
