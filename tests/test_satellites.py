"""Sinks, comparison, tracks, specificity, rebuilt alignments, balancing and streams."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from synthetic import World

from tessera.plans import balance, compare, corrected_sam, specificity, visualize
from tessera.sinks import text as sink
from tessera.sources import alignments as al
from tessera.sources import annotation as an
from tessera.sources import genome as gn
from tessera.sources import results as rs
from tessera.streaming import merge

CHAIN = "array<struct<start:int,end:int>>"
STRUCTURE = f"transcript_id string, gene_id string, source string, chr string, start0 long, end long, chain {CHAIN}, strand string"


@pytest.fixture(scope="module")
def structures(spark):
    return spark.createDataFrame([("t1", "g1", "annotated_isoform", "c", 10, 100, [(30, 50)], "+"), ("TSR:c:0:0", "g1", "novel_isoform", "c", 12, 90, [(30, 60)], "-"), ("s", "g2", "annotated_isoform", "c", 200, 220, [], "+")], STRUCTURE)


def lines(df):
    return [r.value for r in df.collect()]


def test_gtf(structures, spark, tmp_path):
    got = lines(sink.gtf(structures))
    assert len(got) == 8
    assert got[0] == 'c\tannotated_isoform\ttranscript\t11\t100\t.\t+\t.\ttranscript_id "t1"; gene_id "g1";'
    assert got[1:3] == ['c\tannotated_isoform\texon\t11\t30\t.\t+\t.\ttranscript_id "t1"; gene_id "g1"; exon_number "1";', 'c\tannotated_isoform\texon\t51\t100\t.\t+\t.\ttranscript_id "t1"; gene_id "g1"; exon_number "2";']
    sink.write_lines(sink.gtf(structures), str(tmp_path / "gtf"))
    assert {(r.transcript_id, r.gene_id) for r in rs.read_gene_map(spark, str(tmp_path / "gtf")).collect()} == {("t1", "g1"), ("TSR:c:0:0", "g1"), ("s", "g2")}
    back = an.transcripts(an.read_exons(spark, str(tmp_path / "gtf"))).collect()
    assert {r.transcript_id: [(j.start, j.end) for j in r.chain] for r in back} == {"t1": [(30, 50)], "TSR:c:0:0": [(30, 60)], "s": []}


def test_abundance_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("t1", "T1", "g", "x", 1.005), ("t1", "T1", "g", "y", 2.0), ("t2", None, "g", "x", 3.5)], "transcript_id string, transcript_name string, gene_id string, sample string, count double")
    m = sink.abundance_matrix(a, ["x", "y"])
    assert {r.transcript_ID: (r.transcript_name, r.x, r.y) for r in m.collect()} == {"t1": ("T1", "1.00", "2.00"), "t2": ("NA", "3.50", "0.00")}
    sink.write_matrix(m, str(tmp_path / "m"))
    back = rs.read_abundance(spark, str(tmp_path / "m"))
    assert {(r.transcript_id, r.sample): r["count"] for r in back.collect()} == {("t1", "x"): 1.0, ("t1", "y"): 2.0, ("t2", "x"): 3.5, ("t2", "y"): 0.0}
    (tmp_path / "bad.tsv").write_text("transcript_ID\ttranscript_name\tgene_ID\tx\nt\tn\tg\tnope\n")
    with pytest.raises(Exception, match="not a number"):
        rs.read_abundance(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "head.tsv").write_text("a\tb\tc\nt\tn\tg\n")
    with pytest.raises(ValueError, match="header"):
        rs.read_abundance(spark, str(tmp_path / "head.tsv"))


def test_compatible_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("r1", "x", "FSM", ["b", "a"]), ("r2", "x", "NIC", ["TSR:chr2:0:1"]), ("r3", "y", "NNC", [])], "read_id string, sample string, class string, isoforms array<string>")
    assert lines(sink.compatible(c))[0] == "r1\tx\tFSM\tb,a,"
    sink.write_lines(sink.compatible(c), str(tmp_path / "c"))
    back = {r.read_id: (r.isoforms, r.is_novel, r.chr) for r in rs.read_compatible(spark, str(tmp_path / "c")).collect()}
    assert back == {"r1": (["a", "b"], False, None), "r2": (["TSR:chr2:0:1"], True, "chr2"), "r3": ([], False, None)}


SJ = "array<struct<start:int,end:int,strand:string,orig_start:int,orig_end:int,status:string,score:double,pos:int>>"


def test_corrected_features(spark, tmp_path):
    rows = spark.createDataFrame([("r", "x", "c", 3, "0", 5, 300, 0, [(20, 30, "0", None, None, "added", 0.9, 9), (50, 60, "0", 52, 62, "corrected", 0.5, 40), (None, None, None, 90, 99, "fail", None, 70)])], f"read_id string, sample string, chr string, group_id long, strand string, start int, end int, flag int, sjs {SJ}")
    got = lines(sink.corrected_features(rows))
    assert len(got) == 9 and got[4].startswith("r\tSJ\t0\tNA\t") and "\tSJ\t2\tc:52:62\tNA\tNA\tcorrected\tc:50:60:0\t" in got[5]
    sink.write_lines(sink.corrected_features(rows), str(tmp_path / "f"))
    back = rs.read_corrected(spark, str(tmp_path / "f")).collect()[0]
    assert (back.group_id, back.sample, back.chr, back.start.corr, back.end.corr) == (3, "x", "c", 5, 300)
    assert [(j.status, j.corr and j.corr.start) for j in back.sjs] == [("added", 20), ("corrected", 50), ("fail", None)]


def test_bed_and_sizes(spark, tmp_path, structures):
    w = World()
    w.add_chromosome("c", [3])
    (tmp_path / "a.gtf").write_text(w.gtf({"T": (w.genes[0], [0, 1, 2])}))
    t = an.transcripts(an.read_exons(spark, str(tmp_path / "a.gtf")))
    sink.write_lines(sink.bed12(t), str(tmp_path / "bed"))
    back = an.read_bed12(spark, str(tmp_path / "bed")).collect()[0]
    assert [(b.start, b.end) for b in back.blocks] == w.genes[0].exons and back.name == "T"
    (tmp_path / "bad.bed").write_text("c\t0\t9\tx\t0\t+\t0\t9\t0\t2\t3,\t0,\n")
    with pytest.raises(Exception, match="blocks"):
        an.read_bed12(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "s").write_text("c\t100\n")
    sizes = an.read_chrom_sizes(spark, str(tmp_path / "s"))
    (tmp_path / "j.bed").write_text("c\t5\t20\tx\t0\t-\n")
    assert [tuple(r) for r in an.read_junction_bed(spark, str(tmp_path / "j.bed"), sizes).collect()] == [("c", 5, 20, "1")]
    (tmp_path / "k.bed").write_text("c\t5\t200\tx\t0\t-\n")
    with pytest.raises(Exception, match="bad junction"):
        an.read_junction_bed(spark, str(tmp_path / "k.bed"), sizes).collect()
    assert an.parse_track_line('track type=bedGraph name="a b"') == {"type": "bedGraph", "name": "a b"}


def test_samples(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("a.sam\tx\nb.bam\ty\n")
    assert [tuple(r) for r in al.read_samples(spark, str(tmp_path / "s.tsv")).orderBy("file_id").collect()] == [("a.sam", "x", 0), ("b.bam", "y", 1)]
    for bad in ("a.txt\tx\n", "a.sam\tx\na.sam\ty\n", "a.sam\t\n"):
        (tmp_path / "b.tsv").write_text(bad)
        with pytest.raises(Exception, match="no .sam|listed twice|no sample"):
            al.read_samples(spark, str(tmp_path / "b.tsv")).collect()
    assert al.sample_rows("a,b", "x,y") == [("a", "x"), ("b", "y")]
    with pytest.raises(ValueError):
        al.sample_rows("a,b", "x")
    assert sink.rename_collisions(["a/x.sam", "b/x.sam", "y.bam"]) == {"a/x.sam": "x.sam", "b/x.sam": "x_1.sam", "y.bam": "y.sam"}


CODE = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
BAM_HEAD = b"BAM\1" + struct.pack("<i", 4) + b"@HD\t" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", 1000) for n in (b"chr1", b"chr2"))


def bgzf(raw, size):
    """Blocks of size bytes each, and the empty one at the end."""
    blocks = []
    for at in [*range(0, len(raw), size), len(raw)]:
        part = raw[at : at + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        blocks.append(al.BLOCK_MAGIC.encode("latin-1") + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return blocks


def bam_record(name, ref, pos, cigar, seq, flag=0, qual=40):
    packed = bytes(CODE[a] << 4 | CODE[b] for a, b in zip(seq[::2], seq[1::2] + "=" * (len(seq) % 2), strict=True))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 30, 0, len(cigar), flag, len(seq), -1, -1, 0) + name + b"\0" + struct.pack(f"<{len(cigar)}I", *cigar) + packed + bytes([qual] * len(seq)) + b"NMC\x05"
    return struct.pack("<i", len(body)) + body


def bam_rows(seed, n):
    r = random.Random(seed)
    return b"".join(bam_record(f"read{i}".encode(), r.choice([0, 1, -1]), r.randrange(900), [(m << 4) | r.choice([0, 3, 4]) for m in r.sample(range(1, 30), r.randrange(4))], "".join(r.choice("ACGTN") for _ in range(r.choice([1, 20, 300]))), r.choice([0, 16]), r.choice([0, 1, 33, 40])) for i in range(n))


def test_bam(spark, tmp_path):
    raw = BAM_HEAD + bam_record(b"r1", 0, 6, [(10 << 4) | 0, (5 << 4) | 3, (10 << 4) | 0], "ACGTACGTACGTACGTACGT", 16)
    (tmp_path / "x.bam").write_bytes(b"".join(bgzf(raw, len(raw) // 2)))
    (tmp_path / "y.sam").write_text("@HD\tx\nr2\t0\tchr2\t5\t9\t4M\t*\t0\t0\tACGT\t*\n")
    got = {r.read_id: r for r in al.read_sam(spark, [(str(tmp_path / "y.sam"), "t"), (str(tmp_path / "x.bam"), "s")]).collect()}
    r = got["r1"]
    assert (r.flag, r.chr, r.start, r.mapq, r.cigar, r.seq, r.qual, r.tags, r.file_id, r["sample"]) == (16, "chr1", 7, 30, "10M5N10M", "ACGT" * 5, "I" * 20, ["NM:i:5"], 1, "s")
    assert (got["r2"].chr, got["r2"].file_id, got["r2"]["sample"]) == ("chr2", 0, "t")


@pytest.mark.parametrize("size", [60, 251, 1000])
def test_bam_cut_at_every_block(size):
    """Whatever block a split begins with, and however many splits there are, the records are the same."""
    raw = bam_rows(size, 40)
    want = list(al.decode_whole(raw))
    head = len(BAM_HEAD)
    magic = len(al.BLOCK_MAGIC)
    blocks = [al.inflate(b[magic:]) for b in bgzf(BAM_HEAD + raw, size)]

    def decode(cuts):
        rows, loose = [], b""
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(blocks)], strict=True)):
            for kind, x in al.decode_split(iter(blocks[a:b]), 2, head if n == 0 else None):
                if kind == "row" and loose:
                    rows, loose = [*rows, *al.decode_whole(loose)], b""
                if kind == "row":
                    rows.append(x)
                else:
                    loose += x
        return rows + list(al.decode_whole(loose))

    first = -(-head // size) + 1
    for cut in range(first, len(blocks), 1 if size > 100 else 7):
        assert decode([cut]) == want
    r = random.Random(size)
    for _ in range(20):
        assert decode(sorted(r.sample(range(first, len(blocks)), min(6, len(blocks) - first)))) == want


@pytest.mark.parametrize("split", [700, 2500])
def test_bam_by_splits(spark, tmp_path, split):
    for name, n in (("a", 60), ("b", 25)):
        (tmp_path / f"{name}.bam").write_bytes(b"".join(bgzf(BAM_HEAD + bam_rows(n, n), 200)))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        rows = al.read_sam(spark, [(str(tmp_path / f"{n}.bam"), n) for n in "ab"]).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len({(r["sample"], r.line.block) for r in rows}) > 4
    for name, n in (("a", 60), ("b", 25)):
        own = sorted((r for r in rows if r["sample"] == name), key=lambda r: r.line)
        names = ["chr1", "chr2", "*"]
        assert [(r.read_id, r.flag, r.chr, r.start, r.mapq, r.cigar, r.seq, r.qual, r.tags) for r in own] == [(*x[:2], names[x[2]], *x[3:]) for x in al.decode_whole(bam_rows(n, n))]


def test_damaged_bam(spark, tmp_path):
    blocks = bgzf(BAM_HEAD + bam_rows(1, 30), 200)
    for bad in (blocks[:-3], blocks[:4] + blocks[6:], [*blocks[:3], blocks[3][:-5] + b"12345", *blocks[4:]]):  # cut off, blocks gone, bytes changed
        (tmp_path / "x.bam").write_bytes(b"".join(bad))
        with pytest.raises(Exception, match="BAM|BGZF|struct|unpack"):
            al.read_sam(spark, [(str(tmp_path / "x.bam"), "s")]).collect()


def test_bam_tags_and_long_cigars():
    """All types of tags, and the CIGAR in CG where the record holds a stand-in."""
    tags = b"NMC\x05" + b"asi" + struct.pack("<i", -70000) + b"tsA+" + b"RGZgroup 1\0" + b"dvf" + struct.pack("<f", 0.25) + b"MLBC" + struct.pack("<i2B", 2, 7, 255)
    ops = [(2 << 4) | 0, (30 << 4) | 3, (2 << 4) | 7]

    def record(cigar, extra):
        body = struct.pack("<iiBBHHHiiii", 0, 6, 3, 30, 0, len(cigar), 0, 4, -1, -1, 0) + b"r1\0" + struct.pack(f"<{len(cigar)}I", *cigar) + bytes([0x12, 0x48]) + b"\xff" * 4 + tags + extra
        return struct.pack("<i", len(body)) + body

    stand_in = [(4 << 4) | 4, (34 << 4) | 3]
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + record(ops, b"") + record(stand_in, b"CGBI" + struct.pack("<i3I", 3, *ops)) + record(stand_in, b"")
    rows = list(al.decode_whole(raw[al.header(raw)[1] :]))
    want = ["NM:i:5", "as:i:-70000", "ts:A:+", "RG:Z:group 1", "dv:f:0.25", "ML:B:C,7,255"]
    assert [(r[5], r[8]) for r in rows] == [("2M30N2=", want), ("2M30N2=", want), ("4S34N", want)]
    assert rows[0][6:8] == ("ACGT", None)


def test_fastq(spark, tmp_path):
    (tmp_path / "q" / "pass").mkdir(parents=True)
    (tmp_path / "q" / "pass" / "a.fastq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nGG\n+\nII\n")
    assert sorted(tuple(r) for r in al.combine_fastq(spark, str(tmp_path / "q")).collect()) == [("r1 x", "ACGT", "@III"), ("r2", "GG", "II")]


@pytest.mark.parametrize("split", [90, 333])
def test_fastq_by_splits(spark, tmp_path, split):
    """Qualities that begin with @ or +, and splits that begin anywhere."""
    r = random.Random(split)
    want = []
    for f in "ab":
        rows = [(f"{f}{i}", "".join(r.choice("ACGT") for _ in range(n)), "".join(r.choice("@+I") for _ in range(n))) for i in range(40) for n in [r.randrange(30)]]
        (tmp_path / f"{f}.fastq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows) + "\n" * (f == "a"))
        want += rows
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = al.combine_fastq(spark, str(tmp_path)).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sorted(tuple(x) for x in got) == sorted(want)
    (tmp_path / "c.fastq").write_text("@x\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        al.combine_fastq(spark, str(tmp_path)).collect()


AB = "transcript_id string, transcript_name string, gene_id string, sample string, count double"


def test_compare(spark, structures):
    a = spark.createDataFrame([("t1", "T", "g1", "x", 4.0), ("TSR:c:0:0", "NA", "g1", "x", 2.0)], AB)
    b = spark.createDataFrame([("t1", "T", "g1", "x", 6.0), ("TSR:c:0:7", "NA", "g1", "x", 2.0), ("s", "S", "g1,g2", "x", 1.0)], AB)
    other = structures.withColumn("transcript_id", F.regexp_replace("transcript_id", "0:0$", "0:7"))
    got = {r.transcript_id: (r.count_a, r.count_b, r.abs_diff, r.ratio_diff) for r in compare.annotated(a, b).collect()}
    assert got["t1"] == (4.0, 6.0, 2.0, 0.5) and got["s"] == (None, 1.0, 1.0, -1.0)
    n = compare.novel(a.where("transcript_id like 'TSR%'"), structures, b.where("transcript_id like 'TSR%'"), other).collect()
    assert [(r.id_a, r.id_b, r.abs_diff) for r in n] == [("TSR:c:0:0", "TSR:c:0:7", 0.0)]
    g = {r.gene_id: (r.count_a, r.count_b) for r in compare.genes(compare.annotated(a, b)).collect()}
    assert g["g2"] == (None, 1.0) and g["g1"][0] == 6.0
    ra = spark.createDataFrame([("r", "x", ["a", "b"]), ("q", "x", ["a"])], "read_id string, sample string, isoforms array<string>")
    rb = spark.createDataFrame([("r", "x", ["b", "c"]), ("q", "x", ["a"])], "read_id string, sample string, isoforms array<string>")
    assert [tuple(r) for r in compare.reads(ra, rb).collect()] == [("x", "r", ["a"], ["c"], ["b"])]
    assert compare.per_transcript(compare.annotated(a, b)).where("transcript_id = 't1'").first().max_abs_diff == 2.0


def test_tracks(spark, structures):
    a = spark.createDataFrame([("t1", "N-1", "g1.2", "x", 2.0), ("TSR:c:0:0", "NA", "g1.2", "x", 1.0), ("s", "S", "g2", "x", 0.0)], AB)
    seg = sorted((r.seg_start, r.seg_end, r.depth) for r in visualize.sample_coverage(a, structures).collect())
    assert seg == [(10, 12, 2.0), (12, 30, 3.0), (50, 60, 2.0), (60, 90, 3.0), (90, 100, 2.0)]
    t = visualize.gene_tracks(a, structures, "g1", 1.0)
    assert {r.transcript_id: r.color for r in t.collect()} == {"t1": "0,0,255", "TSR:c:0:0": "255,0,0"}
    assert sorted((r.transcript_id, r.cpm) for r in visualize.normalize(a).collect()) == [("TSR:c:0:0", 333333.33), ("s", 0.0), ("t1", 666666.67)]
    track = sink.bedgraph(visualize.sample_coverage(a, structures), "x", "0,0,0")
    assert lines(track["lines"])[0] == "c\t10\t12\t2.0" and "bedGraph" in track["header"]


def test_specificity(spark):
    rows = [("t1", "n", "g", "x", 90.0), ("t2", "n", "g", "x", 10.0), ("t1", "n", "g", "y", 12.0), ("t2", "n", "g", "y", 88.0), ("u1", "n", "h", "x", 50.0), ("u2", "n", "h", "x", 50.0), ("u1", "n", "h", "y", 50.0), ("u2", "n", "h", "y", 50.0), ("v", "n", "NA", "x", 9.0)]
    got = {(r.transcript_id, r.sample): r for r in specificity.run(spark.createDataFrame(rows, AB)).collect()}
    assert set(got) == {("t1", "x"), ("t2", "y")}
    assert got["t1", "x"].proportion_sample == 0.9 and got["t1", "x"].p_adj < 1e-6


def test_rebuilt_alignments(spark, tmp_path):
    w = World(seed=5)
    w.add_chromosome("c", [3])
    g = w.genes[0]
    rows = [w.read("a", g, [0, 1, 2]), w.read("f", g, [0, 1])]
    (tmp_path / "g.fa").write_text(w.fasta())
    (tmp_path / "r.sam").write_text(w.sam(rows))
    reads = al.read_sam(spark, [(str(tmp_path / "r.sam"), "x")])
    genome = gn.read_fasta(spark, str(tmp_path / "g.fa"))
    s, e = g.exons[0][1], g.exons[1][0]
    js = [(s - 2, e - 2), (g.exons[1][1], g.exons[2][0])]
    full = lambda j: (j[0], j[1], "0", j[0], j[1], "pass", 1.0, 0)
    c = spark.createDataFrame([("a", "x", "c", 0, "0", g.exons[0][0] + 1, g.exons[2][1], 0, [full(j) for j in js]), ("f", "x", "c", 0, "0", g.exons[0][0] + 1, g.exons[1][1], 0, [(None, None, None, s, e, "fail", None, 0)])], f"read_id string, sample string, chr string, group_id long, strand string, start int, end int, flag int, sjs {SJ}")
    got = {r.read_id: r for r in corrected_sam.run(reads, c, genome).collect()}
    assert got["f"].cigar == rows[1][5]
    n = [e - s for s, e in g.exons]
    assert got["a"].cigar == f"{n[0] - 2}M{e - s}N{n[1] + 2}M{g.exons[2][0] - g.exons[1][1]}N{n[2]}M"
    assert got["a"].start == g.exons[0][0] + 1
    text = lines(sink.sam(corrected_sam.run(reads, c, genome), gn.chromosome_order(genome)))
    assert text[0].startswith("@SQ\tSN:c\tLN:") and len(text) == 3
    assert corrected_sam.read_cuts("10M", 1, 5, 8, [(8, 6)]) is None


def test_balance(spark):
    reads = spark.createDataFrame([(g,) for g in range(6) for _ in range(10 * (g + 1))], "group_id int")
    jobs = {r.group_id: (r.n, r.bin) for r in balance.jobs(reads, 70).collect()}
    assert sum(n for n, _ in jobs.values()) == 210 and len({b for _, b in jobs.values()}) <= 4
    for b in {b for _, b in jobs.values()}:
        assert sum(n for n, x in jobs.values() if x == b) <= 2 * 70
    assert balance.by_job(reads, balance.jobs(reads, 70)).count() == 210


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1, "ts": "2024-01-01T00:00:00"}\n{"k": 1, "ts": "2024-01-01T00:05:00"}\n{"k": 1, "ts": "2024-01-01T02:00:00"}\n')
    (tmp_path / "in" / "b.json").write_text('{"k": 2, "ts": "2024-01-02T00:00:00"}\n')
    source = spark.readStream.schema("k int, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = merge.merge_sessions(source, "k", "ts", "10 minutes", "1 minute").writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("merged").collect() if r.k == 1) == [1, 2]


def test_intervals_of_a_stream(spark, tmp_path):
    """Groups of a stream with late rows are those of merge_intervals over all its rows; what is too late is dropped."""
    from tessera.operators.intervals import merge_intervals

    r = random.Random(8)
    base, rows = 1_700_000_000, []
    for batch in range(6):
        for _ in range(40):
            s = base + batch * 1800 + r.randrange(-1500, 1800)  # up to 55 minutes late
            rows.append((batch, r.choice("ab"), s, s + r.choice([0, 5, 60, 4000])))
    rows += [(6, k, base + 10**6, base + 10**6) for k in "ab"] + [(7, "a", base, base + 5), (7, None, base + 10**6, base + 10**6)]  # far ahead, then too late
    when = lambda c: F.timestamp_seconds(c).alias(c)
    df = spark.createDataFrame(rows, "batch int, k string, s long, e long")
    for i in range(8):
        df.where(f"batch = {i}").select("k", when("s"), when("e")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, s timestamp, e timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = merge.merge_stream(source, "k", "s", "e", "1 hour", extra=30_000_000)
    q = out.writeStream.format("memory").queryName("merged_intervals").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((x.k, int(x.g_start.timestamp()), int(x.g_end.timestamp()), x.n) for x in spark.table("merged_intervals").collect())
    want = merge_intervals(df.where("batch < 6"), ["k"], "s", "e", 30).collect()
    assert got == sorted((x.k, x.g_start, x.g_end, x.n) for x in want) and len(got) > 4


def test_feature_log(spark, tmp_path):
    (tmp_path / "l").write_text("isoform id: a, diff: 2\n\nread id: r, diff: 1\n")
    got = compare.parse_pairs(rs.read_comparison_log(spark, str(tmp_path / "l"), ("isoform", "read"))).collect()
    assert ("isoform", "diff", "2") in [tuple(r) for r in got] and len(got) == 4
    (tmp_path / "m").write_text("what: 1\n")
    with pytest.raises(Exception, match="unknown line"):
        rs.read_comparison_log(spark, str(tmp_path / "m"), ("isoform",)).collect()
