"""The scan and quantify steps on a synthetic genome."""

import random

import numpy as np
import pyarrow as pa
import pytest
from synthetic import World

from tessera.config import QuantConfig, ScanConfig
from tessera.operators import errors
from tessera.plans import quantify, scan
from tessera.sources import alignments as al
from tessera.sources import annotation as an
from tessera.storage import stored
from tessera.sources import genome as gn


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    w = World()
    w.add_chromosome("chr1", [4, 3], ["+", "-"])
    w.add_chromosome("chr2", [4])
    g1, g2, g3 = w.genes
    folder = tmp_path_factory.mktemp("world")
    (folder / "g.fa").write_text(w.fasta())
    (folder / "a.gtf").write_text(w.gtf({"T1": (g1, [0, 1, 2, 3]), "T2": (g2, [0, 1, 2]), "S1": (g3, [0])}))
    one = [w.read(f"a{i}", g1, [0, 1, 2, 3]) for i in range(5)]
    one += [w.read(f"b{i}", g1, [0, 2, 3]) for i in range(3)]  # skips an exon: sites known, junction new
    one += [w.read(f"c{i}", g1, [2, 3]) for i in range(2)]
    one += [w.read(f"d{i}", g2, [0, 1, 2]) for i in range(4)]
    one += [w.read("e0", g1, [0, 1, 2, 3], mapq=0), w.read("e1", g1, [0, 1, 2, 3], flag=256)]
    two = [w.read(f"f{i}", g1, [0, 1, 2, 3]) for i in range(2)] + [w.read(f"h{i}", g3, [0]) for i in range(3)]
    two += [w.read("long", g1, [0, 1, 2, 3]), ("long", 0, "chr1", g1.exons[0][0] + 1, 30, f"{g1.exons[0][1] - g1.exons[0][0]}M30S", "*")]
    (folder / "one.sam").write_text(w.sam(one))
    (folder / "two.sam").write_text(w.sam(two))
    genome = gn.read_fasta(spark, str(folder / "g.fa"))
    exons = an.read_exons(spark, str(folder / "a.gtf"))
    rows = al.read_sam(spark, [(str(folder / "one.sam"), "one"), (str(folder / "two.sam"), "two")])
    return w, genome.persist(), exons.persist(), rows.persist(), folder


@pytest.fixture(scope="module")
def scanned(world):
    _, genome, exons, rows, _ = world
    s = scan.run(rows, genome, exons)
    for d in (s.reads, s.junctions, s.groups, s.catalog):
        d.persist()
    return s


def test_sources(world, spark):
    w, genome, exons, rows, folder = world
    assert {r.chr: r.seq for r in genome.collect()} == w.chromosomes
    assert exons.count() == 8 and exons.where("gene_name = 'Nchr1g0'").count() == 4
    assert rows.count() == 23
    txs = {r.transcript_id: r for r in an.transcripts(exons).collect()}
    assert txs["T1"].start0 == w.genes[0].exons[0][0] and len(txs["T1"].chain) == 3 and txs["S1"].chain == []
    assert an.annotated_from_exons(exons).count() == 5
    with pytest.raises(ValueError, match="no sequence"):
        (folder / "empty.fa").write_text("\n")
        gn.read_fasta(spark, str(folder / "empty.fa"))


def test_windows(world, spark):
    w, genome, *_ = world
    seq = w.chromosomes["chr1"]
    spans = spark.createDataFrame([(1, "chr1", 5, 9), (2, "chr1", 60, 130), (3, "chr1", len(seq) - 4, len(seq) + 9)], "key int, chr string, s int, e int")
    got = {r.key: r.seq for r in gn.windows(spans, gn.tiles(genome, 64), "key", 64).collect()}
    assert got == {1: seq[5:9], 2: seq[60:130], 3: seq[-4:]}


def test_filters_and_groups(scanned):
    n = {r.counter: r.n for r in scanned.summary.collect()}
    assert n["filtered_mapping_quality"] == 1 and n["filtered_secondary"] == 1 and n["kept_alignments"] == 21 and n["reads"] == 20
    groups = sorted((r.chr, r.w_start) for r in scanned.groups.collect())
    assert [g[0] for g in groups] == ["chr1", "chr1", "chr2"] and groups[0][1] == 0
    assert scanned.reads.where("read_id = 'long'").count() == 1


def test_catalog(world, scanned):
    w, *_ = world
    g1, g2, _ = w.genes
    cat = {(r.chr, r.start, r.end): r for r in scanned.catalog.collect()}
    first = cat["chr1", g1.exons[0][1], g1.exons[1][0]]
    assert (first.strand, first.n_perfect, first.n_all, first.tag, first.is_hc, first.up2, first.down2) == ("0", 8, 8, 2, True, "GT", "AG")
    skip = cat["chr1", g1.exons[0][1], g1.exons[2][0]]
    assert (skip.n_perfect, skip.tag, skip.is_anno, skip.is_hc) == (3, 1, False, True)
    assert cat["chr1", g2.exons[0][1], g2.exons[1][0]].strand == "1"
    flank = {(r.start, r.end): r.flank for r in scanned.flanks.collect()}
    s, e = g1.exons[0][1], g1.exons[1][0]
    assert flank[s, e] == w.chromosomes["chr1"][s - 25 : s] + w.chromosomes["chr1"][e : e + 25]


def test_thresholds(world):
    _, genome, _, rows, _ = world
    strict = scan.run(rows, genome, None, cfg=ScanConfig(read_num_cutoff=4))
    assert strict.catalog.where("is_hc").count() == 5  # not the skipping junction, which 3 reads show
    assert strict.groups.count() == 3


def test_quantify(world, scanned):
    w, _, exons, _, _ = world
    reads = quantify.from_scan(scanned.reads, scanned.junctions, scanned.catalog)
    perfect = scanned.junctions.where("perfect").select("chr", "start", "end", "read_id")
    q = quantify.run(reads, exons, perfect, QuantConfig())
    got = {(r.transcript_id, r.sample): r["count"] for r in q.abundance.collect()}
    assert got["T2", "one"] == 4 and got["T1", "two"] == 3 and got["S1", "two"] == 3
    novel = [k for k in got if k[0].startswith("TSR:") and k[1] == "one"]
    assert len(novel) == 1
    assert got["T1", "one"] + got[novel[0]] == pytest.approx(10, abs=0.05) and got["T1", "one"] > 6 and got[novel[0]] > 3
    compat = {r.read_id: (r["class"], r.isoforms) for r in q.compatible.collect()}
    assert compat["a0"] == ("FSM", ["T1"]) and compat["b0"][0] == "NIC" and compat["h0"] == ("single-exon", ["S1"])
    assert compat["c0"][0] == "ISM" and "T1" in compat["c0"][1]
    shape = {r.transcript_id: r for r in q.structures.collect()}
    assert shape[novel[0][0]].source == "novel_isoform" and shape[novel[0][0]].gene_id == "chr1g0" and len(shape[novel[0][0]].chain) == 2


def junction_errors(ops: list[tuple[int, str]], seq: str, exons: list[str], flank: int, max_deletion: int) -> tuple[list[tuple[int, int, int]], tuple[int, int, int, int]]:
    """Errors within `flank` bases of each junction, and elsewhere, of one alignment.

    exons: reference bases of each exon. Every exon is laid out column by column (genome bases, and
    insertions between them); a junction's window is the flank genome bases on either side.
    """
    n = len(exons)
    inserts: list[list[tuple[int, int]]] = [[]]  # per exon: (genome bases before, bases)
    deletes: list[list[tuple[int, int]]] = [[]]
    state: list[list[np.ndarray]] = [[]]  # per exon, by genome base: 0 match, 1 mismatch, 2 deleted
    at_read = at_exon = 0
    seq = seq.upper()
    read = np.frombuffer(seq.encode(), np.uint8)
    ref = [np.frombuffer(e.upper().encode(), np.uint8) for e in exons]
    for size, op in ops:
        if op == "N" or (op == "D" and size > max_deletion):
            state.append([])
            inserts.append([])
            deletes.append([])
            at_exon = 0
        elif op in "M=X":
            exon = ref[len(state) - 1] if len(state) <= n else read[:0]
            a, b = read[at_read : at_read + size], exon[at_exon : at_exon + size]
            m = min(len(a), len(b))
            part = np.zeros(size, np.int8)
            part[:m] = a[:m] != b[:m]
            state[-1].append(part)
            at_read, at_exon = at_read + size, at_exon + size
        elif op == "D":
            state[-1].append(np.full(size, 2, np.int8))
            deletes[-1].append((at_exon, size))
            at_exon += size
        elif op == "S":
            at_read += size
        elif op == "I":
            inserts[-1].append((at_exon, size))
            at_read += size
    whole = [np.concatenate(x) if x else np.zeros(0, np.int8) for x in state]
    out = []
    for j in range(n - 1):
        left, right = whole[j][-flank:] if flank else whole[j][:0], whole[j + 1][:flank]
        both = np.concatenate([left, right])
        ins = sum(k for p, k in inserts[j] if len(whole[j]) - p < flank) + sum(k for p, k in inserts[j + 1] if p < flank)
        out.append((int(ins), int((both == 2).sum()), int((both == 1).sum())))
    ins = dele = sub = total = 0
    for e in range(n):
        size = len(whole[e])
        inner = whole[e][flank : max(size - flank, flank)]
        sub += int((inner == 1).sum())
        total += int((inner != 2).sum())
        more = sum(k for p, k in inserts[e] if p > flank and size - p > flank)
        less = sum(k for p, k in deletes[e] if p > flank and size - p - k > flank)
        ins, dele, total = ins + more, dele + less, total + more + less
    return out, (ins, dele, sub, total)


def test_errors_near_junctions():
    ops = [(30, "M"), (100, "N"), (30, "M")]
    seq, exons = "A" * 60, ["A" * 30, "A" * 30]
    assert junction_errors(ops, seq, exons, 10, 50) == ([(0, 0, 0)], (0, 0, 0, 20))
    near = seq[:28] + "C" + seq[29:]
    assert junction_errors(ops, near, exons, 10, 50)[0] == [(0, 0, 1)]
    far = seq[:15] + "C" + seq[16:]
    assert junction_errors(ops, far, exons, 10, 50) == ([(0, 0, 0)], (0, 0, 1, 20))
    gap = [(25, "M"), (2, "D"), (3, "M"), (100, "N"), (2, "M"), (1, "I"), (28, "M")]
    assert junction_errors(gap, "A" * 59, exons, 10, 50)[0] == [(1, 2, 0)]
    assert junction_errors([(10, "M")], "", [], 10, 50) == ([], (0, 0, 0, 0))


@pytest.mark.parametrize("flank", [0, 3, 10])
def test_errors_of_batches(flank, monkeypatch):
    """Whole batches against the column-by-column version, in slices of any size."""
    r = random.Random(flank)
    cigars, bases, refs, want = [], [], [], []
    for i in range(400):
        ops = []
        for _ in range(r.randint(1, 9)):
            ops.append((r.randint(1, 25), r.choice("MMM=XIDDNSHP")))
            if r.random() < 0.2:
                ops.append((r.randint(51, 90), r.choice("DN")))
        exons, n = [0], 0
        for k, o in ops:
            if o == "N" or (o == "D" and k > 50):
                exons.append(0)
            elif o in "M=XD":
                exons[-1] += k
            n += k if o in "M=XSIH" else 0
        ref = ["".join(r.choice("ACGt") for _ in range(e)) for e in exons]
        if i % 17 == 0 and ref[-1]:
            ref[-1] = ref[-1][:-1]  # the chromosome ends
        seq = "".join(r.choice("acGT") for _ in range(n))
        if i % 13 == 0:
            seq = None if i % 2 else seq + "A"
        none = i % 29 == 0
        cigars.append("".join(f"{k}{o}" for k, o in ops))
        bases.append(seq)
        refs.append(None if none else ref)
        plain_ops = [(k, "S" if o == "H" else o) for k, o in ops]
        want.append(junction_errors(plain_ops, seq if seq and len(seq) == n else "", [] if none else ref, flank, 50))
    monkeypatch.setattr(errors, "BASES", 64)
    got = errors.errors(pa.array(cigars), pa.array(bases), pa.array(refs, pa.list_(pa.string())), flank, 50).to_pylist()
    assert [([tuple(x.values()) for x in g["sj_errors"]], tuple(g["background"].values())) for g in got] == want
    assert len(errors.errors(pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.list_(pa.string())), flank, 50)) == 0


def test_unsorted_is_an_error(spark, world):
    w, *_ , folder = world
    rows = [w.read("x", w.genes[1], [0, 1]), w.read("y", w.genes[0], [0, 1])]
    (folder / "u.sam").write_text("".join(f"{n}\t{f}\t{c}\t{p}\t{q}\t{cg}\t*\t0\t0\t{s}\t*\n" for n, f, c, p, q, cg, s in rows))
    bad = al.read_sam(spark, [(str(folder / "u.sam"), "u")])
    with pytest.raises(Exception, match="is not sorted"):
        scan.check_sorted(bad).collect()
    assert scan.check_sorted(world[3]).count() == 23


def test_unsorted_across_blocks_is_an_error(spark, world):
    w, genome, exons, _, folder = world

    def read(name, rows):
        (folder / name).write_text("".join(f"{n}{i}\t{f}\t{c}\t{p}\t{q}\t{cg}\t*\t0\t0\t{s}\t*\n" for i, (n, f, c, p, q, cg, s) in enumerate(rows)))
        return al.read_sam(spark, [(str(folder / name), "u")])

    g1, g2, g3 = w.genes
    one, two, three = ([w.read("r", g, list(range(k)))] * 40 for g, k in ((g1, 4), (g2, 3), (g3, 1)))
    blocks = lambda d: d.select("line.block").distinct().count()
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    size = sum(len(x[6]) + 40 for x in one)
    cut = {}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(500, size // 8)))
        for name, rows in (("sorted.sam", one + two + three), ("again.sam", one + three + two), ("down.sam", two + one + three), ("late.sam", one[:1] + three + one)):
            cut[name] = stored(read(name, rows))  # rows keep the block they were read in
    finally:
        for k, v in old.items():  # the step tables of a run aren't to be read in splits of a few hundred bytes
            spark.conf.set(k, v)
    good = cut.pop("sorted.sam")
    assert blocks(good) > 4 and scan.check_sorted(good).count() == 120
    assert scan.run(good, genome, exons).reads.count() > 0
    for bad in cut.values():
        assert blocks(bad) > 4
        with pytest.raises(Exception, match="is not sorted"):
            scan.check_sorted(bad).collect()
        with pytest.raises(Exception, match="is not sorted"):
            scan.run(bad, genome, exons)
    rows = spark.createDataFrame([(0, (b, r), c, s) for b, r, c, s in [(0, 1, "c", 5), (0, 2, "c", 9), (7, 3, "c", 8), (7, 4, "c", 10)]], "file_id int, line struct<block:long,row:long>, chr string, start int")
    assert [x.file_id for x in scan.unsorted_files(rows).collect()] == [0]  # each block is sorted, the file isn't
    rows = spark.createDataFrame([(3, (b, b), c, 5) for b, c in enumerate("cdc")] + [(4, (b, b), c, 5) for b, c in enumerate("ccd")], rows.schema)
    assert [x.file_id for x in scan.unsorted_files(rows).collect()] == [3]


def test_unknown_chromosome_is_an_error(spark, world):
    _, genome, _, _, folder = world
    (folder / "k.sam").write_text("r\t0\tchrZ\t5\t30\t10M\t*\t0\t0\tACGTACGTAC\t*\n")
    with pytest.raises(Exception, match="unknown chromosome"):
        scan.parse(al.read_sam(spark, [(str(folder / "k.sam"), "k")]), genome, ScanConfig()).collect()


def test_no_reads(spark, world):
    _, genome, exons, rows, _ = world
    s = scan.run(rows.where("false"), genome, exons)
    assert s.reads.count() == s.catalog.count() == s.groups.count() == 0
    q = quantify.run(quantify.from_scan(s.reads, s.junctions, s.catalog), exons)
    assert q.abundance.count() == q.compatible.count() == 0
