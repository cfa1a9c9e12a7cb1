"""Correction of shifted, and recovery of missed, junctions."""

import pytest
from synthetic import World

from tessera.config import CorrectConfig
from tessera.operators import junctions as jn
from tessera.plans import correct, quantify, scan
from tessera.sources import alignments as al
from tessera.sources import annotation as an
from tessera.sources import genome as gn

CFG = CorrectConfig()


def test_probability():
    assert jn.error_probability((0, 0, 0), (0, 0, 0, 200), 20) == pytest.approx(1.0)
    clean, bad = jn.error_probability((0, 0, 0), (1, 1, 1, 200), 20), jn.error_probability((0, 3, 2), (1, 1, 1, 200), 20)
    assert clean > 10 * bad > 0
    assert jn.combination(10, 3) == 120 and jn.combination(10, 8) == 45 and jn.combination(5, 0) == 1


def test_window_errors():
    assert jn.window_errors("50=", 7, 0, CFG) == ((0, 0, 0), 22, 41, 31)
    assert jn.window_errors("20=1X29=", 0, 0, CFG)[0] == (0, 0, 1)
    assert jn.window_errors("20=2D28=", 0, 0, CFG)[0] == (0, 2, 0)
    assert jn.window_errors("20=1I30=", 0, 0, CFG)[0] == (1, 0, 0)
    assert jn.window_errors("5=1X44=", 0, 0, CFG)[0] == (0, 0, 0)


def seen(at, pos=100, hc=True, errors=(0, 0, 0)):
    return jn.Seen(at, "0", pos, hc, errors)


def cand(at, pos=100, prob=0.9, strand="0"):
    return jn.Candidate(at, strand, pos - 10, pos + 10, pos, prob)


BG = (1, 1, 1, 400)


def test_decisions():
    d = jn.decide([seen((500, 900))], [], BG, (0, 0), 300, CFG)
    assert d.strand == "0" and d.fixed[0][:2] == ((500, 900), "pass")
    d = jn.decide([seen((503, 903), hc=False)], [cand((500, 900))], BG, (0, 0), 300, CFG)
    assert d.fixed[0][:2] == ((500, 900), "corrected")
    d = jn.decide([seen((503, 903), hc=False)], [cand((500, 900), prob=0.5), cand((510, 900), prob=0.4)], BG, (0, 0), 300, CFG)
    assert d.fixed == {}  # two of about one chance
    assert jn.decide([seen((503, 903), hc=False)], [], BG, (0, 0), 300, CFG).strand == "unknown"
    assert jn.decide([seen((503, 903), hc=False)], [cand((500, 900), strand="x")], BG, (0, 0), 300, CFG).strand == "unknown"


@pytest.fixture(scope="module")
def corrected(spark, tmp_path_factory):
    w = World(seed=3)
    w.add_chromosome("chr1", [4])
    g = w.genes[0]
    folder = tmp_path_factory.mktemp("c")
    (folder / "g.fa").write_text(w.fasta())
    (folder / "a.gtf").write_text(w.gtf({"T1": (g, [0, 1, 2, 3])}))

    def shift(ops, seq):  # the first junction 3 bases further right on both sides
        (a, _), (b, _) = ops[0], ops[2]
        return [(a + 3, "M"), ops[1], (b - 3, "M"), *ops[3:]], seq

    def clip(ops, seq):  # the first exon's last 40 bases as a soft clip on the second
        a = ops[0][0]
        return [(40, "S"), *ops[2:]], seq[a - 40 :]

    reads = [w.read(f"a{i}", g, [0, 1, 2, 3]) for i in range(4)] + [w.read("s", g, [0, 1, 2, 3], tweak=shift)]
    name, flag, c, _, q, cg, seq = w.read("k", g, [0, 1, 2, 3], tweak=clip)
    reads.append((name, flag, c, g.exons[1][0] + 1, q, cg, seq))
    outer = {"junk": "".join("GATC"[(k * k + k // 3) % 4] for k in range(40)), "edge": w.chromosomes["chr1"][g.exons[1][0] - 40 : g.exons[1][0]]}
    for other, outside in outer.items():  # soft clips that are no exon: other bases, and the intron's own
        reads.append((other, flag, c, g.exons[1][0] + 1, q, cg, outside + seq[40:]))
    (folder / "r.sam").write_text(w.sam(reads))
    genome, exons = gn.read_fasta(spark, str(folder / "g.fa")), an.read_exons(spark, str(folder / "a.gtf"))
    s = scan.run(al.read_sam(spark, [(str(folder / "r.sam"), "one")]), genome, exons)
    return w, exons, {r.read_id: r for r in correct.run(s, genome).collect()}, correct.run(s, genome)


def test_perfect_reads_pass(corrected):
    w, _, rows, _ = corrected
    g = w.genes[0]
    want = [(g.exons[k][1], g.exons[k + 1][0]) for k in range(3)]
    assert [(j.start, j.end) for j in rows["a0"].sjs] == want and {j.status for j in rows["a0"].sjs} == {"pass"} and rows["a0"].strand == "0"


def test_shifted_junction_is_corrected(corrected):
    w, _, rows, _ = corrected
    g = w.genes[0]
    first = rows["s"].sjs[0]
    assert (first.orig_start, first.start, first.end, first.status) == (g.exons[0][1] + 3, g.exons[0][1], g.exons[1][0], "corrected")


def test_clipped_junction_is_added(corrected):
    w, _, rows, _ = corrected
    g = w.genes[0]
    first = rows["k"].sjs[0]
    assert (first.start, first.end, first.status) == (g.exons[0][1], g.exons[1][0], "added")
    assert rows["k"].start == pytest.approx(g.exons[0][1] - 40 + 1, abs=3)


def test_other_ends_add_no_junction(corrected):
    w, _, rows, _ = corrected
    for other in ("junk", "edge"):
        assert {j.status for j in rows[other].sjs} == {"pass"} and len(rows[other].sjs) == 2 and rows[other].start == w.genes[0].exons[1][0] + 1


def test_counts_after_correction(corrected):
    _, exons, _, reads = corrected
    q = quantify.run(reads.select("read_id", "sample", "chr", "group_id", "strand", "start", "end", "sjs"), exons)
    assert {(r.transcript_id, r.sample): r["count"] for r in q.abundance.collect()} == {("T1", "one"): 8.0}
