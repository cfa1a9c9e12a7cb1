import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from group_by_hand import Group, Isoform, ReadChain, Structure, ends_ok, lower_median, offset_of, single_exon
from pyspark.sql import functions as F

from tessera import ordering
from tessera.config import QuantConfig
from tessera.operators import counts as ct
from tessera.operators.counts import binomial_sf, chi2_ppf, chi2_sf
from tessera.plans import quantify

A, B, C, D = (10, 20), (30, 40), (50, 60), (70, 80)


def em_rounds(direct, evidence, **more):
    names = list(direct)
    rows = [(i, names.index(t), n) for i, (targets, n) in enumerate(evidence) for t in targets]
    of, at, n = (np.array(x, dtype=d) for x, d in zip(zip(*rows, strict=True) if rows else ((), (), ()), (int, int, float), strict=True))
    return dict(zip(names, ct.em_rounds(np.array(list(direct.values())), of, at, n, np.zeros(len(names), int), **more)[0][-1].tolist(), strict=True))


def test_em_matches_hand_computed_rounds():
    direct = {"a": 4.0, "b": 2.0, "c": 4.0, "d": 4.0}
    evidence = [(("a", "c"), 2.0), (("a", "d"), 2.0)]
    assert em_rounds(direct, evidence, max_iterate=1) == {"a": 6, "b": 2, "c": 5, "d": 5}
    assert em_rounds(direct, evidence, max_iterate=2) == {"a": 6.18, "b": 2, "c": 4.91, "d": 4.91}
    assert em_rounds(direct, evidence) == {"a": 6.22, "b": 2, "c": 4.89, "d": 4.89}


def test_em_splits_equally_without_counts():
    assert em_rounds({"a": 0.0, "b": 0.0}, [(("a", "b"), 3.0)]) == {"a": 1.5, "b": 1.5}
    assert em_rounds({}, []) == {}


def test_two_places_as_c_prints_them():
    x = np.array([0.125, 0.375, 2.675, 1.005, 0.005, -0.125, 1e9 + 0.125, 0.045, 3.0, 1 / 3])
    assert ct._c2(x).tolist() == [float(f"{v:.2f}") for v in x.tolist()]


@pytest.mark.parametrize("per_read", [False, True])
def test_large_groups_are_joins_with_the_same_rounds(spark, per_read, monkeypatch):
    """Groups in a task and groups iterated as joins: every round alike, hot targets too."""
    monkeypatch.setattr(ordering, "KEYS_TO_BROADCAST", 0)
    monkeypatch.setattr(ordering, "HOT_SHARE", 10)
    r = random.Random(5)
    direct = [(g, t, r.choice([0, 0, 3, 10])) for g in range(3) for t in range(12)] + [(9, 1, 4)]
    evidence = [(g, e, t, n) for g in range(3) for e in range(20) for n in [r.randrange(1, 30)] for t in {0, *r.sample(range(15), r.choice([1, 2, 3]))}]
    d, e = spark.createDataFrame(direct, "g long, t long, n long"), spark.createDataFrame(evidence, "g long, evidence long, t long, n long")
    rows = lambda limit: sorted((x.g, x.round, x.t, round(x.em, 9)) for x in ct.em_allocate(d, e, "g", "t", trace=True, per_read=per_read, rows_in_task=limit).collect())
    small = rows(10_000)
    assert small == rows(0) and max(x[1] for x in small) > 3
    last = {}
    for g, n, t, v in small:
        last[g, t] = max(last.get((g, t), (-1, 0)), (n, v))
    ends = ct.em_allocate(d, e, "g", "t", per_read=per_read, rows_in_task=0).collect()
    assert {(x.g, x.t): round(x.em, 9) for x in ends} == {k: v for k, (_, v) in last.items()}


def test_single_exon_counts():
    got = single_exon(["s"], {("s", ("x",)): 3, ("s", ("x", "y")): 2}, QuantConfig())
    assert got["x"]["s"] > got["y"]["s"] and got["x"]["s"] + got["y"]["s"] == pytest.approx(5, abs=0.1)


@pytest.mark.parametrize(("short", "long", "want"), [((A,), (A, B), 0), ((B,), (A, B), 1), ((A, C), (A, B, C), None), ((None, C), (A, B, C), 1), ((A, None), (A, B), 0), ((A, None), (B, A), None), ((None,), (A,), None), ((A, B), (A,), None)])
def test_offsets(short, long, want):
    assert offset_of(short, long) == want


def test_ends():
    s = Structure((A, B), 5, 50)
    assert s.fit(0, 1) == (5, True, 30, False)
    assert s.fit(1, 1) == (20, False, 50, True)
    cfg = QuantConfig()
    assert ends_ok(s.fit(0, 1), -30, 36, cfg) and not ends_ok(s.fit(0, 1), -31, 36, cfg) and not ends_ok(s.fit(0, 1), -30, 37, cfg)
    assert ends_ok(s.fit(0, 2), -999, 999, QuantConfig(allow_longer_terminal_exons=True))


def test_medians():
    assert lower_median([(1, 1), (5, 1)], False) == 1 and lower_median([(1, 1), (5, 1)], True) == 5
    assert lower_median([(1, 1), (3, 1), (9, 1)], False) == lower_median([(1, 1), (3, 1), (9, 1)], True) == 3


def chain(junctions, n, start=5, end=95, annotated=False, sites=False, sample="s"):
    return ReadChain(tuple(junctions), start, end, annotated, sites, "0", (n,) * len(junctions), [(sample, start, end, n)])


def run(chains, isoforms, cfg=None, samples=("s",)):
    g = Group("c", 0, list(samples), chains, isoforms, cfg or QuantConfig())
    return g, g.run()


def test_classes_and_counts():
    iso = [Isoform((A, B, C), 4, 95, "t1", "T1", "g"), Isoform((A, C), 4, 95, "t2", "T2", "g")]
    g, out = run([chain((A, B, C), 5, annotated=True), chain((B, C), 2, start=35, annotated=True), chain((A, D), 3, sites=True), chain((A, (51, 61)), 1)], iso)
    assert {c.chain: c.category for c in g.chains.values()} == {(A, B, C): "FSM", (B, C): "ISM", (A, D): "NIC", (A, (51, 61)): "NNC"}
    counts = {i: n for i, _, _, _, n in out.abundance}
    assert counts == {"t1": 7.0, "TSR:c:0:0": 3.0}  # the short part joins its only isoform; one NNC read is too few
    labels = {(c, label): names for c, _, _, label, names in out.compatible}
    assert labels[(B, C), "ISM"] == ["t1"] and labels[(A, (51, 61)), "NNC"] == []


def test_failed_junction_goes_to_what_it_fits():
    iso = [Isoform((A, B, C), 4, 95, "t1", "T1", "g")]
    _, out = run([chain((A, B, C), 5, annotated=True), chain((A, None, C), 2)], iso)
    assert {i: n for i, _, _, _, n in out.abundance} == {"t1": 7.0}


def test_longer_novel_chain_takes_its_parts():
    g, out = run([chain(((1, 2), B, C, D), 3), chain((B, C), 4, start=35, end=65)], [])
    assert {i: n for i, _, _, _, n in out.abundance} == {"TSR:c:0:0": 7.0}
    assert len(g.longest) == 1


def test_perfect_ends_split_equal_chains():
    iso = [Isoform((A,), 4, 95, "t1", "T1", "g"), Isoform((A,), 4, 400, "t2", "T2", "g")]
    both = ReadChain((A,), 5, 95, True, True, "0", (4,), [("s", 5, 95, 3), ("s", 5, 399, 1)])
    _, out = run([both], iso)
    assert {i: n for i, _, _, _, n in out.abundance} == {"t1": 3.0, "t2": 1.0}


def test_tails():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert chi2_ppf(0.95, 10) == pytest.approx(18.307038053275146, rel=1e-9)
    assert binomial_sf(5, 10, 0.5) == pytest.approx(0.623046875, rel=1e-12)
    assert binomial_sf(9, 10, 0.5) == pytest.approx(0.0107421875, rel=1e-12)
    assert binomial_sf(0, 10, 0.5) == 1 and binomial_sf(11, 10, 0.5) == 0


def made_reads(seed):
    """Reads and isoforms of three groups on two chromosomes: parts, skips, new junctions, failed ones, moved ends."""
    r = random.Random(seed)
    isoforms, reads = [], []
    for c in ("c1", "c2"):
        for gene in range(3):
            exons = [(1000 * gene * 10 + 1000 * k + 100, 1000 * gene * 10 + 1000 * k + 300) for k in range(7)]
            for t in range(r.choice([1, 2, 3])):
                picked = sorted(r.sample(exons, r.randrange(1, 7)))
                isoforms.append((c, f"{c}t{gene}{t}", f"{c}g{gene % 2}", picked))
                if r.random() < 0.3:  # the same chain with another end
                    isoforms.append((c, f"{c}u{gene}{t}", f"{c}g{gene}", picked[:-1] + [(picked[-1][0], picked[-1][1] + 60)]))
            for _ in range(60):
                i = r.choice([x for x in isoforms if x[0] == c and x[3][0][0] // 10000 == gene])[3]
                at = r.randrange(len(i))
                blocks = [list(b) for b in (i[at : at + r.randrange(1, 8)] if r.random() < 0.6 else sorted(r.sample(exons, r.randrange(1, 7))))]
                if len(blocks) > 1 and r.random() < 0.3:
                    blocks[r.randrange(len(blocks) - 1)][1] += r.choice([7, 11])
                start, end = blocks[0][0] + 1 + r.choice([0, 0, 20, -20, -50]), blocks[-1][1] + r.choice([0, 0, 30, 60])
                sjs = [None if r.random() < 0.05 else (a[1], b[0], "0") for a, b in zip(blocks, blocks[1:], strict=False)]
                for group in {gene // 2, *([5] if r.random() < 0.1 else [])}:
                    reads.append((f"r{len(reads)}", r.choice(["s1", "s2"]), c, group, "0", start, end, sjs))
    return isoforms, reads


def by_hand(isoforms, reads, perfect, cfg):
    samples, abundance, compatible, structures = sorted({x[1] for x in reads}), Counter(), {}, Counter()
    ones = defaultdict(lambda: dict.fromkeys(samples, 0.0))
    chains = {t: tuple((a[1], b[0]) for a, b in zip(p, p[1:], strict=False)) for _, t, _, p in isoforms}
    for c, g in sorted({(x[2], x[3]) for x in reads}):
        mine = [x for x in reads if (x[2], x[3]) == (c, g)]
        known = {j for cc, t, _, _ in isoforms if cc == c for j in chains[t]}
        found = defaultdict(list)
        for x in mine:
            if x[7]:
                found[tuple(None if j is None else j[:2] for j in x[7])].append(x)
        rows = []
        for chain, xs in found.items():
            js = [j for j in chain if j]
            classes = Counter((x[1], x[5], x[6]) for x in xs)
            good = () if None in chain else tuple(sum((x[0], *j) in perfect for x in xs) for j in chain) if perfect is not None else (len(xs),) * len(chain)
            start = lower_median([(s, n) for (_, s, _), n in classes.items()], False)
            end = lower_median([(e, n) for (_, _, e), n in classes.items()], True)
            rows.append(ReadChain(chain, start, end, bool(js) and all(j in known for j in js), bool(js) and all(j[0] in {k[0] for k in known} and j[1] in {k[1] for k in known} for j in js), "0", good, [(*k, n) for k, n in classes.items()]))
        used = {j for ch in found for j in ch if j}
        group = [Isoform(chains[t], p[0][0], p[-1][1], t, "N" + t, ge) for cc, t, ge, p in isoforms if cc == c and used & set(chains[t])]
        if rows:
            out = Group(c, g, samples, rows, group, cfg).run()
            for i, title, gene, s, n in out.abundance:
                abundance[i, title, gene, s, n] += 1
            for i, gene, source, s, e, chain, _ in out.structures:
                structures[i, gene, source, s, e, chain] += 1
            classes = {(chain, s, e): (label, tuple(sorted(names))) for chain, s, e, label, names in out.compatible}
            for chain, xs in found.items():
                for x in xs:
                    compatible[x[0], g] = classes[chain, x[5], x[6]]
        lone = defaultdict(int)
        for x in mine:
            if not x[7]:
                names = tuple(sorted(t for cc, t, _, p in isoforms if cc == c and not chains[t] and p[0][0] - cfg.sj_dist <= x[5] and x[6] <= p[-1][1] + cfg.sj_dist))
                compatible[x[0], g] = ("single-exon", names)
                if names:
                    lone[x[1], names] += 1
        for t, per in single_exon(samples, lone, cfg).items():
            for s, n in per.items():
                ones[t][s] += n
    for t, per in ones.items():  # read groups of one isoform are summed
        if sum(per.values()):
            gene, p = next((ge, p) for _, tt, ge, p in isoforms if tt == t)
            for s, n in per.items():
                abundance[t, "N" + t, gene, s, round(n, 2)] += 1
            structures[t, gene, "annotated_isoform", p[0][0], p[-1][1], ()] += 1
    return abundance, compatible, structures


@pytest.mark.parametrize(("seed", "cfg", "use_perfect"), [(2, QuantConfig(), True), (3, QuantConfig(read_num_cutoff=1, allow_longer_terminal_exons=False, internal_boundary_limit=60), False), (4, QuantConfig(read_num_cutoff=1, raw=True), False)])
def test_plan_matches_rules_by_hand(spark, seed, cfg, use_perfect):
    isoforms, reads = made_reads(seed)
    if cfg.raw:  # there every chain has reads
        isoforms = isoforms[:4]
    r = random.Random(seed)
    perfect = {(x[0], *j[:2]) for x in reads for j in x[7] if j and r.random() < 0.7} if use_perfect else None
    exons = spark.createDataFrame([(c, "x", s, e, "+", g, t, "G", "N" + t) for c, t, g, p in isoforms for s, e in p], "chr string, source string, start0 int, end int, strand string, gene_id string, transcript_id string, gene_name string, transcript_name string")
    shape = "array<struct<start:int,end:int,strand:string>>"
    rows = spark.createDataFrame([(*x[:7], [j or (None, None, None) for j in x[7]]) for x in reads], f"read_id string, sample string, chr string, group_id long, strand string, start int, end int, sjs {shape}")
    good = None if perfect is None else spark.createDataFrame([(next(x[2] for x in reads if x[0] == i), s, e, i) for i, s, e in perfect], "chr string, start int, end int, read_id string")
    q = quantify.run(rows, exons, good, cfg)
    want_a, want_c, want_s = by_hand(isoforms, reads, perfect, cfg)
    got_a = Counter((x.transcript_id, x.transcript_name, x.gene_id, x.sample, x["count"]) for x in q.abundance.collect())
    assert got_a == want_a
    got_c = Counter((x.read_id, x["class"], tuple(sorted(x.isoforms))) for x in q.compatible.collect())
    assert got_c == Counter((i, k, n) for (i, _), (k, n) in want_c.items())
    got_s = Counter((x.transcript_id, x.gene_id, x.source, x.start0, x.end, tuple((j.start, j.end) for j in x.chain)) for x in q.structures.collect())
    assert got_s == want_s
    assert q.abundance.where(F.col("transcript_id").startswith("TSR:")).count() > 0
