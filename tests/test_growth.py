"""Steps that grew too fast: how often rows are moved, and that the results stay whole."""

from pyspark.sql import functions as F

import random
import re
from collections import Counter

import numpy as np
from test_isoforms import by_hand, made_reads

from tessera.config import QuantConfig
from tessera.operators import counts as ct
from tessera.operators import isoforms as iso
from tessera.plans import quantify, scan
from tessera.queries import catalog, derived
from tessera.sources import results as rs


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_corrected_reads_are_gathered_once(spark, tmp_path):
    """Lines moved twice, as 13 texts each, to drop repeated ones; a name with a quote swallowed what followed."""
    sj = 'q"\tSJ\t{}\tc:{}:9\tNA\tNA\t{}\t{}\t1\tNA\t0.5\tNA\tNA'
    rows = ['q"\tgroup_ID\t4\t4\t"x', 'q"\tchr\tc', sj.format(2, 5, "pass", "c:5:9:0"), sj.format(1, 3, "fail", "NA"), sj.format(2, 5, "pass", "c:5:9:0"), sj.format(-1, 7, "added", "c:7:9:1"), "", 'q"\tend\tNA\t8\tNA\tNA\tpass\t9\tNA\tNA\tNA\tNA\tNA']
    (tmp_path / "f.txt").write_text("\n".join([*rows, sj.format(2, 5, "pass", "c:5:9:0") + "\t", sj.format(2, 5, "pass", "c:5:9:0")[:-2] + "XX"]) + "\n")
    out = rs.read_corrected(spark, str(tmp_path / "f.txt"))
    assert plan(out)[1].count("Exchange hashpartitioning") == 1
    r = out.collect()
    assert len(r) == 1 and (r[0].read_id, r[0].group_id, r[0].sample, r[0].chr, r[0].start, r[0].end.orig, r[0].end.corr) == ('q"', 4, '"x', "c", None, 8, 9)
    assert [(j.ord, j.orig.start, j.status, j.corr and j.corr.strand) for j in r[0].sjs] == [(1, 3, "fail", None), (2, 5, "pass", "0"), (2, 5, "pass", "0"), (2**30, 7, "added", "1")]  # rows that differ anywhere stay


def test_orders_keep_no_lists_by_key(spark, tmp_path):
    """Lists of an order's lines were made before the shuffle and again after it, by an aggregate that sorts objects."""
    rows = [(k, p, s, n) for k, p, s, n in [(7, 3, 1, 2), (7, 2, 2, 1), (7, 2, 2, 1), (8, 1, 1, 1)]]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    o = derived.orders(spark, str(tmp_path))
    assert "ObjectHashAggregate" not in plan(o)[0] and plan(o)[1].count("Exchange hashpartitioning") == 1
    got = {r.k: [(j.start, j.end, j.strand) for j in r.sjs] for r in o.collect()}
    assert got == {7: [(2000, 2500, "0"), (3000, 3500, "0"), (4010, 4510, "0")], 8: [(3010, 3510, "1")]}


def _unsorted(rows):
    """Files, row by row."""
    bad, last = set(), {}
    for f, _, c, s in sorted(rows):
        seen = last.setdefault(f, [set(), None, None])
        if c == seen[1]:
            if s < seen[2]:
                bad.add(f)
        elif c in seen[0]:
            bad.add(f)
        seen[0].add(c)
        seen[1:] = [c, s]
    return bad


def test_sort_check_keeps_no_table_of_rows(spark):
    """Hash tables of all rows of a task grew with the input; the check sorts tasks of a bounded size, and keeps ends of runs."""
    rnd = random.Random(12)
    rows = []
    for f in range(400):
        n, at = rnd.randrange(1, 30), 0
        chroms = sorted(rnd.randrange(4) for _ in range(n))
        if rnd.random() < 0.3:
            rnd.shuffle(chroms)
        for r in range(n):
            at = 0 if r and chroms[r] != chroms[r - 1] else at
            at += rnd.randrange(3) - (rnd.random() < 0.02) * 3
            rows.append((f, (r // rnd.choice((3, 7)) if f % 2 else r // 5, r), f"c{chroms[r]}", at))
    rows = [x for f in range(400) for x in _blocks_in_order([x for x in rows if x[0] == f])]
    df = spark.createDataFrame(rows + rows[::7], "file_id int, line struct<block:long,row:long>, chr string, start int")  # some rows twice
    want = _unsorted([(f, row, c, s) for f, (_, row), c, s in rows])
    assert 40 < len(want) < 360
    out = scan.unsorted_files(scan.dealt(df, len(rows)))
    assert {r.file_id for r in out.collect()} == want
    assert all(len(x) < 60 for x in re.findall(r"HashAggregate\(keys=\[(.*?)\]", plan(out)[0])) and "min_by" not in plan(out)[0]
    assert scan.dealt(df, 20 * scan.ROWS_OF_A_TASK).rdd.getNumPartitions() == 20


def _blocks_in_order(rows):
    block, out = 0, []
    for f, (b, r), c, s in rows:
        block = max(block, b)
        out.append((f, (block, r), c, s))
    return out


def test_sortedness_query_moves_lines_once(spark):
    out = catalog()["sortedness_check"][0](spark, "/root/testdata/sf0.001")
    text = plan(out)[0]
    assert "max(l_quantity" in text and not any("l_quantity" in x for x in text.splitlines() if "HashAggregate" in x)


def test_perfect_reads_are_counted_by_chain(spark):
    """Every junction of every read was moved with its read's whole chain, to be counted."""
    rnd = random.Random(14)
    shapes = [[(rnd.randrange(5) * 10 + 100 * i, rnd.randrange(5) * 10 + 100 * i + 50) for i in range(rnd.randrange(1, 5))] for _ in range(6)]
    reads = [(i, f"r{i % 55}", f"c{i % 2}", 0, "s", i % 3, 9, rnd.choice(shapes) + [(None, None)] * (i % 11 == 0)) for i in range(60)]  # some names stand twice
    df = spark.createDataFrame([(*r[:-1], [(*j, "0") for j in r[-1]], True, True, "0") for r in reads], "rid long, read_id string, chr string, group_id long, sample string, start int, end int, sjs array<struct<start:int,end:int,strand:string>>, all_annotated boolean, all_sites boolean, strand string")
    shown = {(r[2], r[1], *j) for r in reads for j in r[-1] if j[0] is not None and rnd.random() < 0.7} | {("c0", "nobody", 1, 2)}
    perfect = spark.createDataFrame(sorted((c, s, e, n) for c, n, s, e in shown) * 2, "chr string, start long, end long, read_id string")
    out = quantify.chains_of(df, quantify.classes_of(df), perfect)
    want = {}
    for _, n, c, g, *_, chain in reads:
        got = want.setdefault((c, g, tuple(chain)), [0] * len(chain))
        for k, j in enumerate(chain):
            got[k] += (c, n, *j) in shown
    have = {(r.chr, r.group_id, tuple((j.start, j.end) if j else (None, None) for j in r.chain)): r.perfect for r in out.collect()}
    assert have == {k: [] if (None, None) in k[2] else v for k, v in want.items()}
    moved = [x for x in plan(out)[1].splitlines() if "Exchange hashpartitioning" in x]
    assert moved and not any(re.search(r"hashpartitioning\([^)]*\bj#", x) for x in moved)


def test_chains_alone_need_no_numbers(spark, monkeypatch):
    """Chains were numbered, with medians of their ends, for a query that shows neither; junctions were stored with all their isoforms' names."""
    monkeypatch.setattr(quantify, "with_ids", None)
    kept = []
    annotate = quantify.annotate
    monkeypatch.setattr(quantify, "annotate", lambda reads, junction: kept.append(junction.columns) or annotate(reads, junction))
    assert catalog()["ordered_chains"][0](spark, "/root/testdata/sf0.001").count() > 100
    assert kept == [["chr", "start", "end", "strand"]]


def test_counts_meet_alike_reads_and_isoforms_once(spark, monkeypatch):
    """Reads met the annotation one by one, isoforms of equal chains and ends met every read class, and the names that each class is compatible with were written out, for counts that need none of it."""
    isoforms, reads = made_reads(2)
    isoforms = [(c, f"{t}{x}", g if x else g + "z", p) for c, t, g, p in isoforms for x in ("", *"abcdefgh")]
    reads = [(f"{x[0]}{i}", *x[1:]) for i in range(3) for x in reads]
    exons = spark.createDataFrame([(c, "x", s, e, "+", g, t, "G", "N" + t) for c, t, g, p in isoforms for s, e in p], "chr string, source string, start0 int, end int, strand string, gene_id string, transcript_id string, gene_name string, transcript_name string")
    rows = spark.createDataFrame([(*x[:7], [j or (None, None, None) for j in x[7]]) for x in reads], "read_id string, sample string, chr string, group_id long, strand string, start int, end int, sjs array<struct<start:int,end:int,strand:string>>")
    annotate, join = quantify.annotate, iso.salted_join
    met, held = [], []
    monkeypatch.setattr(quantify, "annotate", lambda r, junction: met.append(r.count()) or annotate(r, junction))
    monkeypatch.setattr(iso, "salted_join", lambda a, table, *more: held.append((table.count(), table.distinct().count())) or join(a, table, *more))
    with monkeypatch.context() as m:
        m.setattr(iso, "named", None)
        counts = quantify.counts(rows, exons).collect()
    assert met == [len({(x[2], x[3], tuple(x[7])) for x in reads if x[7]})]
    assert len(held) == 2 and all(n == kinds for n, kinds in held) and held[1][0] * 9 <= len(isoforms) * 2
    want, compatible, _ = by_hand(isoforms, reads, None, QuantConfig())
    assert Counter((x.transcript_id, x.transcript_name, x.gene_id, x.sample, x["count"]) for x in counts) == want
    q = quantify.run(rows, exons)
    assert Counter((x.read_id, x["class"], tuple(sorted(x.isoforms))) for x in q.compatible.collect()) == Counter((i, k, n) for (i, _), (k, n) in compatible.items())
    assert Counter(tuple(x) for x in q.abundance.collect()) == Counter(tuple(x) for x in counts)


def test_em_does_not_depend_on_the_order_of_rows(spark):
    """The sum of these values in another order isn't 6.4, and a share just at half a cent was rounded by the order in which a task got its rows."""
    values = [2.74, 0.77, 0.3, 2.59]
    for order in ([0, 1, 2, 3], [0, 1, 3, 2]):
        v = np.array([values[i] for i in order])
        got = ct.em_rounds(v, np.zeros(4, int), np.arange(4), np.full(4, 8.0), np.zeros(4, int), max_iterate=1)[0][-1]
        assert dict(zip(order, got.tolist(), strict=True))[2] == 0.67
    for order in ([0, 1, 2, 3], [0, 1, 3, 2]):
        direct = spark.createDataFrame([("g", i, values[i]) for i in order], "g string, t long, n double")
        evidence = spark.createDataFrame([("g", 0, i, 8.0) for i in order], "g string, evidence long, t long, n double")
        for limit in (0, 100):
            got = ct.em_allocate(direct, evidence, "g", "t", max_iterate=1, rows_in_task=limit).collect()
            assert {x.t: x.em for x in got}[2] == 0.67
