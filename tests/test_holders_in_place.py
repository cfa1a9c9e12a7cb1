"""Crowded bins: what reads met in several lists was shuffled by read, a pair for each read and isoform."""

import random
import re

from pyspark.sql import functions as F

from tessera.config import QuantConfig
from tessera.operators import intervals as iv
from tessera.plans import quantify


def made():
    rnd = random.Random(4)
    reads = [(i, rnd.choice("ab"), s := rnd.randrange(30) * 10, s + rnd.randrange(3), f"n{i}") for i in range(300)] + [(300, None, 5, 6, "x"), (301, "a", None, 6, "y"), (302, "c", 5, 6, None)]
    held = [(rnd.choice("ab"), x := rnd.randrange(300), x + rnd.randrange(60), f"t{rnd.randrange(150)}") for _ in range(400)]
    want = {i: sorted({t for k, x, y, t in held if k == c and s is not None and x <= s and e <= y}) for i, c, s, e, _ in reads}
    return reads, held + held[:50], want


def test_no_pair_is_shuffled(spark):
    """Whatever the lists and lots: rows move once, to their bin, and all of them come back with their own columns."""
    reads, held, want = made()
    a = spark.createDataFrame(reads, "rid long, chr string, start int, end int, name string")
    b = spark.createDataFrame(held, "chr string, x int, y int, t string")
    for slab, alike in ((2, 2), (7, 1), (1000, 3), (1000, 1000)):
        out = iv.holders(a, b, ["chr"], "rid", "start", "end", "x", "y", "t", "isoforms", slab=slab, alike=alike)
        assert out.columns == [*a.columns, "isoforms"] and out.schema["start"].dataType == a.schema["start"].dataType
        moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", out._jdf.queryExecution().executedPlan().toString())
        assert moved and all(re.fullmatch(r"chr#\d+, _bin#\d+L", x) for x in moved)
        got = out.collect()
        assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, reads))
        assert {r.rid: r.isoforms for r in got} == want


def test_equal_reads_meet_isoforms_once(spark):
    """Many reads of one place: their names are looked up and shown once for each lot of them."""
    seen = spark.sparkContext.accumulator(0)

    def looked(x):
        seen.add(1)
        return x

    a = spark.range(500).select(F.col("id").alias("rid"), F.lit("c").alias("chr"), F.lit(50).alias("start"), F.lit(60).alias("end"))
    b = spark.createDataFrame([("c", 40, 70, "t2"), ("c", 50, 60, "t1"), ("c", 51, 70, "t3")], "chr string, x int, y int, t string")
    shown = F.udf(lambda names: looked(",".join(names)))
    got = iv.holders(a, b, ["chr"], "rid", "start", "end", "x", "y", "t", "isoforms", alike=100, shown=shown).collect()
    assert sorted((r.rid, r.isoforms) for r in got) == [(i, "t1,t2") for i in range(500)]
    assert seen.value == 5


def test_lone_sets_show_names_either_way(spark):
    reads = spark.createDataFrame([(1, "c", 100, 120, []), (2, "c", 900, 950, []), (3, "c", 100, 120, [(1, 2, "0")])], "rid long, chr string, start int, end int, sjs array<struct<start:int,end:int,strand:string>>")
    txs = spark.createDataFrame([("c", t, s, e, []) for t, s, e in (("b", 80, 130), ("a", 90, 140))], "chr string, transcript_id string, start0 int, end int, chain array<struct<start:int,end:int>>")
    for longer in (False, True):
        out = quantify.lone_sets(reads, txs, QuantConfig(allow_longer_terminal_exons=longer), lambda names: F.array_join(names, ","))
        assert {r.rid: r.isoforms for r in out.collect()} == {1: "a,b", 2: ""}
