import random

from tessera.operators import intervals as iv


def test_holders_by_hand(spark):
    """Many short intervals in one wide bin: every read met every isoform of its 65,536 bases. Lists of any number give the same."""
    rnd = random.Random(1)
    reads = [(i, rnd.choice("ab"), s := rnd.randrange(2000), s + rnd.randrange(40)) for i in range(200)] + [(200, None, 5, 6), (201, "a", None, 6), (202, "c", 5, 6)]
    held = [(rnd.choice("ab"), x := rnd.randrange(2000), x + rnd.randrange(120), f"t{rnd.randrange(90)}") for _ in range(400)] + [("a", 0, 2100, "long")]
    a = spark.createDataFrame(reads, "rid long, chr string, start int, end int")
    b = spark.createDataFrame(held, "chr string, x int, y int, t string")
    want = {i: sorted({t for k, x, y, t in held if k == c and s is not None and x <= s and e <= y}) for i, c, s, e in reads}
    for slab in (2000, 3):
        got = iv.holders(a, b, ["chr"], "rid", "start", "end", "x", "y", "t", "isoforms", slab).collect()
        assert len(got) == len(reads)
        assert {r.rid: r.isoforms for r in got} == want
    assert iv.span_width(b, "x", "y") < 40
