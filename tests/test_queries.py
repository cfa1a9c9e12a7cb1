"""Every query against its SQL on the smallest tables; needs the driver's data."""

import math
import os

import duckdb
import pytest

from tessera.queries import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query(spark, con, name):
    query, sql = catalog()[name]
    df = query(spark, DATA)
    names = sorted(df.columns)
    got = sorted("|".join(plain(r[n]) for n in names) for r in df.collect())
    if sql is None:
        assert got
        return
    want = con.sql(sql)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall())


def test_balanced_bins_are_even(spark):
    rows = catalog()["bin_pack_balance"][0](spark, DATA).collect()
    sums = {}
    for r in rows:
        sums[r.bin] = sums.get(r.bin, 0) + r.n
    assert all(v <= 5000 + max(r.n for r in rows) for v in sums.values())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_em_runs_to_its_end(spark, tmp_path):
    """A user whose values still move after many rounds: the query goes on until they don't."""
    rows = [(1, t, 20.0) for t in ("a", "b", "view")] + [(1, "a", 1.0)] * 5 + [(1, "b", 1.0)] * 40
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_type: r.em for r in catalog()["em_allocation"][0](spark, str(tmp_path)).collect()}

    def after(rounds):
        now = direct = {"a": 1.0, "b": 1.0, "view": 1.0}
        for i in range(rounds):
            new = dict(direct)
            for t, n in (("a", 5), ("b", 40)):
                for x in (t, "view"):
                    new[x] += float("%.2f" % (n * now[x] / (now[t] + now["view"])))
            new = {t: float("%.2f" % v) for t, v in new.items()}
            moved = max(abs(new[t] - now[t]) for t in new)
            now = new
            if moved < 0.1:
                return now, i + 1
        return now, rounds

    want, rounds = after(100)
    assert 6 < rounds < 100 and after(6)[0] != want
    assert got == want
