"""Expectation maximisation at half a cent, where a total rounded to cents gives another share than the sum itself."""

import duckdb

from tessera.operators import counts as ct
from tessera.queries import catalog

DIRECT, SHARED = (3, 20, 17, 29, 1), (24, 15, 37, 29, 2)


def test_two_values_are_summed_as_they_are(spark):
    """2.76 + 0.44 isn't 3.2: the rounded total gave 39.67 and 6.32. Whatever the order of rows, in tasks and as joins."""
    for order in ([("a", 2.76), ("b", 0.44)], [("b", 0.44), ("a", 2.76)]):
        direct = spark.createDataFrame([("g", *x) for x in order], "g string, t string, n double")
        evidence = spark.createDataFrame([("g", 0, t, 46.0) for t, _ in order], "g string, evidence long, t string, n double")
        for limit in (0, 100):
            got = ct.em_allocate(direct, evidence, "g", "t", max_iterate=1, rows_in_task=limit).collect()
            assert {x.t: x.em for x in got} == {"a": 42.44, "b": 6.77}


def test_rounds_are_those_of_the_sql(spark, tmp_path):
    """A user whose fifth round differed by a cent."""
    types = ("click", "signup", "purchase", "error", "view")
    rows = [(7, t, v) for v, counts in ((20.0, DIRECT), (1.0, SHARED)) for t, n in zip(types, counts, strict=True) for _ in range(n)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("em_rounds_trace", "em_allocation"):
        query, sql = catalog()[name]
        df = query(spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want)
