from pyspark.sql import functions as F

from tessera import ordering
from tessera.storage import stored


def test_compressed_tables_are_not_broadcast_by_file_size(spark):
    """Repeated chains take little room on disk and 30 MB as rows: such a table must not be gathered on the driver."""
    chain = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))
    big = stored(spark.range(60_000).select(F.col("id").alias("k"), chain.alias("chain")))
    few = stored(spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("n")))
    plan = lambda d: d._jdf.queryExecution().sparkPlan().toString()
    other = stored(spark.range(60_000).select(F.col("id").alias("k"), chain.alias("other")))
    assert "BroadcastHashJoin" not in plan(big.join(other, "k"))
    joined = big.join(few, "k")
    assert joined.count() == 100
    joined.collect()
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()  # measured: small


def test_few_keys_with_long_lists_are_not_broadcast(spark, monkeypatch):
    """Isoform lists of a chain grow with the annotation: a table of few keys may be too much for the driver."""
    monkeypatch.setattr(ordering, "BYTES_TO_BROADCAST", 10_000)
    monkeypatch.setattr(ordering, "HOT_SHARE", 10)
    rows = stored(spark.range(1000).select((F.col("id") % 50).alias("k"), "id"))
    lists = stored(rows.groupBy("k").agg(F.count("*").alias("_n")).withColumn("names", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: i.cast("string"))))
    out = ordering.attach(rows, lists, ["k"], 1000)
    assert out.count() == 1000 and "Union" in out._jdf.queryExecution().optimizedPlan().toString()  # hot and cold keys apart
