"""Numbers and running sums over a whole table in order, and joins of hot keys: no task sees more than its share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

HOT_SHARE = 1000
KEYS_TO_BROADCAST = 100_000
BYTES_TO_BROADCAST = 32 << 20  # as JSON


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df sorted over all its partitions, with _part and _row: ranges of the order, and the place in them from 0.

    Ranges are cut between rows, not between keys, so a key of any size is spread. Written once, so
    that the numbers stay.
    """
    return placed(df.repartitionByRange(*order).sortWithinPartitions(*order))


def placed(df: DataFrame) -> DataFrame:
    """df written as it is, with _part and _row of each row."""
    t = stored(df.withColumn("_m", F.monotonically_increasing_id()))
    return t.select(*[c for c in t.columns if c != "_m"], F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_row"))


def _before(sums: DataFrame) -> DataFrame:
    """sums (_part, _sum), one row for each partition: the sum of all partitions before."""
    upto = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select("_part", F.coalesce(upto, F.lit(0)).alias("_base")))  # as many rows as there were tasks


def numbered(t: DataFrame, into: str, start: int = 0) -> DataFrame:
    """t (of ranged or placed) with the rows' numbers from start, without gaps; _part and _row go."""
    base = _before(t.groupBy("_part").agg(F.count("*").alias("_sum")))
    return t.join(base, "_part").withColumn(into, F.col("_base") + F.col("_row") + start).drop("_part", "_row", "_base")


def running(t: DataFrame, value: Column, into: str) -> DataFrame:
    """t (of ranged) with the sum of value (long) over all rows up to this one; _part and _row go."""
    t = t.withColumn("_v", value)
    base = _before(t.groupBy("_part").agg(F.sum("_v").alias("_sum")))
    own = F.sum("_v").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("_own", own).join(base, "_part").withColumn(into, F.col("_own") + F.col("_base")).drop("_part", "_row", "_v", "_own", "_base")


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], total: int, held: str = "_n") -> DataFrame:
    """Inner join of rows with table, whose keys are unique and whose column `held` says how many rows have each.

    A table of few keys, and of few bytes in all, is broadcast. Of others, keys with more than a thousandth of all rows, of which there
    can't be a thousand, are broadcast; the rest are too small to be hot in a shuffle. Both should be stored:
    they are read twice.
    """
    keys = list(keys)
    size = table.limit(KEYS_TO_BROADCAST + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if size[0] <= KEYS_TO_BROADCAST and size[1] <= BYTES_TO_BROADCAST:
        return rows.join(F.broadcast(table.drop(held)), keys)
    hot = table.where(F.col(held) > total / HOT_SHARE).drop(held)
    cold = table.where(F.col(held) <= total / HOT_SHARE).drop(held)
    columns = [*rows.columns, *[c for c in table.columns if c not in (*keys, held)]]
    often = F.broadcast(hot)
    return rows.join(often, keys).select(*columns).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys).select(*columns))


def salted_join(rows: DataFrame, table: DataFrame, key: str, held: DataFrame, total: int) -> DataFrame:
    """Inner join of rows with table (any number of rows a key) on one key column.

    held: (key, _n) says how many of the total rows have each key. A key with more than a thousandth of
    them (there can't be a thousand such) is dealt to several tasks, and table's rows for it to each of them.
    """
    share = F.ceil(F.col("_n") * HOT_SHARE / max(total, 1)).cast("int")
    hot = F.broadcast(held.where(F.col("_n") > total / HOT_SHARE).select(key, share.alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.floor(F.rand(7) * salts).cast("int")).drop("_salts")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")
