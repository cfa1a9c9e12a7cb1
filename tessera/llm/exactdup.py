"""Exact deduplication as a stream with keyed state, in DataFrame operations only.

Every document's normalised text has a digest. A streaming aggregation keeps one entry for each
digest, in a disk-backed state store and without expiry: how many rows had it, and of the row that
stays the stable identifier and the locator of its content (file and row). A later run over more files goes on
from the same state. On a hit the retained row's bytes are looked up and compared whole; rows
of equal digest and other bytes are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path
from .common import checkpoint

BLANKS = " \t\n\x0b\x0c\r"
ROWS_TO_BROADCAST = 500_000
HOT_SHARE = 1000
ROWS_PER_SALT = 1000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store sets some MB aside
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}
Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """The text without blanks; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """(doc_id, file, row, chars, plain, digest) of a table or stream read from files."""
    at = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    at = at.select(F.col("doc_id").cast("long").alias("doc_id"), "file", "row", F.length(F.coalesce("text", F.lit(""))).alias("chars"), normalised(F.col("text")).alias("plain"))
    return at.withColumn("digest", digest(F.col("plain")))


def stays() -> Column:
    """The row that stays of those grouped: most code points, then least doc_id (null last), then the locator."""
    return F.max(F.struct("chars", F.bitwise_not("doc_id").alias("late"), "file", "row", "doc_id"))


def absorb(spark: SparkSession, path: str, schema, state: str, files_per_batch: int | None = None, digest: Digest = sha256) -> DataFrame:
    """(digest, n, best): the state after all files below path that it hasn't seen; best is the row that stays.

    state: a folder on storage that all executors share. It holds the stream's checkpoint, and with it the
    keyed state, and a log of the entries that each batch changed. A run that is cut off goes on at its last
    batch; running again over more files adds them to what is retained.
    """
    session = spark.newSession()  # its settings end with it
    for k, v in {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **STATE}.items():
        session.conf.set(k, v)
    reader = session.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    name = f"{path[:-1]}[{path[-1]}]"  # a pattern of one name: a stream takes no path of a single file
    seen = located(reader.parquet(name), digest).drop("plain").groupBy("digest").agg(F.count("*").alias("n"), stays().alias("best"))

    def log(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/log/batch={batch}")

    query = seen.writeStream.outputMode("update").option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).foreachBatch(log).start()
    query.awaitTermination()
    entries = spark.read.schema("digest string, n long, best struct<chars:int,late:long,file:string,row:long,doc_id:long>, batch long").parquet(f"{state}/log")
    if query.lastProgress is None or files_per_batch is None and int(query.lastProgress["batchId"]) == 0:
        return entries.drop("batch")
    return entries.groupBy("digest").agg(F.max_by(F.struct("n", "best"), "batch").alias("x")).select("digest", "x.n", "x.best")


def resolve(docs: DataFrame, state: DataFrame, digest: Digest = sha256, rows_to_broadcast: int = ROWS_TO_BROADCAST) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs, whose files the state has seen, and no others.

    Only rows whose digest was met more than once carry their text on. It meets the retained row's bytes
    by (digest, salt): a digest of any size is spread over tasks of about ROWS_PER_SALT rows.
    """
    info = state.where("n > 1").select("digest", "n", F.col("best.file").alias("k_file"), F.col("best.row").alias("k_row"), F.col("best.doc_id").alias("keep_id"))
    rows = located(docs, digest)
    few, total = info.limit(rows_to_broadcast + 1).count() <= rows_to_broadcast, None
    if few:
        rows = rows.join(F.broadcast(info), "digest", "left")
    else:  # digests with over a thousandth of the rows are broadcast: there can't be a thousand
        total = state.agg(F.sum("n")).first()[0]
        hot, cold = info.where(F.col("n") > total / HOT_SHARE), info.where(F.col("n") <= total / HOT_SHARE)
        names = ["n", "k_file", "k_row", "keep_id"]
        rows = rows.join(F.broadcast(hot.select("digest", F.struct(*names).alias("often"))), "digest", "left")
        rows = rows.withColumn("cold", F.when(F.col("often").isNull(), F.col("digest")))
        rows = rows.join(cold.select(F.col("digest").alias("cold"), F.struct(*names).alias("seldom")), "cold", "left").withColumn("x", F.coalesce("often", "seldom")).select("*", "x.*")
    hit = F.col("n").isNotNull()
    own = (F.col("file") == F.col("k_file")) & (F.col("row") == F.col("k_row"))
    sha = F.col("digest") if digest is sha256 else sha256(F.col("plain"))
    rows = checkpoint(rows.select("doc_id", "file", "row", "digest", "chars", "n", "keep_id", F.coalesce(own, F.lit(False)).alias("own"), F.when(hit, F.col("plain")).alias("plain"), sha.alias("text_sha256")))
    salts = F.ceil(F.col("n") / ROWS_PER_SALT).cast("int")
    kept = rows.where("own").select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("plain").alias("bytes"))
    members = rows.where("n is not null and not own").withColumn("salt", F.pmod(F.xxhash64("file", "row"), salts).cast("int"))
    apart = checkpoint(members.join(kept, ["digest", "salt"]).where(F.col("plain") != F.col("bytes")).select("doc_id", "file", "row", "digest", "chars", "plain", "text_sha256"))
    alone = F.col("n").isNull()
    if apart.isEmpty():
        return rows.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | F.col("own")).alias("kept"), "text_sha256")
    fewer = apart.groupBy("digest").agg(F.count("*").alias("gone"))
    equal = rows.join(apart.select("file", "row"), ["file", "row"], "left_anti").join(fewer, "digest", "left")
    equal = equal.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), (F.coalesce("n", F.lit(1)) - F.coalesce("gone", F.lit(0))).cast("long").alias("group_size"), (alone | F.col("own")).alias("kept"), "text_sha256")
    groups = apart.groupBy("plain").agg(F.count("*").alias("n"), stays().alias("best"))
    others = apart.join(groups, "plain").select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"), "text_sha256")
    return equal.unionByName(others)


def deduplicate(spark: SparkSession, path: str, state: str | None = None, files_per_batch: int | None = None, digest: Digest = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): every row of the Parquet table at path, and which row of its text stays.

    Texts are equal when identical without blanks; null counts as empty, and all empty texts are one group. Of
    a group the row with the most code points stays, then the least doc_id, a null id last; of rows that tie
    in that too, one. Repeated rows count each time. Whole texts of any length are compared; other columns
    are not read. An empty table gives no row. state: as absorb's, kept for the next run; none is a new one.
    """
    docs = spark.read.parquet(path)
    schema = docs.select("doc_id", "text").schema
    return resolve(docs, absorb(spark, path, schema, state or new_path(spark), files_per_batch, digest), digest)


def op12_exactdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table `documents`."""
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER w = 1 AS kept, sha256(plain) AS text_sha256
FROM d WINDOW w AS (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST, r)
"""
