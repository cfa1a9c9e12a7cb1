"""Prefix trie of conversations by prefix doubling.

Turns get dense names; blocks of a power of two turns get theirs from the names of their halves, in
a logarithmic number of join rounds. A prefix is the row of blocks that the binary digits of its
length cut it into, so prefixes are named from shorter ones in as many rounds as lengths have
digits set. Nodes are the groups of equal prefix names.

Sums over a subtree need no walk down the trie: the least member of a node owns it, and what each
conversation adds to the nodes on its own path is a running sum along that path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordering import attach, numbered, placed, ranged, running
from .common import CRC_TABLE_SQL, checkpoint, crc_sql

PREFIX_TURNS = 6
BASE = 100
IDS_PER_PIECE = 200


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % PREFIX_TURNS


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, sym, chars): each conversation's turns from 1; sym is the SHA-256 of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sym = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", sym.alias("sym"), F.length(text).cast("long").alias("chars"))
    rows = checkpoint(numbered(ranged(rows, F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("sym")), "at"))
    first = rows.groupBy("conv_id").agg(F.count("*").alias("_n"), F.min("at").alias("first"))
    return attach(rows, checkpoint(first), ["conv_id"], rows.count()).select("conv_id", (F.col("at") - F.col("first") + 1).alias("pos"), "sym", "chars")


def rebuilt(turn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, length; their turns): the first turns of conversation c - c % 100, then c's own after as many."""
    c, h = F.col("conv_id"), shared_turns(F.col("conv_id"))
    size = turn.groupBy("conv_id").agg(F.max("pos").alias("own"))
    base = turn.where((F.col("pos") < PREFIX_TURNS) & (c % BASE == 0)).select(c.alias("base"), "pos", "sym", "chars")
    have = base.groupBy("base").agg(F.max("pos").alias("lent"))
    convs = size.select("conv_id", "own", (c - c % BASE).alias("base"), h.alias("h")).join(have, "base", "left")
    convs = convs.withColumn("lent", F.least(F.coalesce("lent", F.lit(0)), "h"))
    convs = checkpoint(convs.withColumn("length", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    lent = convs.join(base, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "sym", "chars")  # at most 5 rows for each of 100
    shift = attach(checkpoint(turn.where(F.col("pos") > h)), convs.select("conv_id", "lent", F.col("own").alias("_n")), ["conv_id"], turn.count())
    own = shift.select("conv_id", (F.col("lent") + F.col("pos") - h).alias("pos"), "sym", "chars")
    return convs.select("conv_id", "length"), checkpoint(lent.unionByName(own))


def named(rows: DataFrame, keys: list[str], start: int) -> tuple[DataFrame, int]:
    """rows with name, dense numbers from start of the distinct keys, instead of the keys; and the next free number."""
    names = placed(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    found, total = names.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    return attach(rows, numbered(names, "name", start), keys, total).drop(*keys), start + found


def prefixes(turn: DataFrame) -> DataFrame:
    """(conv_id, d, chars, node) of rebuilt turns (conv_id, pos, sym, chars): the name of each prefix of d turns; from 1, as 0 is the root's."""
    longest = turn.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    level, free = named(turn, ["sym"], 1)
    level = checkpoint(level.select("conv_id", (F.col("pos") - 1).alias("j"), "name", "chars"))
    chars = level.select("conv_id", (F.col("j") + 1).alias("d"), "chars")
    blocks, k = [level.where("j % 2 = 0").select("conv_id", (F.col("j") + 1).alias("d"), "name")], 0
    while 2 << k <= longest:  # blocks of 2^(k+1) turns, each at a multiple of its length
        k += 1
        half = lambda odd, into: F.max(F.when(F.col("j") % 2 == odd, F.col("name"))).alias(into)
        pairs = level.groupBy("conv_id", F.floor(F.col("j") / 2).cast("long").alias("j2")).agg(half(0, "a"), half(1, "b")).where("b is not null")
        level, free = named(pairs, ["a", "b"], free)
        level = checkpoint(level.select("conv_id", F.col("j2").alias("j"), "name"))
        blocks.append(level.where("j % 2 = 0").select("conv_id", ((F.col("j") + 1) * (1 << k)).alias("d"), "name"))
    block = blocks[0]
    for b in blocks[1:]:
        block = block.unionByName(b)  # one for each prefix: the block that ends it, as long as the least digit set of d
    digits, low = F.bit_count("d"), F.col("d").bitwiseAND(-F.col("d"))
    block = checkpoint(block.withColumn("digits", digits))
    last = block.where("digits = 1").select("conv_id", "d", F.col("name").alias("node"))
    done = [last]
    for r in range(2, int(longest).bit_length() + 1):
        before = last.select("conv_id", F.col("d").alias("prev"), F.col("node").alias("a"))
        pairs = block.where(F.col("digits") == r).withColumn("prev", F.col("d") - low).join(before, ["conv_id", "prev"])
        last, free = named(pairs.select("conv_id", "d", "a", F.col("name").alias("b"), F.col("d").alias("e")), ["e", "a", "b"], free)
        last = checkpoint(last.withColumnRenamed("name", "node"))
        done.append(last)
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return checkpoint(every.join(chars, ["conv_id", "d"]))


def digest_of_ids(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): the SHA-256 of each node's ids, ascending and joined by commas.

    Ids are sorted over all partitions and joined there, whatever node they end at; a node's hash, which
    can only be taken in order, then streams over joined pieces, of which no more than a batch is in memory.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, ids = b.column("node").to_numpy(), b.column("conv_id").to_numpy()
            at = np.arange(len(node))
            fresh = np.diff(node, prepend=node[0] - 1) != 0
            cut = np.flatnonzero(fresh | ((at - np.maximum.accumulate(np.where(fresh, at, 0))) % IDS_PER_PIECE == 0))
            text = [",".join(map(str, part.tolist())) for part in np.split(ids, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(node[cut]), pa.array(ids[cut]), pa.array(text, pa.string())], ["node", "first", "ids"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out: list[tuple[int, str]] = []
            for node, ids in zip(b.column("node").to_pylist(), b.column("ids"), strict=True):
                if node == now:
                    state.update(b",")
                else:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                state.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    order = [F.asc("node"), F.asc("conv_id")]
    pieces = rows.select("node", "conv_id").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "node long, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(fold, "node long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct beginning of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text; other columns are not read. Rows without a conv_id take no part; null role
    and text count as empty. Turns go by turn, null first; of equal turns the order is that of the SHA-256 of role and
    text, and a repeated row is a turn of its own. Turns of equal SHA-256 are held equal. A conversation whose turns
    all fall away is still a member of the root. An empty table gives no node.
    """
    convs, turn = rebuilt(checkpoint(turns(conversations)))
    path = prefixes(turn)
    nodes = path.groupBy("node").agg(F.count("*").alias("_n"), F.min("conv_id").alias("least"), F.first("d").alias("depth"))
    nodes = checkpoint(nodes)
    rows = path.count()
    inner = path.select(F.col("conv_id").alias("least"), (F.col("d") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = checkpoint(nodes.join(inner, ["least", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(0))))
    children = checkpoint(nodes.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node"))
    leaf = nodes.join(children, "node", "left_anti").select(F.col("least").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    own = nodes.select("node", "least", "_n")
    x = attach(path, own, ["node"], rows).withColumn("spare", F.when(F.col("conv_id") == F.col("least"), 0).otherwise(F.col("chars")))
    order = ranged(x.select("conv_id", "d", "node", "spare"), F.asc("conv_id"), F.desc("d"))
    sums = checkpoint(running(order, F.col("spare"), "upto"))
    ends = sums.groupBy("conv_id").agg(F.min(F.col("upto") - F.col("spare")).alias("before"), F.count("*").alias("_n")).join(leaf, "conv_id", "left")
    tails = attach(sums, checkpoint(ends), ["conv_id"], rows).select("conv_id", "d", "node", (F.col("upto") - F.col("before")).alias("tail"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    tails = checkpoint(tails)
    below = tails.groupBy("node").agg(F.sum("tail").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    last = convs.where("length > 0").select("conv_id", F.col("length").alias("d"))
    stop = path.join(last, ["conv_id", "d"]).select("node", "conv_id").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("node"), "conv_id"))
    ids = digest_of_ids(stop)
    n, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    top = tails.where("d = 1").agg(F.coalesce(F.sum("tail"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"))
    root = top.select(F.lit(0).cast("long").alias("node"), F.lit(least).cast("long").alias("least"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(n).cast("long").alias("_n"), "saved_tokens", F.when(F.lit(not rows), F.lit(1)).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"))
    every = nodes.join(below, "node").select("node", "least", F.col("depth").cast("long").alias("depth"), "parent", "_n", "saved_tokens", "n_leaves").unionByName(root.where(F.lit(n > 0)))
    parents = nodes.select(F.col("node").alias("parent"), F.col("least").alias("above")).unionByName(root.select(F.col("node").alias("parent"), F.col("least").alias("above")))
    every = every.join(parents, "parent", "left").join(children, "node", "left").join(ids, "node", "left")
    return every.select(F.col("least").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("_n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table `conversations`."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP11_SQL = f"""
WITH {CRC_TABLE_SQL}, q AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS pos, x, n FROM (
    SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)
), cv AS MATERIALIZED (SELECT c, own, {crc_sql("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT c, count(*) AS own FROM q GROUP BY c), tb),
lt AS (SELECT cv.c, cv.h, q.pos, q.x, q.n FROM cv JOIN q ON q.c = cv.c - cv.c % 100 AND q.pos <= cv.h),
rb AS MATERIALIZED (
  SELECT c, pos AS d, x, n FROM lt
  UNION ALL SELECT cv.c, coalesce(k.lent, 0) + q.pos - cv.h, q.x, q.n FROM cv JOIN q ON q.c = cv.c AND q.pos > cv.h LEFT JOIN (SELECT c, count(*) AS lent FROM lt GROUP BY c) k ON k.c = cv.c
), p AS MATERIALIZED (
  SELECT c, 0 AS d, '' AS k, 0 AS n FROM cv UNION ALL SELECT c, d, string_agg(x, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), n FROM rb
), e AS (SELECT c, max(d) AS len FROM p GROUP BY c),
nd AS MATERIALIZED (SELECT p.d, p.k, min(p.c) AS c, count(*) AS m, any_value(p.n) AS n, sha256(coalesce(string_agg(CASE WHEN e.len = p.d THEN CAST(p.c AS VARCHAR) END, ',' ORDER BY p.c), '')) AS ends FROM p JOIN e ON e.c = p.c GROUP BY p.d, p.k),
u AS MATERIALIZED (SELECT nd.d, nd.k, b.k AS up FROM nd LEFT JOIN p b ON b.c = nd.c AND b.d = nd.d - 1),
ch AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM u WHERE d > 0 GROUP BY 1, 2),
s AS (
  SELECT a.d, a.k, sum(CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((nd.m - 1) * nd.n) AS saved
  FROM nd JOIN p a ON a.c = nd.c AND a.d <= nd.d LEFT JOIN ch ON ch.d = nd.d AND ch.k = nd.k GROUP BY a.d, a.k
)
SELECT nd.c AS conv_id, CAST(nd.d AS BIGINT) AS depth, o.c AS parent_conv_id, nd.m AS n_convs, coalesce(ch.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, nd.ends AS ends_sha256
FROM nd JOIN u ON u.d = nd.d AND u.k = nd.k JOIN s ON s.d = nd.d AND s.k = nd.k LEFT JOIN ch ON ch.d = nd.d AND ch.k = nd.k LEFT JOIN nd o ON o.d = nd.d - 1 AND o.k = u.up
"""
