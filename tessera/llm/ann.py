"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Inner product is turned into Euclidean nearness by one more component, sqrt(1 - |x|^2 / M^2) with
M the largest norm, which is 0 for queries. Each tree splits at the median of a projection on the
unit difference of two random sample points, so that margins are distances and compare between
trees. The trees are fitted on a bounded sample; every row is then routed to its leaf in every
tree.

A query's margin to a leaf is the largest distance to a hyperplane between them. A first look pops
leaves of one tree, nearest first, until they hold `first_rows` rows, and gives the distance of
the (k + 1)-th best row seen. Then the queue that all trees share is emptied up to a margin of
`reach` times that distance. A query inside a cluster needs few leaves, one in the open many; no
share of the table is set. `reach` is measured: a few queries are searched exactly, and it is what
would find `recall` of their true neighbours. Leaves' rows are scored exactly in double precision.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, checkpoint, columns_first
from .topk import finite

SAMPLE_ROWS = 200_000
LEAVES_TO_BROADCAST = 1_000_000
PAIRS = 1 << 16  # rescored at once


@dataclass
class Tree:
    direction: np.ndarray  # inner nodes x (d + 1), unit vectors
    threshold: np.ndarray
    child: np.ndarray  # inner nodes x 2: an inner node, or ~leaf
    size: np.ndarray  # share of the sample in each leaf


def fit_tree(points: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    """points: the sample, augmented. Of a few directions each node takes the one along which its points spread most.

    Nodes with leaf_rows points, or whose points are all alike, become leaves.
    """
    direction, threshold, child, size = [], [], [], []

    def split(rows: np.ndarray):
        few = rows if len(rows) <= 1024 else rng.choice(rows, 1024, replace=False)
        a, b = points[rng.choice(rows, 8)], points[rng.choice(rows, 8)]
        norm = np.sqrt(((a - b) ** 2).sum(axis=1))
        if not norm.any():
            return None
        ways = ((a - b) / np.where(norm > 0, norm, 1)[:, None])[norm > 0]
        way = ways[int(np.argmax((points[few] @ ways.T).std(axis=0)))]
        projected = points[rows] @ way
        cut = float(np.median(projected))
        left = projected < cut
        return (way, cut, left) if left.any() else None

    def grow(rows: np.ndarray) -> int:
        if len(rows) > leaf_rows:
            for _ in range(4):
                if found := split(rows):
                    node = len(direction)
                    direction.append(found[0])
                    threshold.append(found[1])
                    child.append([0, 0])
                    child[node] = [grow(rows[found[2]]), grow(rows[~found[2]])]
                    return node
        size.append(len(rows) / max(1, len(points)))
        return ~(len(size) - 1)

    grow(np.arange(len(points)))
    d = points.shape[1]
    return Tree(np.array(direction, np.float64).reshape(-1, d), np.array(threshold), np.array(child, np.int64).reshape(-1, 2), np.array(size))


def root(tree: Tree) -> int:
    return 0 if len(tree.direction) else -1


def route(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x."""
    at = np.full(len(x), root(tree))
    while len(open_ := np.flatnonzero(at >= 0)):
        node = at[open_]
        right = np.einsum("ij,ij->i", x[open_], tree.direction[node]) >= tree.threshold[node]
        at[open_] = tree.child[node, right.astype(int)]
    return ~at


def margins(tree: Tree, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Margin of each query (row of q) to the leaf of its row of x."""
    at, far = np.full(len(x), root(tree)), np.zeros(len(x))
    while len(open_ := np.flatnonzero(at >= 0)):
        node = at[open_]
        way, cut = tree.direction[node], tree.threshold[node]
        own = np.einsum("ij,ij->i", q[open_], way) - cut
        right = np.einsum("ij,ij->i", x[open_], way) >= cut
        away = right != (own >= 0)
        far[open_] = np.maximum(far[open_], np.where(away, np.abs(own), 0))
        at[open_] = tree.child[node, right.astype(int)]
    return far


def first_look(tree: Tree, q: np.ndarray, share: float) -> list[int]:
    """The leaves nearest to q, popped until they hold `share` of the rows."""
    heap, got, held = [(0.0, root(tree))], [], 0.0
    while heap and held < share:
        far, node = heapq.heappop(heap)
        while node >= 0:
            m = float(tree.direction[node] @ q - tree.threshold[node])
            near = int(m >= 0)
            heapq.heappush(heap, (max(far, abs(m)), int(tree.child[node, 1 - near])))
            node = int(tree.child[node, near])
        got.append(~node)
        held += tree.size[~node]
    return got


def within(tree: Tree, q: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) for all leaves within each query's reach: what its queue gives until its head lies beyond; taken level by level."""
    own, at = np.arange(len(q)), np.full(len(q), root(tree))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(own):
        leaf = at < 0
        out.append((own[leaf], ~at[leaf]))
        own, at = own[~leaf], at[~leaf]
        if not len(own):
            break
        m = np.einsum("ij,ij->i", q[own], tree.direction[at]) - tree.threshold[at]
        near = (m >= 0).astype(int)
        cross = np.abs(m) <= reach[own]
        own, at = np.concatenate([own, own[cross]]), np.concatenate([tree.child[at, near], tree.child[at[cross], 1 - near[cross]]])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def augment(x: np.ndarray, norm: float) -> np.ndarray:
    x = x / norm
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def query_points(x: np.ndarray) -> np.ndarray:
    return np.hstack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))])


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1)


def by_length(batch: pa.RecordBatch):
    """Parts of the batch with vectors of one length, with their length."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        yield int(d), batch if (dims == d).all() else batch.filter(pa.array(dims == d))


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, m: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): each query's m best rows of x by score, then smaller id, whose score is at least its floor.

    A product finds the rows that may be among them, with all that tie; their scores are then summed in one fixed order.
    """
    rough = q @ x.T
    slack = 1e-12 * x.shape[1] * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max(initial=0))
    least = floor - slack
    if m < len(x):
        least = np.maximum(least, np.partition(rough, len(x) - m, axis=1)[:, len(x) - m] - 2 * slack)
    i, j = np.nonzero(rough >= least[:, None])
    score = np.concatenate([(q[i[a : a + PAIRS]] * x[j[a : a + PAIRS]]).sum(axis=1) for a in range(0, len(i), PAIRS)] or [np.zeros(0)])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = (place < m) & (score >= floor[i])
    return i[keep], ids[j[keep]], score[keep]


def search(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 3, leaf_rows: int = 256, first_rows: int = 1024, recall: float = 0.93, judged: int = 128, sample_rows: int = SAMPLE_ROWS, block_rows: int = 4096, seed: int = 5, figures: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found.

    vectors: vec_id long, embedding array of floats. Null ids, and vectors that are null, empty, zero
    or hold null or non-finite components take no part; vectors of another length than the query's
    never meet it. Exactly repeated rows count once. Equal vectors form one class that is searched
    once; of a class only its k + 1 smallest ids can be among any k best, so only these are kept.
    Ties go to the smaller vec_id. An empty table gives no row.

    The trees see at most about sample_rows rows, `reach` about `judged` queries. Up to sample_rows
    / 16 * leaf_rows rows (3.2 million) leaves keep their size. A leaf's rows, and the queries that
    visit it, are cut in blocks of block_rows; a leaf is copied once for each block of its own queries.
    `figures`, if given, gets what a search costs: rows, queries, and scored (rows scored, all trees together).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).dropDuplicates()
    rows = checkpoint(rows)
    w = Window.partitionBy("embedding").orderBy("vec_id")
    classes = rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = checkpoint(classes.select(F.col("ids")[0].alias("cid"), F.size("embedding").alias("dim"), "embedding", "ids"))
    asked = checkpoint(rows.where("q").select(F.col("vec_id").alias("query_id"), "embedding").join(classes.select("embedding", "cid"), "embedding").select("query_id", "cid"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    lengths = {r["dim"]: (r["n"], r["norm"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm")).collect()}  # a row for each length of vectors
    n, nq = sum(n for n, _ in lengths.values()), asked.select("cid").distinct().count()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = lambda salt, rate: F.pmod(F.xxhash64("cid", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1, rate))
    sample = classes.where(drawn(seed, sample_rows / n)).select("cid", "dim", "embedding").orderBy("cid").toArrow()
    rng = np.random.default_rng(seed)
    forests: dict[int, tuple[list[Tree], float, int]] = {}
    for d, (m, norm) in sorted(lengths.items()):
        own = sample.filter(pa.compute.equal(sample["dim"], d))
        points = augment(matrix(own["embedding"], len(own)), norm) if len(own) else np.zeros((1, d + 1))
        forests[d] = [fit_tree(points, max(16, round(leaf_rows * min(1, len(points) / m))), rng) for _ in range(trees)], norm, m
    shared = spark.sparkContext.broadcast(forests)
    parts_of = lambda tree, m: np.maximum(1, np.ceil(tree.size * m / block_rows)).astype(np.int64)
    few = lambda t: pa.array(np.full(t[1], t[0], np.int32))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nq // 4096))
    stored = classes.schema["embedding"].dataType.simpleString()  # vectors travel as stored; doubles only where they are multiplied

    def look(tree: Tree, m: int, x: np.ndarray) -> list[list[int]]:
        return [first_look(tree, q, first_rows / m) for q in query_points(x)]

    def indexed(only_first: bool):
        def run(batches):
            for b in batches:
                for d, b in by_length(b):
                    forest, norm, m = shared.value[d]
                    x = augment(matrix(b.column("embedding"), b.num_rows), norm)
                    deal = (b.column("cid").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    for t, tree in enumerate(forest[:1] if only_first else forest):
                        leaf = route(tree, x)
                        yield pa.RecordBatch.from_arrays([few((d, b.num_rows)), few((t, b.num_rows)), pa.array(leaf), pa.array(deal % parts_of(tree, m)[leaf]), b.column("cid"), b.column("embedding")], ["dim", "tree", "leaf", "part", "cid", "embedding"])

        return classes.select("cid", "dim", "embedding").mapInArrow(run, f"dim int, tree int, leaf long, part long, cid long, embedding {stored}")

    def visits(d: int, t: int, query: np.ndarray, leaf: np.ndarray, b: pa.RecordBatch, floor: pa.Array) -> pa.RecordBatch:
        """A row for each part of each leaf that a query visits."""
        n_parts = parts_of(shared.value[d][0][t], shared.value[d][2])[leaf]
        i = np.repeat(np.arange(len(leaf)), n_parts)
        part = np.arange(len(i)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        own = pa.array(query[i])
        return pa.RecordBatch.from_arrays([few((d, len(i))), few((t, len(i))), pa.array(leaf[i]), pa.array(part), b.column("cid").take(own), floor.take(own)], ["dim", "tree", "leaf", "part", "cid", "floor"])

    visit = "dim int, tree int, leaf long, part long, cid long, floor double"

    def first(batches):
        for b in batches:
            for d, b in by_length(b):
                forest, _, m = shared.value[d]
                got = [(i, leaf) for i, leaves in enumerate(look(forest[0], m, matrix(b.column("embedding"), b.num_rows))) for leaf in leaves]
                query, leaf = np.array(got, np.int64).reshape(-1, 2).T
                yield visits(d, 0, query, leaf, b, pa.array(np.full(b.num_rows, -np.inf)))

    def rest(reach: float):
        def run(batches):
            for b in batches:
                for d, b in by_length(b):
                    for at in range(0, b.num_rows, 256):
                        c = b.slice(at, 256)
                        forest, norm, m = shared.value[d]
                        x, floor = matrix(c.column("embedding"), c.num_rows), c.column("floor").to_numpy()
                        seen = look(forest[0], m, x)
                        far = np.array([np.inf if len(s) < len(forest[0].size) else -1.0 for s in seen])  # where the first look saw all rows, nothing is left
                        far = np.minimum(far, np.where(np.isfinite(floor), reach * np.sqrt(np.maximum(0, 2 - 2 * np.maximum(floor, -1e300) / (np.sqrt((x * x).sum(axis=1)) * norm))), np.inf))
                        go = np.flatnonzero(far >= 0)
                        for t, tree in enumerate(forest):
                            query, leaf = within(tree, query_points(x)[go], far[go])
                            query = go[query]
                            if t == 0:
                                old = np.array([i * len(tree.size) + y for i, s in enumerate(seen) for y in s], np.int64)
                                new = ~np.isin(query * len(tree.size) + leaf, old)
                                query, leaf = query[new], leaf[new]
                            yield visits(d, t, query, leaf, c, c.column("floor"))

        return run

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        got = []
        if len(a) and len(b):
            ids, own, x, q, floor = a["cid"].to_numpy(), b["cid"].to_numpy(), matrix(a["embedding"], len(a)), matrix(b["embedding"], len(b)), b["floor"].to_numpy()
            for at in range(0, len(q), 256):
                i, found, value = best(q[at : at + 256], x, ids, k + 1, floor[at : at + 256])
                got.append((own[at + i], found, value))
        cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("qcid", "cid", "score"), cols, strict=True)))

    def meet(index: DataFrame, visiting: DataFrame) -> DataFrame:
        """(qcid, cid, score): each visited block's best for each of its queries."""
        visiting = checkpoint(visiting)
        leaf = ["dim", "tree", "leaf"]
        blocks = checkpoint(visiting.groupBy(*leaf, "part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("qbs")))
        blocks = broadcast_if(blocks, LEAVES_TO_BROADCAST)
        if figures is not None:
            held = index.groupBy(*leaf, "part").agg(F.count("*").alias("m"))
            scored = visiting.join(held, [*leaf, "part"]).agg(F.sum("m")).first()[0] or 0
            figures.update(rows=n, queries=nq, scored=figures.get("scored", 0) + scored)
        key = [*leaf, "part", "qb"]
        left = index.join(blocks, [*leaf, "part"]).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1))).select(*key, "cid", "embedding")
        right = visiting.join(blocks, [*leaf, "part"]).withColumn("qb", F.pmod(F.xxhash64("cid"), F.col("qbs")).cast("int")).join(queries.select("cid", "embedding"), "cid").select(*key, "cid", "floor", "embedding")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, "qcid long, cid long, score double")

    top = lambda df: df.withColumn("at", F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("score"), F.asc("cid")))).where(F.col("at") <= k + 1)
    queries = checkpoint(classes.select("cid", "dim", "embedding").join(asked.select("cid").distinct(), "cid", "left_semi").repartition(tasks, "cid"))
    near = checkpoint(meet(indexed(True), queries.mapInArrow(first, visit)))
    floors = top(near).groupBy("qcid").agg(F.min(F.when(F.col("at") == k + 1, F.col("score"))).alias("floor"))
    queries = checkpoint(queries.join(floors.withColumnRenamed("qcid", "cid"), "cid", "left").select("cid", "dim", "embedding", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")).repartition(tasks, "cid"))
    reach = measured_reach(classes, queries.where(drawn(seed + 1, judged / nq)), forests, k, recall)
    more = meet(indexed(False), queries.mapInArrow(rest(reach), visit))
    pairs = near.unionByName(more).groupBy("qcid", "cid").agg(F.max("score").alias("score"))
    each = top(pairs).drop("at").join(classes.select("cid", "ids"), "cid").select("qcid", F.explode("ids").alias("vec_id"), "score")
    by = Window.partitionBy("qcid").orderBy(F.desc("score"), F.asc("vec_id"))
    lists = each.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k + 1).groupBy("qcid").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("list"))
    found = asked.join(lists, asked["cid"] == lists["qcid"]).select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return found.select("query_id", F.posexplode("list").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def measured_reach(classes: DataFrame, judged: DataFrame, forests: dict, k: int, recall: float) -> float:
    """The share of its floor's distance within which a query must visit leaves to meet `recall` of its k nearest.

    judged: a bounded sample of queries (cid, dim, embedding, floor), searched exactly in one pass over classes.
    """
    spark = classes.sparkSession
    asked = judged.select("cid", "dim", "embedding", "floor").orderBy("cid").toArrow()
    by_dim = {}
    for d in sorted(set(asked["dim"].to_pylist())):
        own = asked.filter(pa.compute.equal(asked["dim"], d))
        by_dim[d] = own["cid"].to_numpy(), matrix(own["embedding"], len(own)), own["floor"].to_numpy()
    if not by_dim:
        return float("inf")
    shared = spark.sparkContext.broadcast(by_dim)

    def run(batches):
        best_: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for d, b in by_length(b):
                if d not in shared.value:
                    continue
                ids, q, _ = shared.value[d]
                i, found, score = best(q, matrix(b.column("embedding"), b.num_rows), b.column("cid").to_numpy(), k + 1, np.full(len(q), -np.inf))
                old = best_.get(d, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)])
                i, found, score = (np.concatenate(c) for c in zip(old, (i, found, score), strict=True))
                order = np.lexsort((found, -score, i))
                i, found, score = i[order], found[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
                best_[d] = [i[keep], found[keep], score[keep]]
        for d, (i, found, score) in best_.items():
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[d][0][i]), pa.array(found), pa.array(score)], ["qcid", "cid", "score"])

    true = classes.select("cid", "dim", "embedding").mapInArrow(run, "qcid long, cid long, score double").where("qcid <> cid")
    true = true.withColumn("at", F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("score"), F.asc("cid")))).where(F.col("at") <= k)
    true = classes.select("cid", "dim", "embedding").join(F.broadcast(checkpoint(true.select("qcid", "cid"))), "cid").orderBy("qcid", "cid").toArrow()  # k rows for each judged query
    need = []
    for d, (ids, q, floor) in by_dim.items():
        own = true.filter(pa.compute.equal(true["dim"], d))
        if not len(own):
            continue
        forest, norm, _ = forests[d]
        at = np.searchsorted(ids, own["qcid"].to_numpy())
        x, points = augment(matrix(own["embedding"], len(own)), norm), query_points(q)[at]
        far = np.min([margins(tree, points, x) for tree in forest], axis=0)
        size = np.sqrt((q * q).sum(axis=1))
        known = np.isfinite(floor)
        distance = np.sqrt(np.maximum(0, 2 - 2 * np.where(known, floor, 0) / (size * norm)))[at]
        need.append(np.where(known[at], far / np.maximum(distance, 1e-12), 0.0))
    return float(np.quantile(np.concatenate(need), recall, method="higher")) if need else float("inf")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table `embeddings`; queries: vec_id divisible by 20; 20 nearest by inner product."""
    e = columns_first(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(e, F.col("vec_id") % 20 == 0, k=20)
