"""Near-duplicate documents by DartMinHash signatures, banding and an exact check.

Darts come from a Poisson process over (element, weight, rank) that every document sees alike: a
hash of an element throws the element's darts, strip by strip of the rank axis, and those below
the element's weight hit. Only ranks up to about t / total weight are thrown, so that some t darts
hit whatever the document's size; each dart falls on one of k coordinates, and the earliest on
each is the signature. Two documents agree on a coordinate with the probability of their weighted
Jaccard similarity. Bands of coordinates propose pairs, and shingle sets decide them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if, checkpoint, chunks, columns_first, mix, ngrams, release_memory, unused, word_hashes
from .graph import merge

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
NODES_TO_BROADCAST = 4_000_000
SALT_ROWS = 1000  # members of a bucket that meet its leader in one task

FINEST = 20  # ranks below 2^-FINEST form one strip, then strips double up to rank 1, then each is 1 wide
SLICE = 1 << 17  # elements thrown at once: bounds a worker's memory
CHUNK = 1 << 20
EMPTY = np.uint64(2**64 - 1)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _strips() -> list[tuple[float, float]]:
    edges = [0.0, *(2.0**-i for i in range(FINEST, -1, -1))]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson variates from uniform ones, by the inverse distribution."""
    term = acc = np.exp(-mean)
    table = [acc]
    for i in range(1, 40):
        term *= mean / i
        acc += term
        table.append(acc)
    return np.searchsorted(table, u, side="right")


def _throw(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, unit: np.ndarray, strip: np.ndarray, mean: float, out: np.ndarray) -> None:
    """Throw the darts of each (element, unit of weight, strip) and keep the least key on each coordinate.

    A key orders darts by rank: strip number, then place in the strip.
    """
    k = out.shape[1]
    if len(element) > SLICE:
        for at in range(0, len(element), SLICE):
            part = slice(at, at + SLICE)
            _throw(element[part], owner[part], weight[part], unit[part], strip[part], mean, out)
        return
    seed = mix(element ^ mix(strip * GOLD + unit + np.uint64(1)))
    n = _poisson(_uniform(seed), mean)
    hit = np.flatnonzero(n)
    n = n[hit]
    i = np.repeat(hit, n)
    nth = (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    dart = mix(seed[i] + (nth + np.uint64(1)) * GOLD)
    inside = _uniform(mix(dart ^ np.uint64(0x5851F42D4C957F2D))) + unit[i] < weight[i]
    i, dart = i[inside], dart[inside]
    coordinate = (mix(dart ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64) * k >> 32
    key = strip[i] << np.uint64(48) | mix(dart + GOLD) >> np.uint64(16)
    np.minimum.at(out.reshape(-1), owner[i] * k + coordinate, key)


def signatures(element: np.ndarray, offset: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """(documents x k) uint64 signatures of weighted sets.

    element: distinct hashes within each document, offset: where each document begins; weight: 1
    for each where None. Documents without an element have EMPTY everywhere.
    """
    n = np.diff(offset)
    out = np.full((len(n), k), EMPTY)
    owner_all = np.repeat(np.arange(len(n)), n)
    weight = np.ones(len(element)) if weight is None else weight
    total = np.bincount(owner_all, weights=weight, minlength=len(n))
    darts = k * (np.log(k) + 3)
    low = np.zeros(len(n))
    todo = np.flatnonzero(total > 0)
    while len(todo):
        high = np.zeros(len(n))
        high[todo] = darts / total[todo]
        active = np.isin(owner_all, todo) if len(todo) < len(n) else np.ones(len(owner_all), bool)
        e, o, w = element[active], owner_all[active], weight[active]
        units = np.ceil(w).astype(np.int64)
        if units.max(initial=1) > 1:  # one region for each unit of weight
            each = np.repeat(np.arange(len(e)), units)
            unit = (np.arange(len(each)) - np.repeat(np.cumsum(units) - units, units)).astype(np.uint64)
            e, o, w = e[each], o[each], w[each]
        else:
            unit = np.zeros(len(e), np.uint64)
        top, bottom = high[o], low[o]
        for s, (a, b) in enumerate(_strips()):
            go = (a < top) & (b > bottom)
            if go.any():
                _throw(e[go], o[go], w[go], unit[go], np.full(int(go.sum()), s, np.uint64), b - a, out)
        first = np.maximum(np.floor(bottom), 1)
        more = np.maximum(np.ceil(top) - first, 0).astype(np.int64)
        if more.any():
            step = max(1, SLICE // max(1, int(more.max())))
            for at in range(0, len(e), step):
                part = slice(at, at + step)
                each = np.repeat(np.arange(at, at + len(more[part])), more[part])
                nth = np.arange(len(each)) - np.repeat(np.cumsum(more[part]) - more[part], more[part])
                strip = (FINEST + 1 + first[each].astype(np.int64) - 1 + nth).astype(np.uint64)
                _throw(e[each], o[each], w[each], unit[each], strip, 1.0, out)
        todo = todo[(out[todo] == EMPTY).any(axis=1)]
        low = high
        darts *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents x bands) keys of equal bands."""
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (len(signature), bands)).copy()
    cut = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + cut[:, :, r])
    return h


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, how often each stands there, and their offsets. A text of 1 to size - 1 words is one shingle."""
    words, at = word_hashes(texts)
    grams = ngrams(words, size)
    sets, counts = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = grams[a : b - size + 1] if b - a >= size else ngrams(words[a:b], b - a) if b > a else grams[:0]
        x, n = np.unique(own, return_counts=True)
        sets.append(x)
        counts.append(n)
    none = np.zeros(0, np.int64)
    return np.concatenate(sets) if sets else grams[:0], np.concatenate(counts) if counts else none, np.cumsum([0, *map(len, sets)])


def copies_apart(element: np.ndarray, count: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every copy of a shingle as an element of its own: the Jaccard similarity of these sets is the weighted one of the counts."""
    each = np.repeat(element, count)
    nth = (np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(count)])[offset]
    return np.where(nth > 0, mix(each + nth * GOLD), each), ends


def sketch(docs: DataFrame, bands: int, rows: int, size: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """rid, doc_id, t (hash of the text), n1 and n2 (128 bits naming the shingle set; null without words), n, bands, shingles (sorted 32-bit)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            element, count, offset = shingle_sets(b.column("text"), size)
            keys = band_keys(signatures(element, offset, bands * rows, count.astype(float) if weighted else None), bands, rows).view(np.int64)
            if weighted:
                element, offset = copies_apart(element, count, offset)
            n = np.diff(offset)
            mark = np.concatenate([[0], np.cumsum(mix(element), dtype=np.uint64)]).astype(np.uint64)
            other = np.concatenate([[0], np.cumsum(mix(element ^ GOLD), dtype=np.uint64)]).astype(np.uint64)
            none = n == 0
            n1, n2 = (pa.array((x[offset[1:]] - x[offset[:-1]]).view(np.int64), mask=none) for x in (mark, other))
            short = (element >> np.uint64(32)).astype("<u4")
            sets = [np.unique(short[x:y]).tobytes() for x, y in zip(offset[:-1], offset[1:], strict=True)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), b.column("t"), n1, n2, pa.array(n.astype(np.int32)), flat, pa.array(sets, pa.binary())], ["rid", "doc_id", "t", "n1", "n2", "n", "bands", "shingles"])

    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("t", F.xxhash64("text")).mapInArrow(run, "rid long, doc_id long, t long, n1 long, n2 long, n int, bands array<long>, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (node, n, shingles) have at least that Jaccard similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    sizes = pairs.join(a.drop("sa"), "a").join(b.drop("sb"), "b").where((F.least("na", "nb") >= similarity * 0.999 * F.greatest("na", "nb"))).select("a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_py(), "<u4") for v in (x, y))
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    return sizes.join(a.drop("na"), "a").join(b.drop("nb"), "b").mapInArrow(run, "a long, b long")


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(node, size, held): distinct shingles of each set, and those of them that another of the sets has too."""
    def run(batches):
        for batch in batches:
            for node, blob in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                x = np.frombuffer(blob, "<i4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node)), pa.array(x), pa.array(np.full(len(x), len(x), np.int32))], ["node", "x", "size"])

    each = sets.select("node", "shingles").mapInArrow(run, "node long, x int, size int")
    own = each.groupBy("x").agg(F.count("*").alias("m"), F.min("node").alias("node"), F.min("size").alias("size")).where("m = 1").groupBy("node").agg(F.count("*").alias("alone"))
    size = sets.select("node", F.expr("length(shingles) div 4").alias("size"))
    return size.join(own, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("held"))


def salted(by_key: DataFrame) -> DataFrame:
    """by_key (key, parts, ...) once for each part of its bucket."""
    return by_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def in_mixed(member: DataFrame, least: int = 2) -> DataFrame:
    """Rows of buckets (key) of at least so many members that hold more than one component. A bucket's rows are dealt over its parts."""
    mixed = member.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), F.max("parts").alias("parts")).where((F.col("x") != F.col("y")) & (F.col("m") >= least)).select("key", "parts")
    return checkpoint(member.join(salted(mixed), ["key", "salt"]))


def star_pairs(member: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs of each bucket's leader (key, parts, lead, own: its component) with the members of other components."""
    pairs = member.join(salted(leaders), ["key", "salt"]).where(F.col("comp") != F.col("own"))
    return pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def common(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """(len(a) x len(b)) sizes of the intersections of sorted sets, by products of 0/1 matrices over the values that both sides have."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, flat)
        hit = shared[np.minimum(at, len(shared) - 1)] == flat
        return row[hit], at[hit]

    if not len(shared):
        return out
    (ra, ca), (rb, cb) = places(a), places(b)
    for at in range(0, len(shared), columns):
        x, y = np.zeros((len(a), columns), np.float32), np.zeros((len(b), columns), np.float32)
        i, j = (ca >= at) & (ca < at + columns), (cb >= at) & (cb < at + columns)
        x[ra[i], ca[i] - at] = 1
        y[rb[j], cb[j] - at] = 1
        out += x @ y.T
    return out


def leftover_links(member: DataFrame, sets: DataFrame, similarity: float, block: int = 256) -> DataFrame:
    """Links (a, b) between components that share a bucket, found without listing pairs.

    A shingle that no other set of these buckets has can't be shared, so sets that lose more than a
    fifth of their shingles that way have no partner and go first. Each bucket's main component is
    its hub; a node outside it is compared with the hub's nodes and with the others outside it.
    Both sides of a hub are cut in blocks of nodes, two blocks meet in a task, and only links leave it.
    """
    sizes = checkpoint(shared_sizes(sets.join(member.select("node").distinct(), "node", "left_semi")))
    able = sizes.where(F.col("held") >= (similarity - 1e-9) * F.col("size")).select("node")
    able = in_mixed(member.join(able, "node"))
    main = checkpoint(able.groupBy("key", "comp").agg(F.count("*").alias("m"), F.max("parts").alias("parts")).groupBy("key").agg(F.max_by("comp", "m").alias("hub"), F.max("parts").alias("parts")))
    able = able.join(salted(main), ["key", "salt"])
    odd = checkpoint(able.where(F.col("comp") != F.col("hub")).select("hub", "node", "comp").distinct())
    hubs = odd.select("hub").distinct()
    inner = able.select(F.col("comp").alias("hub"), "node", "comp").distinct().join(hubs, "hub", "left_semi")
    every = checkpoint(inner.unionByName(odd).distinct())
    blocks = lambda df, name: df.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    cut = checkpoint(blocks(odd, "nu").join(blocks(every, "nv"), "hub"))
    blobs = sets.select("node", "shingles")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    repeat = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = odd.join(cut, "hub").join(blobs, "node").select("hub", "node", "comp", "shingles", deal("nu").alias("ub"), repeat("nv").alias("vb"))
    right = every.join(cut, "hub").join(blobs, "node").select("hub", "node", "comp", "shingles", deal("nv").alias("vb"), repeat("nu").alias("ub"))
    right = right.select(F.col("hub").alias("h"), F.col("ub").alias("i"), F.col("vb").alias("j"), F.col("node").alias("v"), F.col("comp").alias("cv"), F.col("shingles").alias("sv"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        u = v = np.zeros(0, np.int64)
        if len(a) and len(b):
            x, y = ([np.frombuffer(z.as_py(), "<u4") for z in t[c]] for t, c in ((a, "shingles"), (b, "sv")))
            both = common(x, y)
            union = np.array([len(z) for z in x])[:, None] + np.array([len(z) for z in y])[None, :] - both
            linked = (both >= similarity * union - 1e-6) & (a["comp"].to_numpy()[:, None] != b["cv"].to_numpy()[None, :])
            i, j = np.nonzero(linked)
            u, v = a["node"].to_numpy()[i], b["v"].to_numpy()[j]
        return pa.table({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    return left.groupBy("hub", "ub", "vb").cogroup(right.groupBy("h", "i", "j")).applyInArrow(meet, "a long, b long").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """doc_id, t (xxhash64 of the text), class_id, class_t of every row of docs: the class is named by its row of the smallest doc_id, then t.

    Classes are the connected components of documents whose sets of word shingles have a Jaccard
    similarity of at least `similarity`; weighted: shingles weigh as often as they stand in a document
    (sum of lesser counts over sum of greater ones), both in the darts' regions and in the exact check.
    Equal shingle sets are one node, so copies cost nothing more. Rows without a word (null or blank
    text) are a class of their own each, named by their doc_id; a class in which no row has an id is
    named null. Repeated rows fall in one class. Texts count whole at any length. An empty table gives no row.
    Other columns are ignored.

    No bucket's pairs are listed. First every bucket's leader, the member with the fullest buckets
    (of a text's variants that is mostly the original), is compared with the others; then the leader
    of those that it didn't reach; last, pairs of what are still different components of a bucket,
    as far as their unshared shingles leave them a chance. So every pair that shares a bucket is
    either compared, linked already, or shown to be too different. A bucket of more than SALT_ROWS
    members meets its leader in as many parts as it needs.
    """
    s = checkpoint(sketch(docs, bands, rows, size, weighted))
    nodes = checkpoint(s.where(F.col("n1").isNotNull()).groupBy("n1", "n2").agg(F.min("rid").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first"), F.count("*").alias("copies")))
    bucket = s.select("rid", "bands").join(nodes.select(F.col("node").alias("rid")), "rid").select(F.col("rid").alias("node"), F.explode("bands").alias("key"))
    shared = checkpoint(bucket.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    parts = F.ceil(F.col("m") / SALT_ROWS).cast("int")
    member = checkpoint(bucket.join(shared, "key").select("key", "node", "m", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("salt")))
    fullness = checkpoint(member.groupBy("node").agg((F.sum("m") * 1024 + F.pmod(F.xxhash64("node"), F.lit(1024))).alias("rank")))
    member = checkpoint(member.join(fullness, "node").select("key", "parts", "salt", "node", "rank"))
    small = broadcast_if(fullness.select(F.col("node").alias("rid")), NODES_TO_BROADCAST)
    sets = checkpoint(s.select("rid", "n", "shingles").join(small, "rid").withColumnRenamed("rid", "node"))
    labels = checkpoint(fullness.select("node", F.col("node").alias("comp")))
    leader = [F.max_by("node", "rank").alias("lead"), F.max_by("comp", "rank").alias("own"), F.max("parts").alias("parts")]
    for turn in range(2):
        now = in_mixed(member.join(labels, "node"), 2 + turn)
        lead = now.groupBy("key").agg(*leader)
        if turn:  # the leader of those that the first one didn't reach
            top = checkpoint(lead.select("key", "parts", F.col("own").alias("top")))
            lead = now.join(salted(top), ["key", "salt"]).where(F.col("comp") != F.col("top")).groupBy("key").agg(*leader)
        pairs = checkpoint(star_pairs(now, checkpoint(lead)))
        labels = merge(labels, checkpoint(verify(pairs, sets, similarity)))
    now = in_mixed(member.join(labels, "node"), 3)
    labels = merge(labels, checkpoint(leftover_links(now, sets, similarity)))
    named = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = checkpoint(named)
    lowest = checkpoint(named.groupBy("comp").agg(F.min("first").alias("least")))
    named = checkpoint(named.join(lowest, "comp").select("n1", "n2", F.col("least.doc_id").alias("class_id"), F.col("least.t").alias("class_t"), F.lit(True).alias("in")))
    own = lambda name, other: F.when(F.col("in"), F.col(name)).otherwise(F.col(other)).alias(name)
    return s.select("doc_id", "t", "n1", "n2").join(named, ["n1", "n2"], "left").select("doc_id", "t", own("class_id", "doc_id"), own("class_t", "t"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: that of the smallest doc_id, then of the smallest text hash; all columns stay.

    A document without doc_id stays only where no row of its class has one. Of exactly repeated
    (doc_id, text), null ids and null texts too, one row stays. An empty table gives an empty one.
    """
    found = checkpoint(classes(docs))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("t") == F.col("class_t"))
    own, mark = unused(docs, "__id__"), unused(docs, "__t__")
    lost = found.where(~stays).select(F.col("doc_id").alias(own), F.col("t").alias(mark)).distinct()
    lost = broadcast_if(checkpoint(lost), NODES_TO_BROADCAST)
    out = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark)), "left_anti")
    if not found.where(stays).groupBy("doc_id", "t").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole table `documents`: each document's class."""
    docs = columns_first(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return classes(docs).select("doc_id", "class_id")
