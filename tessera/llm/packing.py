"""Best-fit packing of token sequences by length patterns.

The lengths' histogram (at most max_len bins) goes to the driver. Patterns of one to three
documents that fill a sequence exactly are enumerated; non-negative least squares fits their
repeat counts to the histogram, the counts are rounded down, and what is left over is packed
best-fit decreasing on the histogram. The plan (patterns x repeats) does not depend on the number
of documents; each piece finds its place from its number among pieces of its length.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, chunks, columns_first

MAX_LEN = 1024
END_ID = 2


@functools.lru_cache(maxsize=4)
def same_merges(json_path: str, rank_path: str) -> bool:
    """Whether merging by the ranks of a .tiktoken file gives the ids of the tokenizer in json_path on every text.

    It does if the token of each rank, merged from its bytes by lower ranks alone, ends as the pair that
    the tokenizer lists for it. For then no other pair of neighbours can become that token: what has
    happened inside its bytes before its rank, in any text, is what happens to these bytes alone.
    Both sides must cut text alike, too: byte level by the same pattern, nothing else.
    """
    with open(json_path, encoding="utf-8") as f:
        own = json.load(f)
    model, cutter = own["model"], own.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not own.get("normalizer")
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return False
    ranks = read_ranks(rank_path)
    token = {i: t for t, i in ranks.items()}
    letter = {c: token[i] for c, i in model["vocab"].items() if len(c) == 1 and len(token.get(i, b"")) == 1}
    if len(letter) != 256 or any(b"".join(letter[c] for c in t) != token.get(i) for t, i in model["vocab"].items()):
        return False
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    listed = {model["vocab"][a + b]: (model["vocab"][a], model["vocab"][b]) for a, b in pairs}
    if sorted(listed) != [model["vocab"][a + b] for a, b in pairs] or len(listed) + 256 != len(ranks):
        return False
    return all(last_pair(token[i], i, ranks) == pair for i, pair in listed.items())


def last_pair(text: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """What bytes have become when all ranks below `rank` have merged, leftmost first."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 2:
        least, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if least >= rank:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids as tokenizers' Tokenizer.encode(text, add_special_tokens=False) gives them.

    With rank_path (which same_merges must allow) tiktoken merges by the same ranks, several times
    faster; a text that holds the string of an added token, which tokenizers maps to its own id, goes
    through tokenizers itself.
    """

    def __init__(self, json_path: str, rank_path: str | None, added: list[str]):
        self.json_path, self.added, self.fast = json_path, added, None
        if rank_path:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(rank_path), special_tokens={})

    @functools.cached_property
    def exact(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(str(self.json_path))

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is None or any(t in text for t in self.added):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n % max_len or max_len
    return [(0, first)] + [(s, max_len) for s in range(first, n, max_len)]


def patterns(present: np.ndarray, max_len: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of present lengths that sum to max_len; 0 is no document."""
    has = np.zeros(max_len + 1, bool)
    has[present] = True
    a, b = np.meshgrid(present, present, indexing="ij")
    two = (a >= b) & (a + b == max_len)
    three = (a >= b) & (a + b < max_len) & (max_len - a - b <= b)
    three[three] = has[max_len - a[three] - b[three]]
    rows = [np.column_stack([a[two], b[two], np.zeros(two.sum(), np.int64)]), np.column_stack([a[three], b[three], max_len - a[three] - b[three]])]
    return np.concatenate(rows).astype(np.int64)


def nnls(rows: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 minimising |A x - target|^2, by accelerated projected gradient; A counts lengths in patterns."""
    size = len(target)

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for c in range(3):
            out += np.bincount(rows[:, c], weights=x, minlength=size)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.02 * np.linalg.norm(back(forward(v))) + 1e-12)
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(forward(z) - target))
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / grown * (new - x)
        x, t = new, grown
    return x


def best_fit(histogram: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths, repeats); groups of equal sequences move together."""
    room: list[int] = []  # sorted spaces that are open
    groups: dict[int, list[list]] = {}
    done = []
    for length in range(max_len, 0, -1):
        left = int(histogram[length])
        while left:
            i = bisect_left(room, length)
            if i < len(room):
                space = room[i]
                lengths, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    room.pop(i)
                put = min(n, left)
                if put < n:
                    if space not in groups:
                        insort(room, space)
                    groups.setdefault(space, []).append([lengths, n - put])
            else:
                space, lengths, put = max_len, (), left
            left -= put
            rest, lengths = space - length, (*lengths, length)
            if rest == 0:
                done.append((lengths, put))
            else:
                if rest not in groups:
                    insort(room, rest)
                groups.setdefault(rest, []).append([lengths, put])
    return done + [(g[0], g[1]) for x in groups.values() for g in x]


def use_patterns(rows: np.ndarray, fitted: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their repeats rounded down, as far as `left` (changed here) has their lengths."""
    out = []
    repeats = np.floor(fitted + 1e-9).astype(np.int64)
    for i in np.argsort(-fitted, kind="stable"):
        if repeats[i] < 1:
            break
        lengths = [int(v) for v in rows[i] if v]
        n = min(int(repeats[i]), *(int(left[v]) // lengths.count(v) for v in lengths))
        if n > 0:
            for v in lengths:
                left[v] -= n
            out.append((tuple(lengths), n))
    return out


def plan(histogram: np.ndarray, max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up the histogram (index: length).

    Where most documents are so short that a sequence takes many of them, few-document patterns
    would use up the fillers that the rest needs; so the fitted counts are also tried damped, and
    the plan of fewest sequences is taken.
    """
    start = histogram.astype(np.int64).copy()
    full = [((max_len,), int(start[max_len]))] if start[max_len] else []
    start[max_len] = 0
    present = np.flatnonzero(start)
    rows = patterns(present, max_len) if len(present) else np.zeros((0, 3), np.int64)
    fitted = nnls(rows, start.astype(float)) if len(rows) else np.zeros(0)
    best: list[tuple[tuple[int, ...], int]] | None = None
    for share in (1.0, 0.9, 0.75, 0.5, 0.25):
        left = start.copy()
        tried = use_patterns(rows, fitted * share, left)
        tried += best_fit(left, max_len)
        if best is None or sum(n for _, n in tried) < sum(n for _, n in best):
            best = tried
    return full + (best or [])


def slots(plan_: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each length, where its pieces by number go: sorted arrays length, first number, first sequence, offset."""
    rows, used, base = [], {}, 0
    for lengths, n in plan_:
        offset = 0
        for length in lengths:
            at = used.get(length, 0)
            rows.append((length, at, base, offset))
            used[length] = at + n
            offset += length
        base += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pieces(docs: DataFrame, json_path: str, rank_path: str | None, max_len: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row; null text is empty (the end id alone)."""
    bounded_batches(docs.sparkSession)
    with open(json_path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    rank_path = rank_path if rank_path and same_merges(json_path, rank_path) else None

    def run(batches):
        encode = Encoder(json_path, rank_path, added)
        for b in chunks(batches, "text", 1 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.array([*encode(text), end_id], "<u4")
                for p, (s, n) in enumerate(cut(len(ids), max_len)):
                    row.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n]))
            yield pa.RecordBatch.from_arrays([pc.take(b.column("doc_id"), pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, json_path: str | None = None, rank_path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed, null or repeated ids too; null text is the end id alone; no rows give no
    piece. Texts count whole at any length; only documents of more than max_len ids are cut. Other
    columns are ignored.
    """
    if json_path is None:
        json_path, rank_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    cutted = checkpoint(pieces(docs, str(json_path), rank_path and str(rank_path), max_len, end_id).withColumn("slice", deal))
    counts = checkpoint(cutted.groupBy("length", "slice").agg(F.count("*").alias("n")))
    histogram = np.zeros(max_len + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most max_len rows
        histogram[length] = n
    table = spark.sparkContext.broadcast(slots(plan(histogram, max_len)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    numbered = cutted.withColumn("number", F.row_number().over(own) - 1).join(counts, ["length", "slice"]).withColumn("number", F.col("number") + F.col("before"))

    def place(batches):
        length, first, sequence, offset = table.value
        key = length << 44 | first
        for b in batches:
            n, number = (np.asarray(b.column(c)).astype(np.int64) for c in ("length", "number"))
            i = np.searchsorted(key, n << 44 | number, side="right") - 1
            cols = {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(sequence[i] + number - first[i]), "offset": pa.array(offset[i])})

    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("number").cast("long").alias("number"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, in sequences of at most 1024 tokens."""
    return pack(columns_first(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
