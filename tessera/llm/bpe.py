"""Byte-level BPE encoding and decoding in padded numpy matrices.

Distinct pre-tokens of about one length form the rows of a matrix of token ids. In each round
every row merges its leftmost pair of minimum rank, found through a hashed pair table; rows with
no pair left leave the matrix (compaction). A long pre-token is a matrix of one row, in which a
round merges all places of the minimum-rank pair, from the left, where that can't open a pair of a
lower rank: it takes a round for each rank that occurs, not for each merge. Pre-tokens seen lately
are kept in a bounded cache.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, columns_first

NONE = np.int32(2**31 - 1)
BITS = 20
#: Pre-tokens longer than this many bytes are alone in their matrix.
MATRIX_BYTES = 256
CACHE = 250_000


class Vocabulary:
    """Ranks of a .tiktoken file; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        left, right, merged = np.array(pairs, np.int64).T
        self.keys = np.full(1 << BITS, -1, np.int64)
        self.merged = np.full(1 << BITS, NONE, np.int32)
        key = left << 20 | right
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            put, first = np.unique(slot[free], return_index=True)
            self.keys[put] = key[free][first]
            self.merged[put] = merged[free][first]
            left_over = self.keys[slot] != key
            key, merged, slot = key[left_over], merged[left_over], (slot[left_over] + 1) & ((1 << BITS) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (= id) of the merge of tokens a and b, NONE where there is none; -1 pads."""
        key = a.astype(np.int64) << 20 | b.astype(np.int64)
        key = np.where((a < 0) | (b < 0), -2, key)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.merged[slot], NONE)
        look = np.flatnonzero((self.keys[slot].ravel() != key.ravel()) & (self.keys[slot].ravel() >= 0) & (key.ravel() >= 0))
        flat, key, slot = out.reshape(-1), key.ravel(), slot.ravel()
        at = slot[look]
        while len(look):
            at = (at + 1) & ((1 << BITS) - 1)
            seen = self.keys[at]
            hit = seen == key[look]
            flat[look[hit]] = self.merged[at[hit]]
            go = ~hit & (seen >= 0)
            look, at = look[go], at[go]
        return flat.reshape(out.shape)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token; one that is itself a token stays whole."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ids.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > MATRIX_BYTES:
                out[i] = self._row(p)
            else:
                buckets.setdefault(len(p) if len(p) <= 16 else -(-len(p) // 8) * 8 if len(p) <= 128 else -(-len(p) // 128) * 128, []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(rows), step):
                self._matrix(pieces, rows[at : at + step], width, out)
        return out

    def _matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list[list[int]]) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        length = np.array([len(pieces[i]) for i in rows])
        token = np.where(np.arange(width) < length[:, None], self.single[raw], -1).astype(np.int32)
        rank = self.pair(token[:, :-1], token[:, 1:])
        own = np.array(rows)
        while len(own):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(own), int)
            line = np.arange(len(own))
            least = rank[line, at] if rank.shape[1] else np.full(len(own), NONE)
            done = least == NONE
            if done.any():
                for i, t, n in zip(own[done].tolist(), token[done].tolist(), (token[done] >= 0).sum(axis=1).tolist(), strict=True):
                    out[i] = t[:n]
                stay = ~done
                own, token, rank, at, least = own[stay], token[stay], rank[stay], at[stay], least[stay]
                line = np.arange(len(own))
                if not len(own):
                    return
            token[line, at] = least
            column = np.arange(token.shape[1] - 1)
            token = np.take_along_axis(token, column + (column > at[:, None]), axis=1)
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), axis=1) if len(column) else rank[:, :0]
            if rank.shape[1]:
                left = at > 0
                rank[line[left], at[left] - 1] = self.pair(token[line[left], at[left] - 1], token[line[left], at[left]])
                right = at < rank.shape[1]
                rank[line[right], at[right]] = self.pair(token[line[right], at[right]], token[line[right], at[right] + 1])

    def _row(self, piece: bytes) -> list[int]:
        token = self.single[np.frombuffer(piece, np.uint8)]
        rank = self.pair(token[:-1], token[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            fresh = np.diff(at, prepend=-2) != 1  # of pairs that overlap (a run of one token) every second merges
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            before, after = np.where(at > 0, token[at - 1], -1), np.where(at + 2 < len(token), token[np.minimum(at + 2, len(token) - 1)], -1)
            before[1:][at[1:] - 2 == at[:-1]] = least
            merged = np.full(len(at), least, np.int32)
            if len(at) > 1 and min(self.pair(before, merged).min(), self.pair(merged, after).min()) < least:
                at = at[:1]
            token[at] = least
            token = np.delete(token, at + 1)
            rank = np.delete(rank, at)
            at = at - np.arange(len(at))
            left, right = at[at > 0] - 1, at[at < len(rank)]
            rank[left] = self.pair(token[left], token[left + 1])
            rank[right] = self.pair(token[right], token[right + 1])
        return token.tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Coder:
    """Texts to (number of ids, decimal ids joined by one space, decoded bytes)."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.split = vocabulary(path), regex.compile(pattern).findall
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def __call__(self, texts: list[str | None]):
        cut = [self.split(t) if t else [] for t in texts]
        new = list(set().union(*cut) - self.cache.keys())
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = list(set().union(*cut))
        for word, ids in zip(new, self.vocabulary.encode([w.encode() for w in new]), strict=True):
            self.cache[word] = (" ".join(map(str, ids)), len(ids), self.vocabulary.decode(ids))
        get = self.cache.__getitem__
        for words in cut:
            parts = [get(w) for w in words]
            yield sum([p[1] for p in parts]), " ".join([p[0] for p in parts]), b"".join([p[2] for p in parts])


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null text is empty (no ids).

    path: a .tiktoken file that every executor can read. Special tokens' strings are ordinary text.
    Repeated rows and null ids each give their own row; an empty table gives none; texts count whole at
    any length. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches):
        code = Coder(str(path), pattern)
        for b in chunks(batches, "text", 2 << 20):
            n, ids, back = zip(*((n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d).hexdigest()) for n, i, d in code(b.column("text").to_pylist())), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`."""
    return digests(columns_first(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
