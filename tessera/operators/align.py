"""Pairwise alignment in numpy: many pairs side by side, one anti-diagonal at a time.

Pairs of about one size are padded into a batch; each step of the dynamic programme works on a
whole anti-diagonal of all pairs. Affine gaps: gap_open is the cost of a gap's first base,
gap_extend of each further one. N scores 0 against anything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GLOBAL_SCORES, LOCAL_SCORES, Scores

LOW = -(1 << 28)
CELLS = 4 << 20

LOCAL_SCHEMA = "score int, query_start int, query_end int, ref_start int, ref_end int, cigar string"


def _codes(texts: list[str], width: int) -> np.ndarray:
    raw = "".join(t.ljust(width, "\0") for t in texts).encode("latin-1", "replace")
    return np.frombuffer(raw, np.uint8).reshape(len(texts), width)


def _fill(queries: list[str], refs: list[str], s: Scores, is_local: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores H of all cells, and the traceback bits: 1-2 how H came (0 stop, 1 diagonal, 2 deletion, 3 insertion), 4 deletion extends, 8 insertion extends."""
    n, m, k = max(map(len, queries)), max(map(len, refs)), len(queries)
    q, r = _codes(queries, n), _codes(refs, m)
    h = np.zeros((n + 1, m + 1, k), np.int32)
    way = np.zeros((n + 1, m + 1, k), np.uint8)
    del_ = np.full((n + 1, k), LOW, np.int32)  # best that ends in a ref base against nothing, by row
    ins = np.full((m + 1, k), LOW, np.int32)  # best that ends in a query base against nothing, by column
    if not is_local:
        for i in range(1, n + 1):
            h[i, 0], way[i, 0] = -(s.gap_open + (i - 1) * s.gap_extend), 3 | (8 if i > 1 else 0)
        for j in range(1, m + 1):
            h[0, j], way[0, j] = -(s.gap_open + (j - 1) * s.gap_extend), 2 | (4 if j > 1 else 0)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        a, b = q[:, i - 1].T, r[:, j - 1].T
        pair = np.where((a == ord("N")) | (b == ord("N")), 0, np.where(a == b, s.match, s.mismatch))
        diagonal = h[i - 1, j - 1] + pair
        open_del, more_del = h[i, j - 1] - s.gap_open, del_[i] - s.gap_extend
        open_ins, more_ins = h[i - 1, j] - s.gap_open, ins[j] - s.gap_extend
        new_del, new_ins = np.maximum(open_del, more_del), np.maximum(open_ins, more_ins)
        bits = np.where(more_del > open_del, 4, 0) | np.where(more_ins > open_ins, 8, 0)
        best = np.maximum(diagonal, np.maximum(new_del, new_ins))
        came = np.where(best == diagonal, 1, np.where(best == new_del, 2, 3))
        if is_local:
            came = np.where(best <= 0, 0, came)
            best = np.maximum(best, 0)
        del_[i], ins[j] = new_del, new_ins
        h[i, j], way[i, j] = best, came | bits
    return h, way, q, r


def _trace(way: np.ndarray, i: int, j: int, query: str, ref: str, is_local: bool) -> tuple[int, int, list[list]]:
    """Where the alignment that ends at (i, j) begins, and its operations: = match, X mismatch, D ref base only, I query base only."""
    ops: list[list] = []

    def add(op: str) -> None:
        if ops and ops[-1][1] == op:
            ops[-1][0] += 1
        else:
            ops.append([1, op])

    state = 0
    while i > 0 or j > 0:
        w = int(way[i, j])
        if state == 0:
            state = w & 3
            if state == 0:
                break
        if state == 1:
            add("=" if query[i - 1] == ref[j - 1] else "X")
            i, j, state = i - 1, j - 1, 0
        elif state == 2:
            add("D")
            state = 2 if w & 4 else 0
            j -= 1
        else:
            add("I")
            state = 3 if w & 8 else 0
            i -= 1
    ops.reverse()
    return i, j, ops


def _batches(queries: list[str], refs: list[str]):
    """Index lists of pairs of similar size, each batch of at most CELLS cells."""
    order = sorted(range(len(queries)), key=lambda x: (len(queries[x]), len(refs[x])))
    batch: list[int] = []
    for x in order:
        n = max((len(queries[y]) for y in (*batch[-1:], x)), default=0) + 1
        m = max([len(refs[y]) for y in batch] + [len(refs[x])]) + 1
        if batch and n * m * (len(batch) + 1) > CELLS:
            yield batch
            batch = []
        batch.append(x)
    if batch:
        yield batch


def local_alignments(queries: list[str], refs: list[str], s: Scores = LOCAL_SCORES) -> list[tuple]:
    """(score, query_start, query_end, ref_start, ref_end, cigar) of each pair, 0-based inclusive ends; score 0 and no cigar for no match."""
    out: list[tuple] = [(0, -1, -1, -1, -1, "")] * len(queries)
    full = [x for x in range(len(queries)) if queries[x] and refs[x]]
    for batch in _batches([queries[x] for x in full], [refs[x] for x in full]):
        own = [full[x] for x in batch]
        h, way, _, _ = _fill([queries[x] for x in own], [refs[x] for x in own], s, True)
        for p, x in enumerate(own):
            n, m = len(queries[x]), len(refs[x])
            part = h[: n + 1, : m + 1, p]
            top = int(part.max())
            if top <= 0:
                continue
            j, i = np.argwhere(part.T == top)[0]  # first in the reference, then in the query
            a, b, ops = _trace(way[:, :, p], int(i), int(j), queries[x], refs[x], True)
            out[x] = (top, a, int(i) - 1, b, int(j) - 1, "".join(f"{c}{o}" for c, o in ops))
    return out


def global_alignments(queries: list[str], refs: list[str], s: Scores = GLOBAL_SCORES) -> list[tuple[int, str]]:
    """(score, cigar with = X D I) of each pair end to end; an empty side is all gap."""
    out: list[tuple[int, str]] = [(0, "")] * len(queries)
    full = []
    for x, (a, b) in enumerate(zip(queries, refs, strict=True)):
        if a and b:
            full.append(x)
        elif a or b:
            k = len(a) + len(b)
            out[x] = (-(s.gap_open + (k - 1) * s.gap_extend), f"{k}{'I' if a else 'D'}")
    for batch in _batches([queries[x] for x in full], [refs[x] for x in full]):
        own = [full[x] for x in batch]
        h, way, _, _ = _fill([queries[x] for x in own], [refs[x] for x in own], s, False)
        for p, x in enumerate(own):
            n, m = len(queries[x]), len(refs[x])
            _, _, ops = _trace(way[:, :, p], n, m, queries[x], refs[x], False)
            out[x] = (int(h[n, m, p]), "".join(f"{c}{o}" for c, o in ops))
    return out


def windowed_global(query: str, ref: str, window: int = 2000, s: Scores = GLOBAL_SCORES) -> str:
    """CIGAR of a long pair, aligned window by window of the longer side so that memory stays bounded."""
    if max(len(query), len(ref)) <= window:
        return global_alignments([query], [ref], s)[0][1]
    parts = -(-max(len(query), len(ref)) // window)
    cut = lambda text, k: text[len(text) * k // parts : len(text) * (k + 1) // parts]
    out: list[list] = []
    for _, c in global_alignments([cut(query, k) for k in range(parts)], [cut(ref, k) for k in range(parts)], s):
        for n, op in _parse(c):
            if out and out[-1][1] == op:
                out[-1][0] += n
            else:
                out.append([n, op])
    return "".join(f"{n}{op}" for n, op in out)


def _parse(cigar: str) -> list[tuple[int, str]]:
    import re

    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def local(pairs: DataFrame, query: str, ref: str, s: Scores = LOCAL_SCORES) -> DataFrame:
    """pairs with the fields of LOCAL_SCHEMA; equal pairs are aligned once a batch. Null sides score 0."""
    def run(batches):
        for pdf in batches:
            q, r = pdf[query].fillna("").tolist(), pdf[ref].fillna("").tolist()
            distinct = list(dict.fromkeys(zip(q, r, strict=True)))
            found = dict(zip(distinct, local_alignments([a for a, _ in distinct], [b for _, b in distinct], s), strict=True))
            rows = pd.DataFrame([found[x] for x in zip(q, r, strict=True)], columns=["score", "query_start", "query_end", "ref_start", "ref_end", "cigar"])
            yield pd.concat([pdf.reset_index(drop=True), rows], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", " + LOCAL_SCHEMA
    return pairs.mapInPandas(run, schema)


def global_cigar(pairs: DataFrame, query: str, ref: str, into: str, window: int = 2000, s: Scores = GLOBAL_SCORES) -> DataFrame:
    """pairs with the end-to-end CIGAR of query against ref."""
    @F.pandas_udf("string")
    def run(q: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([windowed_global(a or "", b or "", window, s) for a, b in zip(q, r, strict=True)])

    return pairs.withColumn(into, run(F.col(query), F.col(ref)))
