"""Profile scores in numpy: a sequence as a hidden Markov model of match, insert and delete states, met by many sequences side by side.

Each query is a profile of its own: a match state for each base, which emits that base or, by error, another; insert
states emit anything; delete states skip a base of the query. The forward algorithm sums over all local alignments, the Viterbi
algorithm finds the likeliest one. Each step works on one anti-diagonal of all pairs of a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import PROFILE, Profile
from .align import CELLS, _codes

SCHEMA = "bits double, query_start int, query_end int, ref_start int, ref_end int"
NONE = -np.inf


def _batches(queries: list[str], refs: list[str]):
    """Index lists of pairs of similar size whose diagonals hold at most CELLS / 64 states."""
    order = sorted(range(len(queries)), key=lambda x: (len(queries[x]), len(refs[x])))
    at = 0
    while at < len(order):
        stop, wide = at, 0
        while stop < len(order) and (stop == at or max(wide, len(queries[order[stop]])) * (stop - at + 1) <= CELLS // 64):
            wide = max(wide, len(queries[order[stop]]))
            stop += 1
        yield order[at:stop]
        at = stop


def _score(queries: list[str], refs: list[str], p: Profile) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(forward bits; query start and end, ref start and end of the likeliest alignment) of one batch."""
    n, m, k = max(map(len, queries)), max(map(len, refs)), len(queries)
    q, r = _codes(queries, n), _codes(refs, m)
    rows, cols = np.array([len(x) for x in queries]), np.array([len(x) for x in refs])
    same, other = np.log2(4 * p.identity), np.log2(4 * (1 - p.identity) / 3)
    go, opens, more, back = np.log2([1 - 2 * p.gap_open, p.gap_open, p.gap_extend, 1 - p.gap_extend])
    blank = lambda: np.full((k, n + 1), NONE)
    # sums and best scores of the match, insert and delete states on the last two diagonals, by query position; from: where the best began
    sums = [[blank() for _ in range(3)] for _ in range(2)]
    best = [[blank() for _ in range(3)] for _ in range(2)]
    came = [[np.zeros((k, n + 1), np.int64) for _ in range(3)] for _ in range(2)]
    total, top = np.full(k, NONE), np.full(k, NONE)
    first, end = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        new_sum, new_best, new_came = [blank() for _ in range(3)], [blank() for _ in range(3)], [np.zeros((k, n + 1), np.int64) for _ in range(3)]
        a, b = q[:, i - 1], r[:, j - 1]
        emit = np.where((a == ord("N")) | (b == ord("N")), 0.0, np.where(a == b, same, other))
        emit = np.where((i[None, :] <= rows[:, None]) & (j[None, :] <= cols[:, None]), emit, NONE)
        here = np.broadcast_to(i * (m + 1) + j, emit.shape)
        # match: begins here, or follows a match, an insertion or a deletion
        steps = (go, back, back)
        new_sum[0][:, i] = emit + np.logaddexp2.reduce([np.zeros_like(emit)] + [sums[0][s][:, i - 1] + t for s, t in enumerate(steps)])
        ways = np.stack([np.zeros_like(emit)] + [best[0][s][:, i - 1] + t for s, t in enumerate(steps)])
        way = ways.argmax(0)[None]
        new_best[0][:, i] = emit + np.take_along_axis(ways, way, 0)[0]
        new_came[0][:, i] = np.take_along_axis(np.stack([here] + [came[0][s][:, i - 1] for s in range(3)]), way, 0)[0]
        # insert: another base of ref; delete: a base of the query skipped
        for s, at in ((1, i), (2, i - 1)):
            new_sum[s][:, i] = np.logaddexp2(sums[1][0][:, at] + opens, sums[1][s][:, at] + more)
            start, go_on = best[1][0][:, at] + opens, best[1][s][:, at] + more
            new_best[s][:, i] = np.maximum(start, go_on)
            new_came[s][:, i] = np.where(start >= go_on, came[1][0][:, at], came[1][s][:, at])
        total = np.logaddexp2(total, np.logaddexp2.reduce(new_sum[0], axis=1))
        peak = new_best[0].argmax(1)
        value = new_best[0][np.arange(k), peak]
        better = value > top
        top = np.where(better, value, top)
        first = np.where(better, new_came[0][np.arange(k), peak], first)
        end = np.where(better, peak * (m + 1) + d - peak, end)
        sums, best, came = [sums[1], new_sum], [best[1], new_best], [came[1], new_came]
    bits = total - np.log2(np.maximum(rows * cols, 1))
    return bits, first // (m + 1) - 1, end // (m + 1) - 1, first % (m + 1) - 1, end % (m + 1) - 1


def profile_scores(queries: list[str], refs: list[str], p: Profile = PROFILE) -> list[tuple]:
    """(bits, query_start, query_end, ref_start, ref_end) of each pair, 0-based inclusive ends; no bits for an empty side.

    bits: log2 of the mean, over all places of query and ref, of the odds that an alignment begins there against
    chance; an N is neutral. The ends are those of the likeliest alignment, the first one in reading order of its end.
    """
    out: list[tuple] = [(None, -1, -1, -1, -1)] * len(queries)
    full = [x for x in range(len(queries)) if queries[x] and refs[x]]
    for batch in _batches([queries[x] for x in full], [refs[x] for x in full]):
        own = [full[x] for x in batch]
        bits, *ends = _score([queries[x] for x in own], [refs[x] for x in own], p)
        for y, x in enumerate(own):
            out[x] = (float(bits[y]), *(int(e[y]) for e in ends))
    return out


def profile(pairs: DataFrame, query: str, ref: str, p: Profile = PROFILE) -> DataFrame:
    """pairs with the fields of SCHEMA; equal pairs are scored once a batch. Null sides have no bits."""

    def run(batches):
        for pdf in batches:
            q, r = pdf[query].fillna("").tolist(), pdf[ref].fillna("").tolist()
            distinct = list(dict.fromkeys(zip(q, r, strict=True)))
            found = dict(zip(distinct, profile_scores([a for a, _ in distinct], [b for _, b in distinct], p), strict=True))
            rows = pd.DataFrame([found[x] for x in zip(q, r, strict=True)], columns=["bits", "query_start", "query_end", "ref_start", "ref_end"])
            yield pd.concat([pdf.reset_index(drop=True), rows], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", " + SCHEMA
    return pairs.mapInPandas(run, schema)
