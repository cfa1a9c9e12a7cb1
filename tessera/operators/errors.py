"""Errors of alignments near their junctions and elsewhere, for whole batches in numpy.

Every operation of every CIGAR is a row of arrays: its read, its exon, its place in the exon and in the
read. Insertions and deletions count by interval arithmetic on these; only aligned bases are compared
one by one, all of a slice at once, and only those that differ go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.cigar import tokens

ERRORS = "struct<sj_errors:array<struct<ins:int,del:int,sub:int>>,background:struct<ins:int,del:int,sub:int,total:int>>"
BASES = 1 << 22  # compared at once


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(upper-case bytes, offsets) of strings; null is empty."""
    text = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]].copy() if data is not None else np.zeros(0, np.uint8)
    raw[(raw >= 97) & (raw <= 122)] -= 32
    return raw, off - off[0]


def _slice(cigars: pa.Array, bases: pa.Array, exons: pa.ListArray, flank: int, max_deletion: int) -> tuple[np.ndarray, ...]:
    """(number of junctions of each read, errors by junction (3 columns), background by read (4 columns))."""
    n = len(cigars)
    row, size, kind = tokens(cigars)
    of = lambda ops: np.isin(kind, np.frombuffer(ops, np.uint8))
    intron = of(b"N") | (of(b"D") & (size > max_deletion))
    deleted, inserted, aligned, consumes = of(b"D") & ~intron, of(b"I"), of(b"M=X"), of(b"M=XSI")
    on_genome = aligned | deleted
    held = np.diff(np.asarray(exons.offsets)) if n else np.zeros(0, np.int64)
    held = np.where(np.asarray(pc.is_valid(exons)), held, 0)
    introns = np.bincount(row[intron], minlength=n)
    known = held == introns + 1  # the reference of every exon is there
    first = np.searchsorted(row, row)

    def before(x: np.ndarray) -> np.ndarray:
        """Sum of x over earlier operations of the read."""
        sums = np.cumsum(x) - x
        return sums - sums[first] if len(sums) else sums

    place = before(intron.astype(np.int64))
    ebase = np.concatenate([[0], np.cumsum(introns + 1)])
    exon = ebase[row] + place
    genome = np.where(on_genome, size, 0)
    length = np.bincount(exon, weights=genome, minlength=ebase[-1]).astype(np.int64)
    sums = np.cumsum(genome) - genome
    at = sums - sums[np.searchsorted(exon, exon)] if len(sums) else sums  # an intron stands at its exon's end, so exons are in order
    at_read = before(np.where(consumes, size, 0))
    seq, seq_off = _bytes(bases)
    complete = np.diff(seq_off) == np.bincount(row[consumes], weights=size[consumes], minlength=n).astype(np.int64)
    flat = exons.flatten() if n else pa.array([], pa.string())
    ref, ref_off = _bytes(flat)
    ref_base = np.concatenate([[0], np.cumsum(held)])[:-1]
    last = exon == ebase[row + 1] - 1

    jbase = np.concatenate([[0], np.cumsum(np.where(known, introns, 0))])
    out, back = np.zeros((jbase[-1], 3), np.int64), np.zeros((n, 4), np.int64)

    def near(column: int, r: np.ndarray, e: np.ndarray, is_last: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Add left to the junction after exon e (of read r) and right to the one before it."""
        j = jbase[r] + e - ebase[r]
        for count, ok, at_ in ((left, ~is_last, j), (right, e > ebase[r], j - 1)):
            use = ok & known[r] & (count > 0)
            np.add.at(out[:, column], at_[use], count[use])

    def elsewhere(column: int, r: np.ndarray, count: np.ndarray) -> None:
        use = known[r]
        back[:, column] += np.bincount(r[use], weights=count[use], minlength=n).astype(np.int64)

    ins = np.flatnonzero(inserted)
    r, e, p, k, size_ = row[ins], exon[ins], at[ins], size[ins], length[exon[ins]]
    near(0, r, e, last[ins], np.where(size_ - p < flank, k, 0), np.where(p < flank, k, 0))
    inner = np.where((p > flank) & (size_ - p > flank), k, 0)
    elsewhere(0, r, inner)
    elsewhere(3, r, inner)
    gone = np.flatnonzero(deleted)
    r, e, p, k, size_ = row[gone], exon[gone], at[gone], size[gone], length[exon[gone]]
    overlap = lambda a, b: np.maximum(0, np.minimum(p + k, b) - np.maximum(p, a))
    near(1, r, e, last[gone], overlap(np.maximum(size_ - flank, 0), size_), overlap(0, np.minimum(flank, size_)))
    inner = np.where((p > flank) & (size_ - p - k > flank), k, 0)
    elsewhere(1, r, inner)
    elsewhere(3, r, inner - overlap(flank, np.maximum(size_ - flank, flank)))
    owner = np.repeat(np.arange(n), introns + 1)
    elsewhere(3, owner, np.maximum(length - 2 * flank, 0))

    ops = np.flatnonzero(aligned & known[row] & complete[row])
    ends = np.cumsum(size[ops])
    done = 0
    while done < len(ops):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BASES, side="right")))
        o = ops[done:stop]
        done = stop
        i = np.repeat(o, size[o])
        nth = np.arange(len(i)) - np.repeat(np.cumsum(size[o]) - size[o], size[o])
        p = at[i] + nth
        k = ref_base[row[i]] + place[i]
        there = p < ref_off[k + 1] - ref_off[k]
        i, nth, p, k = i[there], nth[there], p[there], k[there]
        wrong = seq[seq_off[row[i]] + at_read[i] + nth] != ref[ref_off[k] + p]
        i, p = i[wrong], p[wrong]
        r, e, size_ = row[i], exon[i], length[exon[i]]
        near(2, r, e, last[i], (p >= size_ - flank).astype(np.int64), (p < flank).astype(np.int64))
        elsewhere(2, r, ((p >= flank) & (p < np.maximum(size_ - flank, flank))).astype(np.int64))
    return np.diff(jbase), out, back


def errors(cigars: pa.Array, bases: pa.Array, exons: pa.ListArray, flank: int, max_deletion: int) -> pa.StructArray:
    """ERRORS of each alignment: (insertions, deletions, substitutions) within `flank` genome bases on either side of each junction, and elsewhere.

    exons: reference bases of each exon; where they or a part of them are missing there is no junction
    and the background is 0. Reads whose bases don't have the CIGAR's length have no substitutions.
    """
    if isinstance(exons, pa.ChunkedArray):
        exons = exons.combine_chunks()
    got = []
    step = 4096
    for a in range(0, len(cigars), step):
        got.append(_slice(cigars.slice(a, step), bases.slice(a, step), pa.concat_arrays([exons.slice(a, step)]), flank, max_deletion))
    counts, out, back = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros((0, 3), np.int64), np.zeros((0, 4), np.int64))
    ints = lambda x: pa.array(x.astype(np.int32))
    near = pa.StructArray.from_arrays([ints(out[:, c]) for c in range(3)], ["ins", "del", "sub"])
    lists = pa.ListArray.from_arrays(ints(np.concatenate([[0], np.cumsum(counts)])), near)
    return pa.StructArray.from_arrays([lists, pa.StructArray.from_arrays([ints(back[:, c]) for c in range(4)], ["ins", "del", "sub", "total"])], ["sj_errors", "background"])
