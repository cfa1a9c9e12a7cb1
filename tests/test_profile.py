"""Profile scores in batches against the same sums and maxima taken cell by cell."""

import math
import random

import pytest

from tessera.config import Profile
from tessera.operators.profile import profile, profile_scores


def by_cells(query, ref, p):
    n, m = len(query), len(ref)
    emit = lambda a, b: 1.0 if "N" in (a, b) else 4 * p.identity if a == b else 4 * (1 - p.identity) / 3
    go, back = 1 - 2 * p.gap_open, 1 - p.gap_extend
    zero = lambda: [[0.0] * (m + 1) for _ in range(n + 1)]
    (fm, fi, fd), (vm, vi, vd) = [zero() for _ in range(3)], [zero() for _ in range(3)]
    sm, si, sd = ([[None] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    total, top = 0.0, (0.0, None, None)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e = emit(query[i - 1], ref[j - 1])
            fm[i][j] = e * (1 + fm[i - 1][j - 1] * go + fi[i - 1][j - 1] * back + fd[i - 1][j - 1] * back)
            fi[i][j] = fm[i][j - 1] * p.gap_open + fi[i][j - 1] * p.gap_extend
            fd[i][j] = fm[i - 1][j] * p.gap_open + fd[i - 1][j] * p.gap_extend
            total += fm[i][j]
            ways = [(1.0, (i, j)), (vm[i - 1][j - 1] * go, sm[i - 1][j - 1]), (vi[i - 1][j - 1] * back, si[i - 1][j - 1]), (vd[i - 1][j - 1] * back, sd[i - 1][j - 1])]
            best = max(ways, key=lambda w: w[0])
            vm[i][j], sm[i][j] = e * best[0], best[1]
            vi[i][j], si[i][j] = max((vm[i][j - 1] * p.gap_open, sm[i][j - 1]), (vi[i][j - 1] * p.gap_extend, si[i][j - 1]), key=lambda w: w[0])
            vd[i][j], sd[i][j] = max((vm[i - 1][j] * p.gap_open, sm[i - 1][j]), (vd[i - 1][j] * p.gap_extend, sd[i - 1][j]), key=lambda w: w[0])
            if vm[i][j] > top[0] * (1 + 1e-9):
                top = (vm[i][j], sm[i][j], (i, j))
    return math.log2(total / (n * m)), top


def likelihood(query, ref, start, end, p):
    """The odds of the likeliest alignment between those ends."""
    (i0, j0), (i1, j1) = start, end
    return by_cells(query[i0 - 1 : i1], ref[j0 - 1 : j1], p)[1][0]


@pytest.mark.parametrize("p", [Profile(), Profile(identity=0.7, gap_open=0.1, gap_extend=0.5)])
def test_batches_match_cells(p):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ACGTN" if r.random() < 0.1 else "ACGT") for _ in range(n))
    pairs = [(word(r.randrange(1, 25)), word(r.randrange(1, 40))) for _ in range(60)]
    for _ in range(40):
        a = word(30)
        b = list(a)
        for _ in range(r.randrange(4)):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice([[], [b[k], "G"], ["T"]])
        pairs.append((a, word(5) + "".join(b) + word(5)))
    got = profile_scores([a for a, _ in pairs], [b for _, b in pairs], p)
    for (a, b), (bits, q0, q1, r0, r1) in zip(pairs, got, strict=True):
        want, (odds, *_) = by_cells(a, b, p)
        assert bits == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert likelihood(a, b, (q0 + 1, r0 + 1), (q1 + 1, r1 + 1), p) == pytest.approx(odds, rel=1e-9)  # as likely as the likeliest


def test_long_and_empty_sequences():
    long = "ACGTTGCA" * 200
    (bits, q0, q1, r0, r1), none = profile_scores([long, ""], ["T" + long, "ACGT"])
    assert bits > 2000 and (q0, q1, r0, r1) == (0, 1599, 1, 1600) and none[0] is None


def test_rows(spark):
    rows = [("ACGTACGTAA", "TTACGTACGTAATT", 1), (None, "ACGT", 2), ("ACGTACGTAA", "TTACGTACGTAATT", 3), ("", "", 4)]
    got = {x.k: x for x in profile(spark.createDataFrame(rows, "q string, r string, k int"), "q", "r").collect()}
    assert got[1].bits == got[3].bits > 3 and got[1].ref_start == 2 and got[1].ref_end == 11 and got[2].bits is None and got[4].bits is None
