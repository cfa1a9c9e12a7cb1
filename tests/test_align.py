import random

import pytest

from tessera.config import GLOBAL_SCORES, LOCAL_SCORES
from tessera.operators.align import global_alignments, local_alignments, windowed_global


def test_known_local_alignment():
    score, qs, qe, rs, re_, cigar = local_alignments(["GTACGCTTT"], ["ACGTAACCGGTTTGCA"])[0]
    assert (score, qs, qe, rs, re_, cigar) == (22, 0, 8, 2, 12, "3=2D2=1X3=")


def brute(a, b, s, is_local):
    low = -(10**9)
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    d, i = [[low] * (len(b) + 1) for _ in h], [[low] * (len(b) + 1) for _ in h]
    if not is_local:
        for x in range(1, len(a) + 1):
            h[x][0] = -(s.gap_open + (x - 1) * s.gap_extend)
        for y in range(1, len(b) + 1):
            h[0][y] = -(s.gap_open + (y - 1) * s.gap_extend)
    best = 0
    for x in range(1, len(a) + 1):
        for y in range(1, len(b) + 1):
            d[x][y] = max(h[x][y - 1] - s.gap_open, d[x][y - 1] - s.gap_extend)
            i[x][y] = max(h[x - 1][y] - s.gap_open, i[x - 1][y] - s.gap_extend)
            p = 0 if "N" in (a[x - 1], b[y - 1]) else s.match if a[x - 1] == b[y - 1] else s.mismatch
            h[x][y] = max(h[x - 1][y - 1] + p, d[x][y], i[x][y], 0 if is_local else low)
            best = max(best, h[x][y])
    return best if is_local else h[-1][-1]


def score_of(cigar, a, b, s):
    import re

    total = x = y = 0
    for n, op in re.findall(r"(\d+)([=XDI])", cigar):
        n = int(n)
        if op in "=X":
            for k in range(n):
                p, q = a[x + k], b[y + k]
                total += 0 if "N" in (p, q) else s.match if p == q else s.mismatch
                assert (p == q) == (op == "=")
            x, y = x + n, y + n
        else:
            total -= s.gap_open + (n - 1) * s.gap_extend
            x, y = (x, y + n) if op == "D" else (x + n, y)
    assert (x, y) == (len(a), len(b))
    return total


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("ACGTN" if seed % 2 else "ACG") for _ in range(n))
    pairs = [(text(r.randint(1, 25)), text(r.randint(1, 30))) for _ in range(30)]
    a, b = [list(x) for x in zip(*pairs, strict=True)]
    for (x, y), got in zip(pairs, local_alignments(a, b), strict=True):
        assert got[0] == brute(x, y, LOCAL_SCORES, True)
        if got[0]:
            assert score_of(got[5], x[got[1] : got[2] + 1], y[got[3] : got[4] + 1], LOCAL_SCORES) == got[0]
    for (x, y), (score, cigar) in zip(pairs, global_alignments(a, b), strict=True):
        assert score == brute(x, y, GLOBAL_SCORES, False) == score_of(cigar, x, y, GLOBAL_SCORES)


def test_empty_sides_and_windows():
    assert local_alignments(["", "A"], ["A", ""]) == [(0, -1, -1, -1, -1, "")] * 2
    assert global_alignments(["", "AC", ""], ["ACG", "", ""]) == [(-5, "3D"), (-4, "2I"), (0, "")]
    assert windowed_global("ACGT" * 30, "ACGT" * 30, window=50) == "120="
