"""Defaults of the scan, correct and quantify steps. Results depend on each of them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanConfig:
    read_num_cutoff: int = 2
    read_ratio_cutoff: float = 0.0
    group_extra_range: int = 0
    mapq_cutoff: int = 1
    inserted_cont_cutoff: int = 20
    cont_del_max: int = 50
    mitochondrial: str = "chrM"
    flank: int = 10
    flank_extra: int = 15
    alignment_read_groups: bool = False

    @property
    def cluster_gap(self) -> int:
        return 2 * self.flank + self.flank_extra


@dataclass(frozen=True)
class CorrectConfig:
    flank: int = 10
    flank_extra: int = 15
    first_exon_diff: int = 30
    suggest_distance_max: int = 20
    confirm_fold: float = 10.0
    exon_length_ratio: float = 0.8
    end_extra: int = 50
    score_difference: float = 2.0
    extra_candidate_fold: float = 0.1
    end_lost_fold: float = 1.5
    cluster_overlap_max: int = 100
    position_window: int = 25


@dataclass(frozen=True)
class QuantConfig:
    sj_dist: int = 35
    internal_boundary_limit: int = 6
    max_iterate: int = 100
    read_num_cutoff: int = 2
    read_ratio_cutoff: float = 0.0
    converged: float = 0.1
    allow_longer_terminal_exons: bool = False
    raw: bool = False


@dataclass(frozen=True)
class Scores:
    match: int
    mismatch: int
    gap_open: int  # cost of a gap's first base
    gap_extend: int  # cost of each further base


LOCAL_SCORES = Scores(5, -4, 8, 6)
GLOBAL_SCORES = Scores(3, -2, 3, 1)


@dataclass(frozen=True)
class Profile:
    """A single sequence as a profile: chance that a base is read right, that a gap opens (of either kind) and goes on; hits below least_bits are none."""

    identity: float = 0.9
    gap_open: float = 0.03125
    gap_extend: float = 0.75
    least_bits: float = 3.0


PROFILE = Profile()
