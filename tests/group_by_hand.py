"""The rules of quantification for one read group, step by step in plain Python: what the plan's joins are compared with.

A structure is a chain of junctions (start, end) between two outer ends. `Fit` says how a chain
lies in a longer structure and which of its ends meet the structure's outer ends.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from typing import NamedTuple

from tessera.config import QuantConfig

Chain = tuple  # of (start, end), or None for a junction that failed

FSM, ISM, NIC, NNC, NCD = "FSM", "ISM", "NIC", "NNC", "NCD"


class Fit(NamedTuple):
    start: int
    outer_start: bool
    end: int
    outer_end: bool


@dataclass
class Structure:
    chain: Chain
    start: int
    end: int

    def fit(self, offset: int, n: int) -> Fit:
        """The exon ends that n junctions beginning at offset leave free."""
        first, last = offset == 0, offset + n == len(self.chain)
        return Fit(self.start if first else self.chain[offset - 1][1], first, self.end if last else self.chain[offset + n][0], last)


@dataclass
class Isoform(Structure):
    name: str = ""
    title: str = "NA"
    gene: str = "NA"


@dataclass
class ReadChain(Structure):
    all_annotated: bool = False
    all_sites: bool = False
    strand: str = ""
    perfect: tuple[int, ...] = ()
    classes: list[tuple[str, int, int, int]] = field(default_factory=list)  # sample, start, end, count
    category: str = ""
    isoforms: list[str] = field(default_factory=list)

    @property
    def reads(self) -> int:
        return sum(c[3] for c in self.classes)

    def valid(self, cfg: QuantConfig) -> bool:
        n = self.reads
        return bool(self.perfect) and all(p >= cfg.read_num_cutoff and p / n >= cfg.read_ratio_cutoff for p in self.perfect)


@dataclass
class Result:
    abundance: list[tuple[str, str, str, str, float]] = field(default_factory=list)  # id, title, gene, sample, count
    compatible: list[tuple[Chain, int, int, str, list[str]]] = field(default_factory=list)  # chain, start, end, class, isoforms
    structures: list[tuple[str, str, str, int, int, Chain, str]] = field(default_factory=list)  # id, gene, source, start0, end, chain, strand


def offset_of(short: Chain, long: Chain) -> int | None:
    """Leading junctions of long before the first place where short fits; None fits anything; None for no fit."""
    if len(short) > len(long) or all(x is None for x in short):
        return None
    for o in range(len(long) - len(short) + 1):
        if all(a is None or a == b for a, b in zip(short, long[o:], strict=False)):
            return o
    return None


def lower_median(values: list[tuple[int, int]], upper: bool) -> int:
    """Middle of counted values; of two middles the upper or lower one."""
    values = sorted(values)
    n = sum(c for _, c in values)
    at = n // 2 if upper else (n - 1) // 2
    for v, c in values:
        if at < c:
            return v
        at -= c
    raise ValueError("no values")


def c_two(x: float) -> float:
    return float(f"{x:.2f}")


def ends_ok(fit: Fit, start: int, end: int, cfg: QuantConfig) -> bool:
    """Neither end reaches too far over the structure's: sj_dist at outer ends (any length if allowed), else the internal limit."""
    def ok(over: int, outer: bool) -> bool:
        if outer:
            return cfg.allow_longer_terminal_exons or over <= cfg.sj_dist
        return over <= cfg.internal_boundary_limit

    return ok(fit.start - start, fit.outer_start) and ok(end - fit.end, fit.outer_end)


def part_fits(short: ReadChain, long: Structure, cfg: QuantConfig) -> bool:
    """short is a contiguous part of the longer structure and its median ends agree."""
    if len(short.chain) >= len(long.chain) or (o := offset_of(short.chain, long.chain)) is None:
        return False
    return ends_ok(long.fit(o, len(short.chain)), short.start, short.end, cfg)


def order(c: ReadChain) -> tuple:
    return len(c.chain), tuple((-1, -1) if x is None else x for x in c.chain)


class Group:
    """One read group: `run` classifies chains, finds novel ones, assigns reads and quantifies."""

    def __init__(self, chr_: str, group: int, samples: list[str], chains: list[ReadChain], isoforms: list[Isoform], cfg: QuantConfig):
        self.chr, self.group, self.samples, self.cfg = chr_, group, samples, cfg
        self.chains = {c.chain: c for c in sorted(chains, key=lambda c: tuple((-1, -1) if x is None else x for x in c.chain))}
        self.isoforms = {i.name: i for i in isoforms}
        self.longest: list[ReadChain] = []
        self.number: dict[Chain, int] = {}
        self.inside: dict[Chain, list[Chain]] = defaultdict(list)
        self.initial = {c: {s: 0 for s in samples} for c in self.chains}
        for c in chains:
            for sample, _, _, n in c.classes:
                self.initial[c.chain][sample] += n
        self.direct = {c: dict(v) for c, v in self.initial.items()}
        self.evidence: list[tuple[str, str, tuple[Chain, ...], float]] = []  # order, sample, targets, count
        self.out = Result()
        self.by_start = defaultdict(list)
        for c in self.chains.values():
            for x in set(c.chain) - {None}:
                self.by_start[x].append(c)

    def name(self, number: int) -> str:
        return f"TSR:{self.chr}:{self.group}:{number}"

    def of(self, category: str) -> list[ReadChain]:
        return sorted((c for c in self.chains.values() if c.category == category), key=order)

    def classify(self) -> None:
        by_junction = defaultdict(set)
        for i in self.isoforms.values():
            for x in i.chain:
                by_junction[x].add(i.name)
        for c in self.chains.values():
            if None in c.chain:
                c.category = NCD
            elif not c.all_annotated:
                c.category = NIC if c.all_sites else NNC
            else:
                near = sorted(set().union(*(by_junction[x] for x in c.chain)))
                equal = [n for n in near if self.isoforms[n].chain == c.chain]
                part = [n for n in near if len(self.isoforms[n].chain) > len(c.chain) and offset_of(c.chain, self.isoforms[n].chain) is not None]
                c.category, c.isoforms = (FSM, equal) if equal else (ISM, part) if part else (NIC, [])

    def add_longest(self, c: ReadChain) -> None:
        self.number[c.chain] = len(self.longest)
        self.longest.append(c)

    def among(self, chains: list[ReadChain]) -> None:
        for i, c in enumerate(chains):
            for longer in chains[i + 1 :]:
                if part_fits(c, longer, self.cfg):
                    self.inside[c.chain].append(longer.chain)

    def discover(self) -> None:
        """Novel chains that no longer one contains, in the order NNC, NIC, ISM; their place is their number."""
        if self.cfg.raw:
            for category in (ISM, NIC, NNC):
                for c in self.of(category):
                    if c.valid(self.cfg):
                        self.add_longest(c)
            return
        for category in (NNC, NIC):
            good = [c for c in self.of(category) if c.valid(self.cfg)]
            self.among(good)
            before = list(self.longest)
            for c in good:
                self.inside[c.chain] += [x.chain for x in before if part_fits(c, x, self.cfg)]
            for c in good:
                if not self.inside[c.chain]:
                    self.add_longest(c)
        self.discover_ism()

    def discover_ism(self) -> None:
        candidates, unread = [], set()
        for c in self.of(ISM):
            fitting = [n for n in c.isoforms if part_fits(c, self.isoforms[n], self.cfg)]
            c.isoforms = [n for n in fitting if self.isoforms[n].chain in self.chains]
            if not c.isoforms:
                if fitting:
                    unread.add(c.chain)
                if c.valid(self.cfg):
                    candidates.append(c)
        self.among(candidates)
        for c in reversed(candidates):  # longest first: survivors count for shorter ones
            known = set(self.inside[c.chain])
            self.inside[c.chain] += [x.chain for x in self.longest if x.chain not in known and part_fits(c, x, self.cfg)]
            if not self.inside[c.chain] and c.chain in unread:
                self.add_longest(c)

    def note(self, c: ReadChain, label: str, isoforms: list[str], ends: tuple[int, int] | None = None) -> None:
        for _, s, e, _ in c.classes if ends is None else [("", *ends, 0)]:
            self.out.compatible.append((c.chain, s, e, label, isoforms))

    def containing(self, c: ReadChain) -> list[Chain]:
        return [x for x in dict.fromkeys(self.inside.get(c.chain, ())) if x in self.number]

    def assign_novel(self) -> None:
        for category in (NIC, NNC):
            for c in self.of(category):
                if self.inside.get(c.chain):
                    targets = self.containing(c)
                    if len(targets) == 1:
                        for s in self.samples:
                            self.direct[targets[0]][s] += self.initial[c.chain][s]
                    elif targets:
                        self.share(f"1{category}", c, targets)
                    self.note(c, category, [self.name(self.number[t]) for t in targets])
                else:
                    self.note(c, category, [self.name(self.number[c.chain])] if c.chain in self.number else [])

    def share(self, rank: str, c: ReadChain, targets: list[Chain]) -> None:
        for s in self.samples:
            if self.initial[c.chain][s]:
                self.evidence.append((rank, s, tuple(targets), self.initial[c.chain][s]))

    def assign_ism(self) -> None:
        for c in self.of(ISM):
            if c.chain in self.number:
                own = Fit(c.start, True, c.end, True)
                for sample, s, e, n in c.classes:
                    if ends_ok(own, s, e, self.cfg):
                        self.note(c, NIC, [self.name(self.number[c.chain])], (s, e))
                    else:
                        self.direct[c.chain][sample] -= n
                        self.note(c, ISM, [], (s, e))
                continue
            novel = self.containing(c)
            if not self.inside.get(c.chain):
                novel = [x.chain for x in self.longest if part_fits(c, x, self.cfg)]
                named = c.isoforms
            else:
                named = []
            structures: list[tuple[str, Structure, Chain]] = [(n, self.isoforms[n], self.isoforms[n].chain) for n in named]
            structures += [(self.name(self.number[x]), self.chains[x], x) for x in novel]
            shared: dict[tuple[str, tuple[Chain, ...]], int] = defaultdict(int)
            for sample, s, e, n in c.classes:
                fitting = [(name, chain) for name, st, chain in structures if ends_ok(st.fit(offset_of(c.chain, st.chain), len(c.chain)), s, e, self.cfg)]
                self.note(c, ISM, [name for name, _ in fitting], (s, e))
                targets = tuple(sorted({chain for _, chain in fitting}))
                if not targets:
                    continue
                if len(structures) == 1:
                    self.direct[targets[0]][sample] += n
                else:
                    shared[sample, targets] += n
            self.evidence += [("0", sample, targets, n) for (sample, targets), n in sorted(shared.items())]

    def assign_failed(self) -> None:
        for c in self.of(NCD):
            pool = [x for x in self.of(FSM)] + self.longest
            targets, names = [], []
            known = sum(x is not None for x in c.chain)
            for x in pool:
                shared = any(j in x.chain for j in c.chain if j is not None)
                if shared and len(x.chain) >= max(len(c.chain), known) and (o := offset_of(c.chain, x.chain)) is not None and ends_ok(x.fit(o, len(c.chain)), c.start, c.end, self.cfg):
                    targets.append(x.chain)
                    names += x.isoforms if x.category == FSM else [self.name(self.number[x.chain])]
            if len(targets) == 1:
                for s in self.samples:
                    self.direct[targets[0]][s] += self.initial[c.chain][s]
            elif targets:
                self.share("2", c, sorted(targets))
            self.note(c, NCD, names)

    def maximise(self) -> dict[Chain, dict[str, float]]:
        """Expectation maximisation over chains; one stop test for all samples."""
        now = {c: dict(v) for c, v in self.direct.items()}
        rows = sorted(self.evidence, key=lambda r: r[0])
        if not rows:
            return now
        for _ in range(self.cfg.max_iterate):
            new = {c: dict(v) for c, v in self.direct.items()}
            for _, s, targets, n in rows:
                total = sum(now[t][s] for t in targets)
                for t in targets:
                    new[t][s] += c_two(n * (now[t][s] / total) if total > 0 else n / len(targets))
            new = {c: {s: c_two(x) for s, x in v.items()} for c, v in new.items()}
            moved = max(c_two(abs(new[c][s] - now[c][s])) for c in new for s in self.samples)
            now = new
            if moved < self.cfg.converged:
                break
        return now

    def report(self, em: dict[Chain, dict[str, float]]) -> None:
        for c in self.of(FSM):
            near = {}
            for name in c.isoforms:
                i = self.isoforms[name]
                near[name] = defaultdict(int)
                for sample, s, e, n in c.classes:
                    if abs(i.start - s) <= self.cfg.sj_dist and abs(i.end - e) <= self.cfg.sj_dist:
                        near[name][sample] += n
            total = {s: sum(near[n][s] for n in c.isoforms) for s in self.samples}
            for name in c.isoforms:
                i = self.isoforms[name]
                counts = {}
                for s in self.samples:
                    share = near[name][s] / total[s] if total[s] else 1 / len(c.isoforms)
                    counts[s] = c_two(em[c.chain][s] * share)
                listed = any(near[name][s] if total[s] else em[c.chain][s] > 0 for s in self.samples)
                if listed:
                    self.out.abundance += [(name, i.title, i.gene, s, counts[s]) for s in self.samples]
                    self.out.structures.append((name, i.gene, "annotated_isoform", i.start, i.end, i.chain, c.strand))
            self.note(c, FSM, list(c.isoforms))
        for c in self.longest:
            votes: dict[str, int] = defaultdict(int)
            for x in c.chain:
                for i in self.isoforms.values():
                    votes[i.gene] += x in i.chain
            gene = ",".join(g for g, n in sorted(votes.items(), key=lambda v: (-v[1], v[0])) if n) or "NA"
            name = self.name(self.number[c.chain])
            self.out.abundance += [(name, "NA", gene, s, c_two(em[c.chain][s])) for s in self.samples]
            self.out.structures.append((name, gene, "novel_isoform", c.start - 1, c.end, c.chain, c.strand))

    def run(self) -> Result:
        self.classify()
        self.discover()
        self.assign_novel()
        self.assign_ism()
        self.assign_failed()
        self.report(self.maximise())
        return self.out


def single_exon(samples: list[str], reads: dict[tuple[str, tuple[str, ...]], int], cfg: QuantConfig) -> dict[str, dict[str, float]]:
    """Counts of single-exon isoforms. reads: (sample, compatible isoforms in order) -> number of reads."""
    now: dict[str, dict[str, float]] = defaultdict(lambda: dict.fromkeys(samples, 0.0))
    rows = sorted(reads.items())
    for (s, targets), n in rows:
        for t in targets:
            now[t][s] += n * c_two(1 / len(targets))
    for _ in range(cfg.max_iterate):
        new: dict[str, dict[str, float]] = {t: dict.fromkeys(samples, 0.0) for t in now}
        for (s, targets), n in rows:
            total = sum(now[t][s] for t in targets)
            for t in targets:
                new[t][s] += n * c_two(now[t][s] / total if total > 0 else 1 / len(targets))
        moved = max((c_two(abs(new[t][s] - now[t][s])) for t in new for s in samples), default=0.0)
        now = new  # type: ignore[assignment]
        if moved < cfg.converged:
            break
    return {t: {s: c_two(x) for s, x in v.items()} for t, v in now.items()}
