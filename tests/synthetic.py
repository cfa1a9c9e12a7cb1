"""A small synthetic genome with genes and alignments on it."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

BASES = "ACGT"


@dataclass
class Gene:
    name: str
    chr: str
    strand: str
    exons: list[tuple[int, int]]  # 0-based half-open


@dataclass
class World:
    seed: int = 1
    genes: list[Gene] = field(default_factory=list)
    chromosomes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.random = random.Random(self.seed)

    def bases(self, n: int) -> str:
        return "".join(self.random.choice(BASES) for _ in range(n))

    def add_chromosome(self, name: str, exon_counts: list[int], strands: list[str] | None = None) -> None:
        parts, at = ["NN" + self.bases(1500)], 1502
        for g, n in enumerate(exon_counts):
            strand = strands[g] if strands else "+"
            exons = []
            for e in range(n):
                size = self.random.randint(100, 200)
                parts.append(self.bases(size))
                exons.append((at, at + size))
                at += size
                if e < n - 1:
                    size = self.random.randint(200, 500)
                    ends = ("GT", "AG") if strand == "+" else ("CT", "AC")
                    parts.append(ends[0] + self.bases(size - 4) + ends[1])
                    at += size
            self.genes.append(Gene(f"{name}g{g}", name, strand, exons))
            parts.append(self.bases(2000))
            at += 2000
        self.chromosomes[name] = "".join(parts)

    def fasta(self) -> str:
        return "".join(f">{n} test\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in self.chromosomes.items())

    def gtf(self, isoforms: dict[str, tuple[Gene, list[int]]]) -> str:
        rows = ["# made for tests"]
        for t, (g, picked) in isoforms.items():
            for k, e in enumerate(picked):
                s, end = g.exons[e]
                rows.append(f'{g.chr}\ttest\texon\t{s + 1}\t{end}\t.\t{g.strand}\t.\tgene_id "{g.name}"; transcript_id "{t}"; gene_name "N{g.name}"; transcript_name "N{t}"; exon_number {k + 1};')
        return "\n".join(rows) + "\n"

    def read(self, name: str, gene: Gene, picked: list[int], mapq: int = 30, flag: int = 0, start: int = 0, end: int = 0, tweak=None) -> tuple:
        """A perfect alignment of those exons; start and end move its outer ends outwards (or inwards, below 0)."""
        blocks = [list(gene.exons[e]) for e in picked]
        blocks[0][0] -= start
        blocks[-1][1] += end
        seq = "".join(self.chromosomes[gene.chr][s:e] for s, e in blocks)
        ops = []
        for k, (s, e) in enumerate(blocks):
            if k:
                ops.append((s - blocks[k - 1][1], "N"))
            ops.append((e - s, "M"))
        if tweak:
            ops, seq = tweak(ops, seq)
        return name, flag, gene.chr, blocks[0][0] + 1, mapq, "".join(f"{n}{o}" for n, o in ops), seq

    def sam(self, reads: list[tuple]) -> str:
        head = "".join(f"@SQ\tSN:{n}\tLN:{len(s)}\n" for n, s in self.chromosomes.items())
        rows = sorted(reads, key=lambda r: (r[2], r[3]))
        return head + "".join(f"{n}\t{f}\t{c}\t{p}\t{q}\t{cg}\t*\t0\t0\t{s}\t{'*' if s == '*' else 'E' * len(s)}\n" for n, f, c, p, q, cg, s in rows)
