"""Throughput of scan, correct and quantify on synthetic reads: prints one JSON line. Arguments: reads, cores."""

from __future__ import annotations

import json
import random
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent / "tests"))

from synthetic import World  # noqa: E402

from tessera.plans import correct, quantify, scan  # noqa: E402
from tessera.sources import alignments, annotation, genome  # noqa: E402
from tessera.storage import stored  # noqa: E402


def main(n: int, cores: int) -> None:
    steps = tempfile.mkdtemp(prefix="bench-steps-")  # one machine: driver and executors share it
    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.checkpoint.dir", steps).config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    w, r = World(), random.Random(2)
    for c in range(4):
        w.add_chromosome(f"chr{c + 1}", [r.randint(3, 8) for _ in range(25)])
    folder = Path(tempfile.mkdtemp())
    (folder / "g.fa").write_text(w.fasta())
    (folder / "a.gtf").write_text(w.gtf({f"T{k}": (g, list(range(len(g.exons)))) for k, g in enumerate(w.genes)}))

    def shifted(ops, seq):
        if len(ops) < 3 or r.random() > 0.2:
            return ops, seq
        return [(ops[0][0] + 3, "M"), ops[1], (ops[2][0] - 3, "M"), *ops[3:]], seq

    def one(i: int) -> tuple:
        g = r.choice(w.genes)
        first = r.choice([0, 0, 0, 1])
        skip = r.choice([None, None, None, 1]) if len(g.exons) > 3 else None
        return w.read(f"r{i}", g, [e for e in range(first, len(g.exons)) if e != skip or e == first], tweak=shifted)

    (folder / "r.sam").write_text(w.sam([one(i) for i in range(n)]))
    ref, exons = genome.read_fasta(spark, str(folder / "g.fa")), annotation.read_exons(spark, str(folder / "a.gtf"))
    rows = alignments.read_sam(spark, [(str(folder / "r.sam"), "one")])
    took = {}
    began = time.perf_counter()
    s = scan.run(rows, ref, exons)
    s.reads = stored(s.reads)
    s.flanks = stored(s.flanks)
    took["scan"] = time.perf_counter() - began
    began = time.perf_counter()
    c = stored(correct.run(s, ref))
    took["correct"] = time.perf_counter() - began
    began = time.perf_counter()
    q = quantify.run(c.select("read_id", "sample", "chr", "group_id", "strand", "start", "end", "sjs"), exons, s.junctions.where("perfect"))
    isoforms = q.abundance.count()
    took["quantify"] = time.perf_counter() - began
    fixed = c.selectExpr("explode(sjs) j").where("j.status = 'corrected'").count()
    print(json.dumps({"metric": "reads per second", "reads": n, "cores": cores, "isoforms": isoforms, "corrected_junctions": fixed, **{k: round(n / v) for k, v in took.items()}, "seconds": {k: round(v, 1) for k, v in took.items()}}))
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 20_000, int(sys.argv[2]) if len(sys.argv) > 2 else 8)
