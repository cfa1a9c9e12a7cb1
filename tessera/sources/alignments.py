"""Alignments and their sample list."""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored

SAM_SCHEMA = "read_id string, flag int, chr string, start int, mapq int, cigar string, seq string, qual string"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample, file_id) of a two-column tab-separated list; ids follow the order of lines.

    Error: another ending than sam or bam, an empty column, or one path with two samples. The list
    is small (a line for each input file).
    """
    rows = spark.read.csv(path, sep="\t", schema="path string, sample string, file_id int")
    bad = F.when(~F.coalesce(F.col("path").rlike("[sb]am$"), F.lit(False)), "no .sam or .bam file").when(F.coalesce(F.col("sample"), F.lit("")) == "", "no sample name")
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("bad", bad)
    n = F.count("*").over(Window.partitionBy("path"))
    rows = rows.withColumn("bad", F.coalesce("bad", F.when(n > 1, "listed twice")))
    checked = F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.coalesce("path", F.lit("?")), F.lit(": "), F.col("bad")))).otherwise(F.col("path"))
    number = F.coalesce("file_id", F.row_number().over(Window.orderBy("at")) - 1)
    return rows.select(checked.cast("string").alias("path"), "sample", number.cast("int").alias("file_id"))


def sample_rows(paths: str, names: str) -> list[tuple[str, str]]:
    """Pairs of two comma-separated lists of equal length."""
    a, b = paths.split(","), names.split(",")
    if len(a) != len(b):
        raise ValueError(f"{len(a)} paths and {len(b)} sample names")
    return list(zip(a, b, strict=True))


def _files(spark: SparkSession, path: str) -> list[str]:
    """The file at path, or those of the folder at path, as _metadata.file_path has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in (fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)])]
    return [re.sub("^file:/+", "file:/", x.toUri().toString()) for x in found if not x.getName().startswith(("_", "."))]


def read_sam(spark: SparkSession, samples: list[tuple[str, str]]) -> DataFrame:
    """Alignments of (path, sample) pairs, each path a file or a folder of its parts: all SAM files in one scan, all BAM files in another, by splits.

    file_id is the pair's place; line orders a file's rows. Header lines are skipped, tags are an array.
    """
    if not samples:
        raise ValueError("no input files")
    known = spark.createDataFrame([(file, i, sample) for i, (path, sample) in enumerate(samples) for file in _files(spark, path)], "file string, file_id int, sample string")
    out = None
    for read, own in ((_sam, [p for p, _ in samples if not p.endswith(".bam")]), (read_bam, [p for p, _ in samples if p.endswith(".bam")])):
        if own:
            rows = read(spark, own)
            out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    return out.join(F.broadcast(known), "file").drop("file")  # a row for each input file


def _sam(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"))
    f = F.split("value", "\t")
    return lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        f[0].alias("read_id"), f[1].try_cast("int").alias("flag"), f[2].alias("chr"), f[3].try_cast("int").alias("start"), f[4].try_cast("int").alias("mapq"),
        f[5].alias("cigar"), F.when(f[9] != "*", f[9]).alias("seq"), F.when(f[10] != "*", f[10]).alias("qual"), F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))).alias("tags"), "line", "file",
    )


#: Struct codes of BAM's number types.
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def bam_tags(data: bytes, at: int, end: int) -> list[str]:
    """Tags as SAM writes them: TG:T:value, all integers as i, arrays as B:type,values."""
    out = []
    while at < end:
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out.append(f"{tag}:A:{chr(data[at])}")
            at += 1
        elif kind in "ZH":
            stop = data.index(0, at)
            out.append(f"{tag}:{kind}:{data[at:stop].decode()}")
            at = stop + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[of]}", data, at + 5)
            at += 5 + n * struct.calcsize(NUMBERS[of])
            out.append(f"{tag}:B:{of}" + "".join(f",{x:g}" if of == "f" else f",{x}" for x in values))
        else:
            value = struct.unpack_from(f"<{NUMBERS[kind]}", data, at)[0]
            at += struct.calcsize(NUMBERS[kind])
            out.append(f"{tag}:f:{value:g}" if kind == "f" else f"{tag}:i:{value}")
    return out


def long_cigar(cigar: str, tags: list[str], seq_n: int) -> tuple[str, list[str]]:
    """The CIGAR of more operations than a record holds: it stands in tag CG, the record has <read length>S<span>N instead."""
    if re.fullmatch(rf"{seq_n}S\d+N", cigar):
        for t in tags:
            if t.startswith("CG:B:I,"):
                ops = (int(x) for x in t[7:].split(","))
                return "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in ops), [x for x in tags if x is not t]
    return cigar, tags


#: The header that every BGZF block has up to its size, and what of it the size counts.
BLOCK_MAGIC = "\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
RECORD = struct.Struct("<iiiBBHHHiiii")
SYNC_BYTES = 1 << 20
SYNC_RECORDS = 4


def inflate(block: bytes) -> bytes:
    """The payload of a BGZF block whose BLOCK_MAGIC is cut off."""
    if len(block) < 10 or struct.unpack_from("<H", block)[0] + 1 != len(block) + len(BLOCK_MAGIC):
        raise ValueError("not a BGZF block: another size than its header says")
    data = zlib.decompress(block[2:-8], -15)
    if struct.pack("<II", zlib.crc32(data), len(data)) != block[-8:]:
        raise ValueError("damaged BGZF block")
    return data


def header(data: bytes) -> tuple[list[str], int] | None:
    """(reference names, bytes) of a BAM header; None where data ends within it."""
    if data[:4] != b"BAM\1"[: len(data)]:
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n = struct.unpack_from("<i", data, at)[0]
        at += 4
        names = []
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    except struct.error:
        return None
    return (names, at) if at <= len(data) else None


def _may_start(data: bytes, at: int, refs: int) -> int | None:
    """Where the record at `at` would end, if its fields can be those of a record; None if they can't, or data ends before they do."""
    if at + RECORD.size > len(data):
        return None
    size, ref, pos, name_n, _, _, cigar_n, _, seq_n, next_ref, next_pos, _ = RECORD.unpack_from(data, at)
    fields = 32 + name_n + 4 * cigar_n + (seq_n + 1) // 2 + seq_n
    if not (-1 <= ref < refs and -1 <= next_ref < refs and pos >= -1 and next_pos >= -1 and name_n and seq_n >= 0 and fields <= size):
        return None
    name = data[at + 36 : at + 36 + name_n]
    if len(name) == name_n and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + name_n : at + 36 + name_n + 4 * cigar_n : 4]
    return at + 4 + size if all(c & 15 <= 8 for c in ops) else None


def first_record(data: bytes, refs: int) -> int | None:
    """The first place from which SYNC_RECORDS records follow each other; if there is none, from which records follow each other up to the end of data."""
    open_ended = None
    for at in range(len(data) - RECORD.size + 1):
        stop: int | None = at
        for n in range(SYNC_RECORDS):
            if stop + RECORD.size > len(data):
                if n and open_ended is None:
                    open_ended = at
                break
            stop = _may_start(data, stop, refs)
            if stop is None:
                break
        else:
            return at
    return open_ended


def decode_record(data: bytes, at: int) -> tuple:
    """The fields of SAM_SCHEMA (chr as its number), and tags, of the record at `at`."""
    size, ref, pos, name_n, mapq, _, cigar_n, flag, seq_n, _, _, _ = RECORD.unpack_from(data, at)
    end = at + 4 + size
    at += 36
    name = data[at : at + name_n - 1].decode()
    at += name_n
    cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in struct.unpack_from(f"<{cigar_n}I", data, at)) or "*"
    at += 4 * cigar_n
    seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in data[at : at + (seq_n + 1) // 2])[:seq_n]
    at += (seq_n + 1) // 2
    qual = data[at : at + seq_n]
    cigar, tags = long_cigar(cigar, bam_tags(data, at + seq_n, end), seq_n)
    return name, flag, ref, pos + 1, mapq, cigar, seq or None, None if qual[:1] in (b"", b"\xff") else "".join(chr(q + 33) for q in qual), tags


def decode_split(blocks: Iterator[bytes], refs: int, skip: int | None) -> Iterator[tuple[str, object]]:
    """Of a split's blocks: ("row", fields) of whole records, ("head", bytes) before the first record, ("tail", bytes) of one that goes on.

    skip: where the first record is known to be; else it is found. A split within one record is all head. Only
    what isn't decoded yet is held.
    """
    data, synced = b"", skip is not None
    left, at = skip or 0, 0
    for block in itertools.chain(blocks, [None]):
        last = block is None
        data += block or b""
        if left:
            cut = min(left, len(data))
            data, left = data[cut:], left - cut
        if not synced:
            if len(data) < SYNC_BYTES and not last:
                continue
            start = first_record(data, refs)
            if start is None and not last:
                continue
            yield "head", data if start is None else data[:start]
            data = b"" if start is None else data[start:]
            synced = start is not None
            if not synced:
                return
        at = 0
        while at + RECORD.size <= len(data):
            stop = _may_start(data, at, refs)
            if stop is None:
                raise ValueError("damaged BAM file: no record where one must begin")
            if stop > len(data):
                break
            yield "row", decode_record(data, at)
            at = stop
        data = data[at:]
    yield "tail", data


def decode_whole(data: bytes) -> Iterator[tuple]:
    """The records that data consists of; an error if they don't fill it."""
    at = 0
    while at < len(data):
        if at + 4 > len(data) or at + 4 + struct.unpack_from("<i", data, at)[0] > len(data):
            raise ValueError("records of a BAM file don't meet at a split")
        yield decode_record(data, at)
        at += 4 + struct.unpack_from("<i", data, at)[0]


_FIELDS = pa.schema([("read_id", pa.string()), ("flag", pa.int32()), ("ref", pa.int32()), ("start", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.list_(pa.string()))])
_PLACE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("kind", pa.string()), ("bytes", pa.binary())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.unify_schemas([_PLACE, _FIELDS])
    cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _bgzf(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block: where its split starts, value): BGZF blocks, cut by the text reader at their common header, so that splits go as for lines."""
    rows = spark.read.option("encoding", "ISO-8859-1").option("lineSep", BLOCK_MAGIC).text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")).where(F.length("value") > 0)


def read_bam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments of BAM files of any size, by splits: file, and the columns of read_sam but file_id and sample.

    Each split finds its first record by the form of some records in a row. What lies before it belongs to a record that
    began in a split before; these pieces meet and must be whole records, so that a wrong guess is an error
    and never a wrong row. A header must lie within its file's first split.
    """
    blocks = _bgzf(spark, [paths] if isinstance(paths, str) else paths)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bytes | None] = {}
        for b in batches:
            out = []
            for file, value in zip(b.column("file").to_pylist(), b.column("value"), strict=True):
                if (data := seen.get(file, b"")) is not None:
                    found = header(data + inflate(value.as_py()))
                    seen[file] = data + inflate(value.as_py()) if found is None else None
                    out += [(file, i, name, found[1]) for i, name in enumerate([*found[0], "*"])] if found else []
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["file", "ref", "chr", "size"])

    names = stored(blocks.where("block = 0").mapInArrow(heads, "file string, ref int, chr string, size long"))
    known = {r["file"]: (r["refs"], r["size"]) for r in names.groupBy("file").agg(F.max("ref").alias("refs"), F.max("size").alias("size")).collect()}  # a row for each input file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((f, at, v.as_py()) for b in batches for f, at, v in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value"), strict=True))
        for (file, block), own in itertools.groupby(each, lambda x: x[:2]):
            if file not in known:
                raise ValueError(f"{file}: the header is longer than a split")
            refs, size = known[file]
            part: list[tuple] = []
            for n, (kind, x) in enumerate(decode_split((inflate(v) for _, _, v in own), refs, size if block == 0 else None)):
                part.append((file, block, n, kind, None, *x) if kind == "row" else (file, block, n, kind, x, *[None] * len(_FIELDS)))
                if len(part) == 2000:
                    yield _table(part)
                    part = []
            yield _table(part)

    fields = "read_id string, flag int, ref int, start int, mapq int, cigar string, seq string, qual string, tags array<string>"
    found = stored(blocks.mapInArrow(run, f"file string, block long, row long, kind string, bytes binary, {fields}"))
    loose = found.where("kind <> 'row'").select("file", "block", "row", "kind", "bytes")
    run_of = F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "row"))  # two pieces for each split
    pieces = F.array_sort(F.collect_list(F.struct("block", "row", "bytes")))
    joined = loose.withColumn("run", run_of).groupBy("file", "run").agg(pieces.alias("x"), F.min_by("block", F.struct("block", "row")).alias("block"), F.min_by("row", F.struct("block", "row")).alias("row"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                whole = decode_whole(b"".join(p["bytes"] for p in r["x"]))
                out += [(r["file"], r["block"], r["row"] + k, "row", None, *x) for k, x in enumerate(whole)]
            yield _table(out)

    across = joined.mapInArrow(stitch, f"file string, block long, row long, kind string, bytes binary, {fields}")
    rows = found.where("kind = 'row'").unionByName(across)
    rows = rows.withColumn("ref", F.when(F.col("ref") < 0, F.lit(None)).otherwise(F.col("ref")))
    rows = rows.join(F.broadcast(names.select("file", "ref", "chr")), ["file", "ref"], "left").withColumn("chr", F.coalesce("chr", F.lit("*")))  # reference sequences: a header's worth
    return rows.select("read_id", "flag", "chr", "start", "mapq", "cigar", "seq", "qual", "tags", F.struct("block", "row").alias("line"), "file")


def numbered_lines(text: DataFrame) -> DataFrame:
    """(file, line_no, value) of text (file, block, value: lines as splits give them): each line's number in its file, from 0.

    Lines are counted in each split; a split's first number is the sum of those before it.
    """
    rows = stored(text.withColumn("_m", F.monotonically_increasing_id()))  # in a split, ids follow the lines
    per = rows.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    per = per.select("file", "block", "_first", F.coalesce(before, F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(per), ["file", "block"]).select("file", (F.col("_base") + F.col("_m") - F.col("_first")).alias("line_no"), "value")


def combine_fastq(spark: SparkSession, folder: str, pattern: str = "*.fastq") -> DataFrame:
    """Records (name, seq, qual) of all files below folder whose name is like pattern, by splits; every record is four lines, whatever they begin with.

    An error: a record whose first or third line doesn't begin with @ or +, or whose sequence and qualities differ in
    length. Blank lines at a file's end are none.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    text = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    at = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value"))).alias(f"l{k}")
    rec = numbered_lines(text).groupBy("file", F.floor(F.col("line_no") / 4).alias("record")).agg(*[at(k) for k in range(4)])
    blank = F.forall(F.array(*[F.coalesce(f"l{k}", F.lit("")) for k in range(4)]), lambda x: x == "")
    bad = ~F.coalesce(F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3")), F.lit(False))
    name = F.when(bad, F.raise_error(F.concat(F.col("file"), F.lit(": record "), F.col("record").cast("string"), F.lit(" is no FASTQ record")))).otherwise(F.expr("substring(l0, 2)"))
    return rec.where(~blank).select(name.cast("string").alias("name"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))
