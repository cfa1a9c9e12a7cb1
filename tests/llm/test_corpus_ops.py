"""Prefix trie, exact deduplication and importance resampling against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import ordering
from tessera.llm import exactdup, resample, trie

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    sym = lambda r, t: (r or "", t or "")
    key = lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, key(r))):
        own[r[0]].append(sym(r[2], r[3]))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members = defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    out = {}
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(node))
        out[min(who), len(node)] = (
            min(members[node[:-1]]) if node else None, len(who), len(kids(node)), sum(not kids(n) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows(df):
    got = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(out) == len(got)
    return out


def made_turns(seed, conversations=60, longest=21):
    r = random.Random(seed)
    rows = []
    for c in [*range(97, 97 + conversations), -5, -105, 700, 712]:
        for t in range(r.choice([1, 2, 3, 5, 8, longest])):
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(["a", "é𝄞", "", None, "long " * 5])))
    return rows + rows[:7] + [(None, 1, "user", "no id")] + [(800, t, "user", f"turn {t % 3}") for t in range(70)]


@pytest.mark.parametrize("hot", [False, True])
def test_trie_matches_brute_force(spark, monkeypatch, hot):
    if hot:  # no table is broadcast whole: hot keys are, the others meet in shuffles
        monkeypatch.setattr(ordering, "KEYS_TO_BROADCAST", 0)
        monkeypatch.setattr(ordering, "HOT_SHARE", 20)
    rows = made_turns(3 if hot else 1)
    df = spark.createDataFrame(rows, TURNS).withColumn("node", F.lit("clash")).withColumn("name", F.lit(1)).repartition(5)
    assert trie_rows(trie.trie(df)) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0
    gone = [(c, 0, "user", "x") for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6]  # their hundred is absent: no turn is left
    assert trie_rows(trie.trie(spark.createDataFrame(gone, TURNS))) == brute_trie(gone)


def test_long_end_lists_are_hashed_in_pieces(spark):
    ids = list(range(3, 2003))
    df = spark.createDataFrame([(7, i) for i in ids] + [(8, 1)], "node long, conv_id long").repartition(4)
    got = {r["node"]: r["ends_sha256"] for r in trie.digest_of_ids(df).collect()}
    assert got == {7: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 8: hashlib.sha256(b"1").hexdigest()}


def test_numbers_and_running_sums(spark):
    r = random.Random(2)
    values = [(r.randrange(5), r.randrange(100)) for _ in range(500)]
    t = ordering.ranged(spark.createDataFrame(values, "k long, v long").repartition(7), F.asc("k"), F.asc("v"))
    got = sorted((x["n"], x["k"], x["v"]) for x in ordering.numbered(t, "n", 3).collect())
    assert got == [(i + 3, *kv) for i, kv in enumerate(sorted(values))]
    sums = sorted(x["s"] for x in ordering.running(t, F.col("v"), "s").collect())
    assert sums == sorted(np.cumsum([v for _, v in sorted(values)]).tolist())


DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])


def texts(seed, n=300):
    r = random.Random(seed)
    pool = ["", None, " ", "a b", "ab", "a\tb\n", "a b", "é è", "éè", "x" * 50_000, "x" * 49_999 + " x", *[f"text {i}" for i in range(40)]]
    rows = [(r.choice([i, i, i, 5, None]), r.choice(pool), 1, "clash") for i in range(n)]
    return rows + [(1000 + i, "hot  text" if i % 2 else "hot text", 1, "clash") for i in range(2500)]


def brute_dups(rows):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, (doc, t, *_) in enumerate(rows):
        groups[plain(t)].append((-len(t or ""), doc is None, doc or 0, i))
    out = []
    for p, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[keep[3]][0], len(members), m == keep, hashlib.sha256(p.encode()).hexdigest()))
    return Counter(out)


def written(spark, rows, path, parts=3):
    spark.createDataFrame(rows, DOCUMENT).repartition(parts).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates_match_brute_force(spark, tmp_path, broadcast, weak):
    rows = texts(4)
    path = written(spark, rows, str(tmp_path / "d.parquet"))
    digest = (lambda c: (F.length(c) % 7).cast("string")) if weak else exactdup.sha256  # many texts of one digest: bytes decide
    state = exactdup.absorb(spark, path, DOCUMENT, str(tmp_path / "state"), digest=digest)
    got = exactdup.resolve(spark.read.parquet(path), state, digest, rows_to_broadcast=1000 if broadcast else 0)
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute_dups(rows)


def test_state_outlives_a_run(spark, tmp_path):
    """A second run over more files goes on from what the first one retained, in small batches."""
    first, second = texts(5, 100), [(i, "ab" if i % 2 else "a  b  ", 1, "") for i in range(-50, 0)]
    path, state = written(spark, first, str(tmp_path / "d.parquet")), str(tmp_path / "state")
    assert Counter(tuple(r) for r in exactdup.deduplicate(spark, path, state, files_per_batch=1).collect()) == brute_dups(first)
    written(spark, second, path)
    assert Counter(tuple(r) for r in exactdup.deduplicate(spark, path, state, files_per_batch=1).collect()) == brute_dups(first + second)
    known = exactdup.absorb(spark, path, DOCUMENT, state, files_per_batch=1)  # nothing new
    assert known.agg(F.sum("n")).first()[0] == len(first + second)


def test_no_documents(spark, tmp_path):
    path = written(spark, [], str(tmp_path / "none.parquet"))
    assert exactdup.deduplicate(spark, path).count() == 0
    empty = spark.createDataFrame([], DOCUMENT)
    assert resample.resample(empty, empty).count() == 0


def test_no_python_in_exact_dedup(spark, tmp_path):
    path = written(spark, texts(6, 20), str(tmp_path / "d.parquet"))
    plan = exactdup.deduplicate(spark, path)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, n, buckets, percent, least):
    count = lambda ts: Counter(zlib.crc32(f.encode()) % buckets for t in ts for f in brute_features(t, n)[1])
    s, t = count(x[1] for x in rows), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, (doc, text, *_) in enumerate(rows):
        words, f = brute_features(text, n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None])
        if len(words) >= least:
            able.append((-score, doc is not None, doc or 0, i))
    for rank, x in enumerate(sorted(able)[: len(able) * percent // 100], 1):
        out[x[3]][4] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_matches_brute_force(spark, n):
    r = random.Random(n)
    pool = ["Alpha", "beta7", "ÉCOLE", "naïve", "𝄞x", "a-b", "c_d", "wort" * 40, "Z", "9"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(0, 40))), 1, "clash") for i in range(200)] + [(None, None, 1, ""), (None, "a " * 30, 1, ""), (3, "", 1, ""), (4, "...", 1, ""), (5, "a" * 100_000, 1, "")]
    rows += rows[:20]
    target = ["Alpha beta7 Alpha", None, "naïve 𝄞x, école"]
    docs, aim = spark.createDataFrame(rows, DOCUMENT).repartition(4), spark.createDataFrame([(1, t, 1, "") for t in target], DOCUMENT)
    got = resample.resample(docs, aim, max_n=n, buckets=50, percent=30, min_words=10)
    assert Counter(tuple(x) for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute_resample(rows, target, n, 50, 30, 10)


def test_crc_of_words():
    words = [b"", b"a", b"hello", "ünï".encode(), b"x" * 64, b"y" * 65, b"z" * 1000]
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    assert resample.extend(np.zeros(len(words), np.uint32), raw, start, end).tolist() == [zlib.crc32(w) for w in words]
    again = resample.extend(np.full(len(words), zlib.crc32(b"before "), np.uint32), raw, start, end)
    assert again.tolist() == [zlib.crc32(b"before " + w) for w in words]
    assert resample.features(pa.array(["A b", None, "c"]), 1, 10)[2].tolist() == [2, 0, 1]
