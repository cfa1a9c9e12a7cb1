"""Language ID, toxicity, near-duplicates, vector searches and the pipeline against plain versions."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, graph, langid, neardup, topk, toxicity

SYLLABLES = {"aa": ["lo", "mi", "ra", "tu"], "bb": ["krz", "wsz", "czy", "prz"], "cc": ["éa", "oué", "èle", "çon"]}


def prose(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)) + "."


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def test_langid(make_docs):
    docs = [(i, prose(k, i), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)] + [(200, None, "aa"), (201, "123 !!", "bb"), (202, "", "cc"), (203, prose("bb", 5), None), (204, "x", "aa"), (None, prose("cc", 7), "cc")]
    got = {r.doc_id: r for r in langid.identify(make_docs(docs).withColumnRenamed("source", "score")).collect()}
    assert len(got) == len(docs)
    held = [(i, k) for i, _, k in docs[:90] if fold(i) == 2]
    assert len(held) > 10 and all(got[i].lang_pred == k and got[i].held_out and 0.5 < got[i].score <= 1 for i, k in held)
    assert [(got[i].lang_pred, got[i].score) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert got[203].lang_pred == "bb" and got[None].lang_pred == "cc" and not got[None].held_out
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "abc", None)])).collect()} == {"und"}
    assert langid.identify(make_docs([])).count() == 0


def test_bundles_add_up():
    text = prose("cc", 1, 50)
    whole, letters = langid.bundle([text])
    codes = [int(x) for x in langid.symbols([text])[0]]
    v = langid.letter_vectors().astype(int)
    hand = sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    assert (whole[0] == hand).all() and letters[0] == sum(c.isalpha() for c in text)
    old, langid.CHUNK = langid.CHUNK, 100
    try:
        cut, n = langid.bundles([None, text, "", "ab"])
    finally:
        langid.CHUNK = old
    assert n.tolist() == [0, letters[0], 0, 2] and (cut[1] == hand).all()
    mixed = "Привет, МИР! 日本 🙂 𐐀𐐨 Straße--ÉTÉ  x" * 9
    langid.CHUNK = 7
    try:
        (a, n), (b, m) = langid.bundle_long(mixed), langid.bundle([mixed])
    finally:
        langid.CHUNK = old
    assert (a == b[0]).all() and n == m[0]
    assert (langid.bundle(["ПРИВЕТ Ça"])[0] == langid.bundle(["привет çA"])[0]).all()


def test_langid_by_hand(make_docs):
    """Prototypes, centring, cosine and argmax with plain loops."""
    docs = [(i, prose(k, i, 20), k) for i, k in enumerate(["aa", "bb", "cc"] * 12)]
    v = langid.letter_vectors().astype(float)

    def vector(t):
        s = [0]
        for c in t + " ":
            x = langid.symbol(c)
            if x or s[-1]:
                s.append(x)
        return sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(s, s[1:], s[2:], strict=False))

    total = {}
    for i, t, k in docs:
        if fold(i) != 2:
            x = vector(t)
            total[k] = total.get(k, 0) + np.rint(x / np.linalg.norm(x) * 4096)
    unit = {k: x / np.linalg.norm(x) for k, x in total.items()}
    mean = sum(unit.values()) / len(unit)
    got = {r.doc_id: r for r in langid.identify(make_docs(docs)).collect()}
    for i, t, _ in docs:
        x = vector(t)
        x = x / np.linalg.norm(x) - mean
        cosine = {k: float(x @ (p - mean) / np.linalg.norm(x) / np.linalg.norm(p - mean)) for k, p in unit.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx((1 + cosine[best]) / 2, abs=1e-9)


def test_toxicity(spark, make_docs):
    bad = ["grobik", "vlarm", "snatchen"]
    r = random.Random(4)

    def text(i, toxic):
        s = [prose("aa", f"{i}/{k}", 8) for k in range(10)]
        if toxic:
            for k in r.sample(range(10), 4):
                s[k] = s[k][:-1] + " " + r.choice(bad) + r.choice(["", "en", "ig"]) + "."
        return " ".join(s)

    docs = [(i, text(i, i % 4 == 0)) for i in range(300)] + [(900, None), (901, ""), (902, "Vlarm!"), (None, "clean")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (900, None, 0), (7, 0, 0), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.classify(make_docs(docs), labels.withColumn("text", F.lit("x"))).collect()}
    assert len(got) == len(docs)
    held = [i for i in range(300) if fold(i) == 2]
    assert all(got[i].predicted == int(i % 4 == 0) and got[i].held_out for i in held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    assert got[900].predicted == got[901].predicted == got[None].predicted == 0 and got[902].predicted == 1
    body = docs[4][1]
    assert got[4].offending and all(any(w in body[s.start : s.end] for w in bad) for s in got[4].offending)
    none = toxicity.classify(make_docs(docs), labels.where("toxic = 0"))
    assert {x.predicted for x in none.collect()} == {0}
    assert toxicity.classify(make_docs([]), labels).count() == 0


def test_noisy_or_by_hand():
    """Scores by loops over words; the fit's slope by differences."""
    model = toxicity.Model({"grob*": 7.0, "grobik": 3.0, "vlarm": 12.5, "étéx*": 12.0}, 0.02)
    evidence = toxicity.Evidence(model)
    texts = ["A Grobik here. grobs, then vlarms! vlarm?", "Vlarm2 _vlarm x.vlarm", "", "Étéx was été\n\nnothing. ungrobik", "clean all over"]
    for t in texts:
        clean = 0.98
        spans = []
        for m in toxicity.SENTENCE.finditer(t):
            have = {f for w in toxicity.WORD.findall(m[0].lower()) for f in toxicity.features(w)} & model.weights.keys()
            if have:
                p = 1 / (1 + np.exp(-(toxicity.FLOOR + sum(model.weights[f] for f in have))))
                clean *= 1 - p
                spans.append((m.start(), m.end(), pytest.approx(p)))
        got = toxicity.chances(t, evidence)
        assert got == spans
        assert 1 - 0.98 * np.prod([1 - p for _, _, p in got]) == pytest.approx(1 - clean)
    assert toxicity.without_beginnings(["grob*", "grobi*", "grobik", "grozny", "groz*", "grub"]) == ["grobik", "grozny", "grub"]


def test_slope_by_differences():
    """The fit's slope against differences of its loss, and the loss against the noisy-or's formula."""
    r = np.random.default_rng(3)
    y, n = r.integers(0, 2, 12).astype(float), 5
    doc = np.sort(r.integers(0, 12, 30))
    row = np.repeat(np.arange(30), 2)
    col = r.integers(0, n, 60)
    w, leak, l2 = r.uniform(2, 12, n), 0.05, 1e-3
    loss, slope, p = toxicity.loss_and_slope(w, leak, y, doc, row, col, l2)
    clean = np.array([(1 - leak) * np.prod(1 - p[doc == d]) for d in range(12)])
    assert loss == pytest.approx(-np.mean(np.where(y > 0, np.log(1 - clean), np.log(clean))) + l2 * (w @ w) / 24)
    for k in range(n):
        step = np.eye(n)[k] * 1e-6
        assert slope[k] == pytest.approx((toxicity.loss_and_slope(w + step, leak, y, doc, row, col, l2)[0] - toxicity.loss_and_slope(w - step, leak, y, doc, row, col, l2)[0]) / 2e-6, rel=1e-4, abs=1e-9)
    fitted, _ = toxicity.fit(y, doc, row, col, n, rounds=50)
    assert (fitted >= 0).all()


def test_features_by_hand(spark):
    """Features are chosen from all sentences of whole texts, however long, by their ratio; equal word sets of a class count once."""
    filler = ". ".join(f"{a}{b} lorem" for a in "abcdefgh" for b in "ijklmnop")
    rows = [(i, i, int(i % 3 == 0), f"{filler}. {'x' * 30000}" + (f". Grobik{'ab'[i % 2]} here {'qrstuvw'[i // 3 % 7]}" if i % 3 == 0 else "")) for i in range(60)] + [(i, i, 0, "copy of vlarm") for i in range(60, 70)]
    bag = toxicity.bags(spark.createDataFrame(rows, "doc_id long, t long, toxic int, text string"))
    got = bag.collect()
    assert max(len(b.words) for b in got) == 3 and sum(b.words == ["copy", "of", "vlarm"] for b in got) == 10
    sets = {0: set(), 1: set()}
    for b in got:
        sets[b.toxic].add(frozenset(b.words))
    count = {y: Counter(f for s in sets[y] for f in {f for w in s for f in toxicity.features(w)}) for y in (0, 1)}
    share = len(sets[1]) / (len(sets[0]) + len(sets[1]))
    want = []
    for f, yes in count[1].items():
        no = count[0][f]
        ratio = yes * np.log(yes / (yes + no) / share) + (no * np.log(no / (yes + no) / (1 - share)) if no else 0)
        if yes >= 3 and yes > (yes + no) * share and ratio >= 3:
            want.append(f)
    groups = {}
    for f in want:
        groups.setdefault((f[:4], count[0][f], count[1][f]), []).append(f)
    assert toxicity.select_features(bag, evidence=3.0) == sorted(f for g in groups.values() for f in toxicity.without_beginnings(g)) and "grobik*" in want
    hits = toxicity.evidence_rows(bag, ["grobik*", "lorem"]).collect()
    assert {tuple(h.hits) for h in hits} == {(0,), (1,)}


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes_by_hand(docs, similar=lambda a, b: len(a & b) >= 0.8 * len(a | b), sets=None):
    sets = sets or [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and similar(sets[a], sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(k) and docs[j][0] is not None]
        out.append(min(ids) if ids else None)
    return out


def near_docs(words):
    r = random.Random(8)
    docs = [(i, words(i, 80)) for i in range(25)]
    for base in range(4):  # a family of variants, some too different from most others
        w = words(1000 + base, 120).split()
        docs.append((100 + 20 * base, " ".join(w)))
        for k in range(1, 16):
            v = list(w)
            for p in r.sample(range(120), r.choice([1, 2, 3, 4])):
                v[p] = f"x{r.randrange(4)}"
            docs.append((100 + 20 * base + k, " ".join(v)))
    docs += [(300 + i, docs[3][1].upper() if i % 2 else docs[3][1]) for i in range(6)]
    return docs + [(400, None), (401, ""), (402, " "), (403, "two words"), (404, "Two  words"), (405, "two words more"), (None, docs[5][1]), (None, "only me"), (406, "same"), (406, "same")]


def test_near_duplicates(make_docs, words):
    docs = near_docs(words)
    got = neardup.classes(make_docs(docs).withColumnRenamed("lang", "node").withColumnRenamed("source", "key"))
    want = classes_by_hand(docs)
    assert sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str) == sorted(((d[0], c) for d, c in zip(docs, want, strict=True)), key=str)
    assert neardup.classes(make_docs([])).count() == 0
    assert [r.class_id for r in neardup.classes(make_docs([(7, None)])).collect()] == [7]
    kept = neardup.keep_one(make_docs(docs)).collect()
    ids = [r.doc_id for r in kept]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want if c is not None})
    assert {r.text for r in kept if r.doc_id is None} == {"only me"}


def test_near_duplicates_in_split_buckets(make_docs, words, monkeypatch):
    """Buckets dealt over many parts give the same classes."""
    docs = near_docs(words)
    monkeypatch.setattr(neardup, "SALT_ROWS", 3)
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(make_docs(docs)).collect()), key=str)
    assert got == sorted(((d[0], c) for d, c in zip(docs, classes_by_hand(docs), strict=True)), key=str)


def test_weighted_near_duplicates(make_docs, words):
    """Shingles weigh as often as they stand: texts of equal sets but other repeats are apart, and the reverse."""
    once, more = words(1, 60), words(2, 60)
    docs = [(1, once), (2, f"{once} {once} {once}"), (3, f"{once} {once} {once} {words(3, 12)}"), (4, " ".join([more] * 20 + [words(4, 40)])), (5, " ".join([more] * 20 + [words(5, 40)])), (6, "a b c"), (7, "a b c"), (8, None)]
    docs += [(10 + i, " ".join([words(6, 30)] * 4 + [words(50 + i, 3)])) for i in range(6)]

    def counts(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    want = classes_by_hand(docs, lambda a, b: (a & b).total() >= 0.8 * (a | b).total(), [counts(t) for _, t in docs])
    got = sorted((r.doc_id, r.class_id) for r in neardup.classes(make_docs(docs), weighted=True).collect())
    assert got == sorted((d[0], c) for d, c in zip(docs, want, strict=True))
    assert got != sorted((r.doc_id, r.class_id) for r in neardup.classes(make_docs(docs)).collect())


def test_keep_one_without_unique_ids(make_docs, words):
    a, b, c, d = (words(2000 + i, 80) for i in range(4))
    near = a.split()
    near[3] = "x"
    rows = [(None, a), (None, a), (None, " ".join(near)), (7, b), (7, b.upper()), (7, b + " x"), (8, b), (None, c), (None, c), (3, d), (None, d), (None, None), (None, None), (9, None), (None, "..."), (None, "two words")]
    for more in ([], [(500, "again and again it is"), (500, "again and again it is")]):
        kept = [(r.doc_id, r.text) for r in neardup.keep_one(make_docs(rows + more)).collect()]
        assert sum(i is None and t in (a, " ".join(near)) for i, t in kept) == 1 and kept.count((None, c)) == 1
        assert sum(i == 7 for i, _ in kept) == 1 and not any(i == 8 for i, _ in kept)
        assert (3, d) in kept and (None, d) not in kept
        assert kept.count((None, None)) == kept.count((9, None)) == kept.count((None, "...")) == 1
        assert len(kept) == 8 + len(more) // 2


def test_leftovers_find_links(spark):
    sets = [list(range(100)), list(range(10, 110)), list(range(1000, 1100)), list(range(1001, 1101))]
    frame = spark.createDataFrame([(i, len(s), np.array(s, "<u4").tobytes()) for i, s in enumerate(sets)], "node long, n int, shingles binary")
    member = spark.createDataFrame([(1, i, i, 2, i % 2) for i in range(4)], "key long, node long, comp long, parts int, salt int")
    assert sorted(tuple(r) for r in neardup.leftover_links(member, frame, 0.8, block=2).collect()) == [(0, 1), (2, 3)]
    pairs = spark.createDataFrame([(0, 1), (0, 2), (2, 3)], "a long, b long")
    assert sorted(tuple(r) for r in neardup.verify(pairs, frame, 0.8).collect()) == [(0, 1), (2, 3)]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    universe = r.integers(0, 2**63, 4000, dtype=np.uint64)
    for n, common in ((1, 1), (40, 30), (400, 300), (1500, 500)):
        a = np.unique(universe[:n])
        b = np.unique(universe[n - common : 2 * n - common])
        k = 512
        s = neardup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), k)
        assert (s != neardup.EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 5 * np.sqrt(max(true * (1 - true), 0.002) / k)
    x, wa, wb = universe[:30], r.uniform(0.2, 4, 30), r.uniform(0.2, 4, 30)
    s = neardup.signatures(np.concatenate([x, x]), np.array([0, 30, 60]), 1024, np.concatenate([wa, wb]))
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((s[0] == s[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / 1024)
    assert (neardup.signatures(x[:0], np.array([0, 0]), 8) == neardup.EMPTY).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    nodes = {x for e in edges for x in e} | {999}
    labels = spark.createDataFrame([(n, n) for n in nodes], "node long, comp long")
    got = dict(tuple(x) for x in graph.merge(labels, spark.createDataFrame(edges, "a long, b long")).collect())
    root = {n: n for n in nodes}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(12, 16))
    rows = [(i, (centre[i % 12] + 0.4 * r.normal(size=16)).astype("f4").tolist(), 0) for i in range(700)]
    rows += [(1000 + i, rows[40][1], 0) for i in range(45)]  # a large group of equal vectors, with queries
    rows += [(2000, None, 0), (2020, [float("nan")] + [0.0] * 15, 0), (2040, [0.0] * 16, 0), (2060, [None] + [1.0] * 15, 0), (None, rows[1][1], 0), rows[20], rows[20], (2080, [float("inf")] + [0.0] * 15, 0)]
    return rows, spark.createDataFrame(rows, VECTORS)


def test_nearest(vectors):
    rows, df = vectors
    got = {}
    for x in ann.search(df.withColumnRenamed("label", "rank"), F.col("vec_id") % 20 == 0, 20, first_rows=200, leaf_rows=64).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    ok = {i: np.array(v, float) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids, mat = np.array(list(ok)), np.array(list(ok.values()))
    assert set(got) == {i for i in ok if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        s = {i: float(sum(a * b for a, b in zip(ok[i], ok[q], strict=True))) for i in ok}
        assert all(f[2] == pytest.approx(s[f[1]], abs=1e-12) for f in found)
        want = [ids[k] for k in np.lexsort((ids, -np.round(mat @ ok[q], 10))) if ids[k] != q][:20]
        hits += len({f[1] for f in found} & set(want))
    assert hits >= 0.95 * 20 * len(got)


def test_nearest_small(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [-1.0, 0.0], 0)], VECTORS)
    assert [(x["rank"], x.vec_id, x.score) for x in ann.search(few, F.col("vec_id") == 0, 20).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, -1.0)]
    assert ann.search(few.where("false"), F.lit(True), 20).count() == 0
    assert ann.search(few, F.lit(False), 20).count() == 0


def test_nearest_ties(spark):
    """Equal scores: the smaller vec_id, also where more rows tie than are kept."""
    rows = [(0, [1.0, 0.0], 0), *[(i, [0.5, i / 64], 0) for i in range(1, 200)]]
    got = ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [(x["rank"], x.vec_id, x.score) for x in got] == [(i, i, 0.5) for i in range(1, 21)]


def test_nearest_of_other_lengths(spark):
    """Vectors of several lengths: each meets its own length only."""
    rows = [(i, [float(i + 1)] * (2 + i % 3), 0) for i in range(30)] + [(99, [], 0)]
    got = {}
    for x in ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == {q: [i for i in range(29, -1, -1) if i % 3 == q % 3 and i != q] for q in (0, 10, 20)}


def test_nearest_recall_and_cost(spark):
    """50,000 vectors in 500 clusters: recall of at least 0.9 while at most a tenth of the rows is scored for a query."""
    r = np.random.default_rng(8)
    centre = r.normal(size=(500, 32))
    x = (centre[r.integers(0, 500, 50_000)] + 0.25 * r.normal(size=(50_000, 32))).astype("f4")
    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 32, dtype=np.int32)), pa.array(x.ravel()))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": cells}))
    figures, got = {}, {}
    for row in ann.search(df, F.col("vec_id") % 100 == 0, 20, figures=figures).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    s = x[::100].astype(float) @ x.T.astype(float)
    s[np.arange(500), np.arange(0, 50_000, 100)] = -np.inf
    want = np.argpartition(-s, 19, axis=1)[:, :20]
    hits = np.mean([len(got[100 * i] & set(w.tolist())) / 20 for i, w in enumerate(want)])
    assert hits >= 0.9 and len(got) == figures["queries"] == 500
    assert figures["scored"] <= 0.1 * 500 * figures["rows"]


def test_top_k(vectors, spark):
    rows, df = vectors
    e = df.where(topk.finite(F.col("embedding"))).select("vec_id", topk.integer_weights(F.col("embedding")).alias("weights"))
    got = sorted(tuple(x) for x in topk.search(e, F.col("vec_id") % 50 == 0, 5, rows_per_block=100, queries_per_block=4).collect())
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert got == sorted(con.sql(topk.OP7_SQL).fetchall()) and len(got) > 60
    assert topk.search(e.where("false"), F.lit(True), 5).count() == 0
    two = spark.createDataFrame([(1, [1, 0]), (2, [0, 0]), (3, [2, 2])], "vec_id long, weights array<bigint>")
    assert [(x.vec_id, x.score) for x in topk.search(two, F.col("vec_id") == 1, 5).orderBy("rank").collect()] == [(3, 2), (2, 0)]


def test_pipeline(make_docs, words):
    docs = [(i, prose(k, i) + " mail a@b.com", k, "s") for i, k in enumerate(["aa", "bb", "cc"] * 10)]
    docs += [(100, docs[0][1], "aa", "s"), (101, "12 34", "aa", "s"), (102, None, None, None), (103, "menu\n" + prose("aa", 77), "aa", "t")]
    docs += [(110 + i, "menu\n" + prose("bb", 200 + i), "bb", "t") for i in range(8)]
    d, spark = make_docs(docs), make_docs(docs).sparkSession
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "").persist()
        seen.append((name, d.columns, d.count()))
        if name == "near_duplicates":
            kept = d.collect()
        if name == "personal_data":
            masked = d.collect()
    assert [n for n, _, _ in seen] == ["language", "lines", "near_duplicates", "personal_data", "packing"]
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for _, c, _ in seen[:-1])
    assert [n for _, _, n in seen[:4]] == [len(docs) - 2, len(docs) - 2, len(docs) - 3, len(docs) - 3]
    assert {r.doc_id for r in kept} == {i for i, *_ in docs} - {100, 101, 102}
    assert not any("menu" in r.text for r in kept) and all(len(r.text) == r.n_chars for r in masked)
    assert all("a@b.com" not in r.text and ("[EMAIL]" in r.text) == (r.doc_id < 100) for r in masked)
    packed = d.toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in kept} and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_drops_unrecognised(make_docs):
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [(i, prose(k, i), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)] + [(200 + i, prose(k, 500 + i), None) for i, k in enumerate(["aa", "bb", "cc"] * 10)]
    junk = [(300 + i, "".join(r.choice(letters + " ") for _ in range(n)), None) for i, n in enumerate([60, 300, 2000] * 5)]
    junk += [(400 + i, "".join(r.choice(letters + letters.upper() + "0123456789+/") for _ in range(n)), None) for i, n in enumerate([60, 300, 2000] * 5)]
    other = ["".join(r.choice(["hun", "wek", "dyf", "gob", "jip"]) for _ in range(3)) for _ in range(50)]
    junk += [(500 + i, " ".join(r.choice(other) for _ in range(60)), None) for i in range(10)]
    junk.append((600, junk[0][1], "aa"))  # a wrong label doesn't let junk through
    d = make_docs(docs + junk)
    assert {x.doc_id for x in corpus_pipeline.language(d.sparkSession, d, "").collect()} == {i for i, *_ in docs}
    two = make_docs([x for x in docs if x[2] != "cc"])  # a language that was not learned
    assert {x.doc_id for x in corpus_pipeline.language(two.sparkSession, two, "").collect()} == {i for i, *_ in docs if (i % 3 if i < 200 else (i - 200) % 3) != 2}
    one = make_docs([(1, prose("aa", 1), "aa"), (2, prose("aa", 2), None)] + junk[:3])
    assert {1, 2} <= {x.doc_id for x in corpus_pipeline.language(one.sparkSession, one, "").collect()}
