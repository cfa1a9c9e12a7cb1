"""Line dedup, language model, PII, BPE and packing against plain versions."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe, linededup, lm, packing, pii

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "één twee drie <|endoftext|> x"), (5, "same text here"), (6, "same text here"), (6, "same text here"), (None, "no id"),
    (7, "a" * 5000), (8, "!!!###$$$ " * 50), (9, "日本語 テキスト 🙂🙂 'll don't"), (10, "1234567890" * 200), (11, "x\r\ny\n\nz  "),
]


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def boilerplate_by_hand(docs, ratio=0.1, least=5):
    pages, seen = Counter(), Counter()
    for _, text, source in docs:
        pages[source] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            seen[source, line] += 1
    drop = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop) for _, t, s in docs]


def test_line_dedup(make_docs, words):
    docs = [(i, f"menu\n{words(i, 5)}\n  footer {i % 3}\n\n", None, f"s{i % 2}") for i in range(40)]
    docs += [(100 + i, "menu\nown", None, "small") for i in range(3)] + [(200 + i, t, None, None) for i, t in enumerate([None, "", "menu", "menu\nmenu"] + ["menu"] * 5)]
    got = linededup.drop_boilerplate(make_docs(docs).withColumnRenamed("n_chars", "drops"))
    want = boilerplate_by_hand([(i, t, s) for i, t, _, s in docs])
    assert sorted(rows(got, "doc_id", "text"), key=str) == sorted([(d[0], t) for d, t in zip(docs, want, strict=True)], key=str)
    assert {r.doc_id: r.n_dropped for r in got.collect()}[203] == 2 and {r.doc_id: r.text for r in got.collect()}[100] == "menu\nown"
    assert linededup.drop_boilerplate(make_docs([])).count() == 0
    assert rows(linededup.drop_boilerplate(make_docs(ODD)), "n_dropped") == [(0,)] * len(ODD)


def sql_rows(docs, sql):
    con = duckdb.connect()
    con.register("t", docs.toPandas())
    con.sql("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM t")
    return con.sql(sql).fetchall()


def test_line_dedup_sql(make_docs, words):
    docs = make_docs([(i, f"menu\n{words(i, 3)}\nfoot", None, f"s{i % 3}" if i % 4 else None) for i in range(60)] + [(99, None, None, "s1")])
    got = rows(linededup.drop_boilerplate(docs), "doc_id", "source", "text", "n_dropped")
    assert sorted(got, key=str) == sorted(sql_rows(docs, linededup.OP1_SQL), key=str)


def scores_by_hand(texts, order, backoff, least):
    toks = [(t or "").lower().split() for t in texts]
    c = Counter(tuple(t[i : i + n]) for t in toks for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total = sum(map(len, toks))

    def s(gram):
        if len(gram) == 1:
            return math.log10(c[gram] / total)
        return math.log10(c[gram] / c[gram[:-1]]) if c[gram] >= least else math.log10(backoff) + s(gram[1:])

    return [sum(s(tuple(t[max(0, i - order + 1) : i + 1])) for i in range(len(t))) / len(t) if t else None for t in toks]


@pytest.mark.parametrize(("order", "least", "block"), [(1, 1, 1 << 20), (2, 2, 400), (3, 1, 400), (3, 2, 1 << 20)])
def test_language_model(make_docs, words, order, least, block):
    docs = [(i, words(i % 7, 30, 12)) for i in range(20)] + [(50, None), (51, " "), (52, "one"), (53, "W1 w2")]
    got = lm.stupid_backoff(make_docs(docs), order, 0.4, least, block)
    want = scores_by_hand([t for _, t in docs], order, 0.4, least)
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(docs)
    for (i, t), w in zip(docs, want, strict=True):
        assert found[i].n_words == len((t or "").split())
        assert found[i].score == (None if w is None else pytest.approx(w, abs=1e-9))
    assert lm.stupid_backoff(make_docs([])).count() == 0
    assert lm.stupid_backoff(make_docs(ODD)).count() == len(ODD)


def test_count_tables():
    """Keys and counts of a block come back as they went, large counts too; an n-gram of every order has its place."""
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    n = np.resize(np.array([1, 2, 254, 255, 256, 1 << 40], np.uint64), len(h))
    assert (lm.unpack_keys(lm.pack_keys(h), len(h)) == h).all() and (lm.unpack_counts(lm.pack_counts(n), len(n), int((n >= 255).sum())) == n).all()
    for some in (h[:0], h[:1], np.arange(7, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64), np.array([2**64 - 1], np.uint64)):
        assert (lm.unpack_keys(lm.pack_keys(some), len(some)) == some).all()
    hashes = [h[[3, 1, 3]], h[[9, 9]], h[:0]]
    keys, counts, places = lm.distinct_ngrams(hashes)
    assert (np.diff(keys) > 0).all() and sorted(counts.tolist()) == [1, 2, 2]
    assert all((keys[p] == x).all() for p, x in zip(places, hashes, strict=True))


def test_language_model_hot_words(make_docs):
    """A word of all documents, counted past a byte, in many small blocks."""
    docs = [(i % 7, "the the " + "the x%d" % (i % 5)) for i in range(400)]
    got = sorted((r.doc_id, round(r.score, 9)) for r in lm.stupid_backoff(make_docs(docs), block_bytes=2000).collect())
    want = scores_by_hand([t for _, t in docs], 3, 0.4, 2)
    assert got == sorted((i, round(w, 9)) for (i, _), w in zip(docs, want, strict=True))


def test_language_model_sql(make_docs, words):
    docs = make_docs([(i, words(i % 9, 40, 15)) for i in range(30)] + [(90, None), (91, "A a\tA\n b")])
    got = [(i, n, None if s is None else round(s, 6)) for i, n, s in rows(lm.stupid_backoff(docs), "doc_id", "n_words", "score")]
    assert sorted(got, key=str) == sorted(sql_rows(docs, lm.OP3_SQL), key=str)


TEXTS = [
    "mail bob.smith+x@ex-ample.co.uk, a@b@c.com and @x.y or z@w; .a@b.c.@d.e", "ips 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111  1111 1111 1111",
    "+1 (555) 010-9999 or +12 34 or ++44 20 7946 0958- x +1.....2", "12345678901234567890123 4242424242424242", "IBAN: GB82 WEST 1234 5698 7654 32 and iban GB82 WEST 1234 5698 7654 33", "SSN 123-45-6789 ssn: 666-45-6789 account no. 12345678 Accounting 12345678",
    "https://bob:secret@host.com/x http://host.com:80/a@b", "4111111111111111@x.com +4111111111111111", "@" * 50 + "a@b.c", "1." * 300 + "1", "",
]


def base_by_hand(t):
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(s := re.sub(r"\D", "", m[0])) <= 19 and luhn(s)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


def test_pii(make_docs):
    import random

    r = random.Random(1)
    noise = ["".join(r.choice("a1.@+- 2()9%_\né") for _ in range(200)) for _ in range(150)]
    for t in [*TEXTS, *noise]:
        found = pii.find(t)
        assert [x for x in found if x[1] < pii.BASE] == base_by_hand(t), t
        assert found == sorted(found)
    assert [pii.KINDS[k] for _, k, _ in pii.find(TEXTS[5])] == ["iban"]
    assert [(pii.KINDS[k], TEXTS[6][s:e]) for s, k, e in pii.find(TEXTS[6])] == [("ssn", "123-45-6789"), ("account", "12345678")]
    assert "login" in [pii.KINDS[k] for _, k, _ in pii.find(TEXTS[7])]
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, TEXTS[0])])
    for r in pii.detect(docs).collect():
        t = TEXTS[r.doc_id or 0] if r.doc_id != 99 else ""
        b = base_by_hand(t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in b) for k in range(4))
    masked = {r.doc_id: r.text for r in pii.mask(docs.withColumnRenamed("lang", "kind")).collect()}
    assert masked[99] is None and masked[2].startswith("[CARD] and 4111-1111-1111-1112") and "@" not in masked[8]
    assert pii.detect(make_docs([])).count() == 0


def test_pii_anchors_in_any_case_and_length(make_docs):
    def spans(t):
        return [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find(t)]

    for cue in ("Social Security Number", "social Security number", "SOCIAL SECURITY NUMBER", "sSn"):
        for before in ("", "\u0130\u212a é\U0001f600 "):  # lower-casing these would move offsets or make ASCII letters
            assert spans(f"{before}{cue}: 123-45-6789.") == [("ssn", "123-45-6789")]
    assert spans("IbAn GB82 WEST 1234 5698 7654 32") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert spans("aCCount Nr 12345678") == [("account", "12345678")]
    for scheme in ("HTTP://", "Https://", "fTp://"):
        assert ("login", f"{scheme}user:pw@host") in spans(f"see {scheme}user:pw@host now")
    for user, password in (("u", "t" * 5000), ("u" * 5000, "p"), ("u", "t" * 257)):
        t = f"https://{user}:{password}@host.org/x"
        assert ("login", t[:-2]) in spans(t)
    assert not spans("http://" + "a" * 200_000) and not spans("http://a:" + "b:" * 100_000 + " ")
    masked = pii.mask(make_docs([(1, "Social Security Number: 123-45-6789 and HTTP://a:" + "b" * 300 + "@c.org")])).first().text
    assert masked == "Social Security Number: [SSN] and [LOGIN]"


def test_pii_addresses_and_secrets():
    def spans(t):
        return [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find(t)]

    assert spans("at fe80::1ff:fe23:4567:890a, 2001:db8:0:0:0:0:0:1 and ::ffff:0:9") == [("ipv6", "fe80::1ff:fe23:4567:890a"), ("ipv6", "2001:db8:0:0:0:0:0:1"), ("ipv6", "::ffff:0:9")]
    for t in ("at 12:30:45 or 1:2", "std::vector", "abc::def", "a:b::c::1", "::", "1::", ":" * 5000, "9:" * 5000, "12345::1", "x1::2y"):
        assert not spans(t), t
    assert spans("lives at 221B Baker Street, or 7 Old Mill Lane.") == [("street", "221B Baker Street"), ("street", "7 Old Mill Lane")]
    assert spans("12 Elm Drive") == [("street", "12 Elm Drive")]
    for t in ("the Baker Street shop", "12 long road", "12 Elm driveway", "3 Streets", "A" * 5000 + " Street", "Aa " * 3000 + "Road"):
        assert not spans(t), t
    assert spans('token = "04dbebab91ab85687d33" and Password: Tr0ub4dor&3x9y1') == [("secret", "04dbebab91ab85687d33")]
    assert spans("api_key=abcdef123456.") == [("secret", "abcdef123456")]
    for t in ("a token of thanks", "tokens: abcdefghijklmnop", "token = 123456789012", "secret:", "password " * 2000, "token=" + "=" * 100_000):
        assert not spans(t), t


@pytest.fixture(scope="module")
def reference_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(make_docs, words, reference_encoding):
    docs = ODD + [(100 + i, words(i, 200) + chr(0x100 + i) * i) for i in range(20)] + [(200, "word" * 900 + " ab" * 10)]
    got = bpe.digests(make_docs(docs)).collect()
    assert len(got) == len(docs)
    by = {(i, t): reference_encoding.encode_ordinary(t or "") for i, t in docs}
    want = sorted(((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t) in docs for ids in [by[i, t]]), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == want
    assert bpe.digests(make_docs([])).count() == 0


def test_bpe_pieces(reference_encoding):
    import random

    r = random.Random(2)
    v = bpe.vocabulary(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pieces = ["".join(r.choice("abcdetr#=") for _ in range(r.randint(1, 40))).encode() for _ in range(500)] + [b"a" * 1500, bytes(range(128, 256)), b"=" * 3000]
    want = [reference_encoding._core_bpe.encode_single_piece(p) for p in pieces]
    assert v.encode(pieces) == want
    assert all(v.decode(ids) == p for ids, p in zip(want, pieces, strict=True))


def test_bpe_long_rows(reference_encoding):
    """Rows of one pre-token: runs of one letter, repeated and random text, merged by all places at once."""
    import random

    r = random.Random(3)
    v = bpe.vocabulary(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    pieces = [b"a" * n for n in range(1, 40)] + ["".join(r.choice(k) for _ in range(n)).encode() for k in ("ab", "theintrs", "abcdefghijklmnopqrstuvwxyz", "=-#", "é日x") for n in (2, 3, 50, 700, 4000)] + [b"abab" * 500, b"in the" * 300]
    assert [v._row(p) for p in pieces] == [reference_encoding._core_bpe.encode_single_piece(p) for p in pieces]


def test_ranks_are_the_tokenizers_merges(tmp_path):
    """All 50,000 merges hold; a tokenizer with another merge, or another way to cut text, is found out."""
    import json

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert packing.same_merges(str(path), str(ranks))
    own = json.loads(open(path, encoding="utf-8").read())
    for change in ("merge", "cut"):
        other = json.loads(json.dumps(own))
        if change == "merge":
            at = next(i for i, (a, b) in enumerate(other["model"]["merges"]) if len(a) > 1 and a[:1] in other["model"]["vocab"] and a[1:] + b in other["model"]["vocab"])
            a, b = other["model"]["merges"][at]
            other["model"]["merges"][at] = [a[:1], a[1:] + b]
        else:
            other["pre_tokenizer"]["add_prefix_space"] = True
        (tmp_path / f"{change}.json").write_text(json.dumps(other), encoding="utf-8")
        assert not packing.same_merges(str(tmp_path / f"{change}.json"), str(ranks))


def test_packing(make_docs, words):
    docs = ODD + [(100 + i, words(i, 10 + 40 * i)) for i in range(40)]
    got = packing.pack(make_docs(docs)).toPandas()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for i, t in docs:
        ids.setdefault(i, []).append(np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    total = sum(len(x) for v in ids.values() for x in v)
    assert got.length.sum() == total
    for i, v in ids.items():
        mine = got[got.doc_id == i] if i is not None else got[got.doc_id.isna()]
        want = sorted((p, s, n, zlib.crc32(x[s : s + n])) for x in v for p, (s, n) in enumerate(packing.cut(len(x), 1024)))
        assert sorted(zip(mine.piece, mine.start, mine.length, mine.ids_crc32, strict=True)) == want
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all() and (seq.offset + seq.length).max() <= 1024
    assert got.sequence_id.nunique() <= math.ceil(total / 1024) + 2
    assert packing.pack(make_docs([])).count() == 0


def test_packing_plan():
    r = np.random.default_rng(3)
    for size, n in ((64, 5000), (64, 40), (1024, 20000)):
        h = np.bincount(np.minimum(size, 1 + r.geometric(4 / size, n)), minlength=size + 1)
        p = packing.plan(h, size)
        used = np.zeros(size + 1, np.int64)
        for lengths, k in p:
            assert sum(lengths) <= size and k > 0
            for x in lengths:
                used[x] += k
        assert (used == h).all()
        bound = math.ceil((h * np.arange(size + 1)).sum() / size)
        assert sum(k for _, k in p) <= max(bound * 1.005, bound + 1)
    assert packing.plan(np.zeros(9, np.int64), 8) == []
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
