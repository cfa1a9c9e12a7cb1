"""Every registered query and the pipeline on the smallest tables: schema, one row for each document or pair, and SQL where there is some."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {
    "op1_linededup": ["doc_id", "source", "text", "n_dropped"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_lm": ["doc_id", "n_words", "score"],
    "op4_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_ann": ["query_id", "rank", "vec_id", "score"],
    "op6_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_topk": ["query_id", "rank", "vec_id", "score"],
    "op8_neardup": ["doc_id", "class_id"],
    "op9_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_exactdup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op13_resample": ["doc_id", "n_features", "weight", "score", "rank"],
}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    got = df.collect()
    docs = con.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    if name in ("op5_ann", "op7_topk"):
        n, k = (20, 20) if name == "op5_ann" else (50, 5)
        assert len(got) == k * con.sql(f"SELECT count(*) FROM embeddings WHERE vec_id % {n} = 0").fetchall()[0][0]
    elif name == "op9_packing":  # a sequence has no gap and no overlap
        assert sum(r["piece"] == 0 for r in got) == docs
        used = {}
        for r in got:
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in used.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 1024
    elif name == "op11_trie":
        assert sum(r["depth"] == 0 for r in got) == 1
    else:
        assert len(got) == docs
    if sql := queries.oracle_sql().get(name):
        want = con.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        at = [want.columns.index(c) for c in df.columns]
        assert sorted("|".join(map(plain, r)) for r in got) == sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall())


def test_pipeline_on_tables(spark):
    """Each stage on all that the one before kept: nothing but copies and unknown languages goes, and the packing is whole."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA)
        assert docs.columns == before.columns
        n.append(docs.count())
        if name in ("lines", "personal_data"):
            assert n[-1] == n[-2]
    assert n[1] >= 0.97 * n[0] and 0 < n[3] <= n[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("piece = 0").count() == n[-1]
    run = corpus_pipeline.run(spark, DATA)
    assert run.columns == packed.columns
    total = lambda d: d.agg(F.count("*"), F.sum("length"), F.sum("ids_crc32")).first()
    assert total(run) == total(packed)
