"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance of being offensive grows with the evidence
of its features (words and their beginnings, so that inflected forms count together); a document's
is the noisy-or of its sentences and a leak for label noise. The weights are learned from document
labels alone, and then point at the offending sentences.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if, checkpoint, chunks, columns_first, held_out, may_learn

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: log-odds of a sentence without evidence: so low that thousands of clean sentences stay clean.
FLOOR = -11.0
THRESHOLD = 0.3


@dataclass
class Model:
    weights: dict[str, float]
    leak: float


def features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 7 letters, marked by a star."""
    return [word, *[word[:n] + "*" for n in range(4, min(8, len(word) + 1))]]


def bags(texts: DataFrame) -> DataFrame:
    """(doc_id, t, toxic, key, words) of texts (doc_id, t, toxic, text): the distinct lower-case word sets of each whole text's sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text", 1 << 20):
            for k, text in enumerate(b.column("text").to_pylist()):
                found = {frozenset(WORD.findall(m[0].lower())) for m in SENTENCE.finditer(text or "")} - {frozenset()}
                words = [sorted(w) for w in found]
                keys = [int.from_bytes(hashlib.blake2b("\n".join(w).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for w in words]
                own = [pa.array([b.column(c)[k].as_py()] * len(words), t) for c, t in (("doc_id", pa.int64()), ("t", pa.int64()), ("toxic", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["doc_id", "t", "toxic", "key", "words"])

    return texts.select("doc_id", "t", "toxic", "text").mapInArrow(run, "doc_id long, t long, toxic int, key long, words array<string>")


def without_beginnings(features: list[str]) -> list[str]:
    """Of features that stand equally often, those that no other begins with: a beginning that counts as much as the whole stands in the same sentences."""
    kept: list[str] = []
    for f in sorted(features, key=lambda x: (-len(x.rstrip("*")), x)):
        if not any(k.startswith(f.rstrip("*")) and (f.endswith("*") or k == f + "*") for k in kept):
            kept.append(f)
    return kept


def select_features(bag: DataFrame, evidence: float = 8.0, least: int = 3) -> list[str]:
    """Features likelier in toxic documents' sentences than chance: in at least `least` of them, with a log-likelihood ratio of `evidence`.

    Equal word sets of a class count once: a document copied many times lends no more support.
    """
    once = bag.dropDuplicates(["toxic", "key"]).select("toxic", "words")
    n = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    beginning = lambda w, k: F.when(F.length(w) >= k, F.concat(F.substring(w, 1, k), F.lit("*")))
    each = F.transform("words", lambda w: F.array_compact(F.array(w, *[beginning(w, k) for k in range(4, 8)])))
    per = once.select("toxic", F.explode(F.array_distinct(F.flatten(each))).alias("f")).groupBy("f").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"))
    all_ = F.col("yes") + F.col("no")
    part = lambda c, of: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (all_ * F.lit(of)))).otherwise(0.0)
    good = (F.col("yes") >= least) & (F.col("yes") > all_ * share) & (part("yes", share) + part("no", 1 - share) >= evidence)
    alike: dict[tuple[str, int, int], list[str]] = {}
    for r in per.where(good).collect():  # what tells a bounded sample's classes apart
        alike.setdefault((r["f"][:4], r["no"], r["yes"]), []).append(r["f"])
    return sorted(f for same in alike.values() for f in without_beginnings(same))


def evidence_rows(bag: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, t, hits): the places in words of each sentence's features, for sentences that have some."""
    shared = bag.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            hits = [sorted({index[f] for w in ws for f in features(w) if f in index}) for ws in b.column("words").to_pylist()]
            keep = pa.array([bool(h) for h in hits], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(keep), b.column("t").filter(keep), pa.array([h for h in hits if h], pa.list_(pa.int32()))], ["doc_id", "t", "hits"])

    return bag.select("doc_id", "t", "words").mapInArrow(run, "doc_id long, t long, hits array<int>")


def loss_and_slope(w: np.ndarray, leak: float, y: np.ndarray, doc: np.ndarray, row: np.ndarray, col: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean negative log-likelihood of the noisy-or with its penalty, its slope by w, each sentence's chance). doc: each sentence's document; row, col: each feature's sentence and number."""
    p = 1 / (1 + np.exp(-(FLOOR + np.bincount(row, weights=w[col], minlength=len(doc)))))
    log_clean = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y)) + np.log1p(-leak)
    clean = np.exp(log_clean)
    loss = -np.where(y > 0, np.log(np.maximum(1 - clean, 1e-300)), log_clean).mean() + l2 * (w @ w) / 2 / len(y)
    down = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)  # d loss / d(-log clean)
    return float(loss), np.bincount(col, weights=(down[doc] * p)[row], minlength=len(w)) / len(y) + l2 * w / len(y), p


def fit(y: np.ndarray, doc: np.ndarray, row: np.ndarray, col: np.ndarray, n: int, rounds: int = 400, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, leak) of n features: maximum likelihood of the noisy-or by projected Adam; weights stay >= 0."""
    y = y.astype(float)
    w = np.full(n, 6.0)
    leak = float(np.clip(y.mean() / 4, 1e-3, 0.2))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        _, grad, p = loss_and_slope(w, leak, y, doc, row, col, l2)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = np.maximum(0, w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9))
        free = np.ones(len(y), bool)
        free[doc[p > 0.5]] = False
        leak = float(np.clip(y[free].mean() if free.any() else leak, 1e-4, 0.2))
    return w, leak


class Evidence:
    """Finds the model's features in text by one automaton; a word or beginning counts where a word begins."""

    def __init__(self, model: Model):
        self.weights = model.weights
        texts: dict[str, list[str]] = {}
        for f in model.weights:
            texts.setdefault(f.rstrip("*"), []).append(f)
        self.automaton = ahocorasick.Automaton()
        for t, features_ in texts.items():
            self.automaton.add_word(t, (len(t), features_))
        if texts:
            self.automaton.make_automaton()
        self.empty = not texts

    def __call__(self, lowered: str) -> set[str]:
        """Features of a lower-case text."""
        hit: set[str] = set()
        if self.empty:
            return hit
        for last, (size, features_) in self.automaton.iter(lowered):
            at = last - size
            if at >= 0 and WORD.match(lowered, at):
                continue
            inside = last + 1 < len(lowered) and WORD.match(lowered, last + 1) is not None
            hit.update(f for f in features_ if f[-1] == "*" or not inside)
        return hit


def chances(text: str | None, evidence: Evidence) -> list[tuple[int, int, float]]:
    """(start, end, chance) of each sentence that holds evidence."""
    if not text or not evidence(text.lower()):
        return []
    out = []
    for m in SENTENCE.finditer(text):
        if hit := evidence(m[0].lower()):
            z = FLOOR + sum([evidence.weights[f] for f in sorted(hit)])
            out.append((m.start(), m.end(), 1 / (1 + np.exp(-z))))
    return out


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Model:
    """Fit on a bounded sample: about per_class labelled texts of each class, all their sentences.

    docs: doc_id, text; labels: doc_id, toxic. Held-out folds, null ids, texts and labels take no part.
    Labels that contradict each other for one id count as toxic; an exactly repeated row counts once,
    several texts of one id count each. Empty tables, or one class alone, teach a constant. Sentences are counted
    where the texts are; the driver sees the chosen features and which of them each sentence has.
    """
    rows = labels.where(may_learn(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).withColumn("t", F.xxhash64("text"))
    known = checkpoint(texts.select("doc_id", "t").join(rows, "doc_id").distinct())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = lambda y: F.lit(min(1.0, per_class / counts.get(y, 1)) * (1 << 20))
    drawn = checkpoint(known.where(F.pmod(F.xxhash64("doc_id", "t", F.lit(2)), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, rate(1)).otherwise(rate(0))))
    sample = drawn.select("doc_id", "t", "toxic").toPandas().sort_values(["doc_id", "t"], ignore_index=True)
    y = sample["toxic"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 0.0)
    bag = checkpoint(bags(texts.join(broadcast_if(drawn, 16 * per_class), ["doc_id", "t"])).dropDuplicates(["doc_id", "t", "key"]))
    words = select_features(bag)
    found = evidence_rows(bag, words).toPandas()
    place = {k: i for i, k in enumerate(zip(sample["doc_id"], sample["t"], strict=True))}
    order = sorted((place[k], list(h)) for k, h in zip(zip(found["doc_id"], found["t"], strict=True), found["hits"], strict=True))
    doc = np.array([d for d, _ in order], np.int64)
    row = np.repeat(np.arange(len(order)), [len(h) for _, h in order]) if order else np.zeros(0, np.int64)
    col = np.array([x for _, h in order for x in h], np.int64)
    w, leak = fit(y, doc, row, col, len(words))
    return Model({t: float(x) for t, x in zip(words, w, strict=True) if x > 0}, leak)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, offending (array of start, end, chance) of every row; null and empty texts get the leak alone."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        evidence = Evidence(model)
        for b in chunks(batches, "text", 1 << 20):
            scores, spans = [], []
            for text in b.column("text").to_pylist():
                found = chances(text, evidence)
                clean = 1 - model.leak
                for _, _, p in found:
                    clean *= 1 - p
                scores.append(min(1.0, max(0.0, 1 - clean)))
                spans.append([{"start": s, "end": e, "chance": float(p)} for s, e, p in found if p >= THRESHOLD])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,end:int,chance:double>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3), offending of every row of docs.

    Null ids are never held out, repeated rows each get their own row, null and empty texts score the
    leak alone, texts count whole at any length. An empty docs gives no row; empty labels score all 0.
    Other columns of either table are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, learned from `labels.toxic`."""
    docs = columns_first(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return classify(docs, columns_first(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic"))
