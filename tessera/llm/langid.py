"""Language identification with hyperdimensional profiles.

Each letter has a random +1/-1 vector. A letter trigram is bound as the product of its first
letter's vector permuted twice, its second's permuted once and its third's. A text bundles (adds)
its trigrams' vectors; a language's prototype bundles its documents. The cosine with the
prototypes decides.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chunks, columns_first, held_out, may_learn

DIM = 1024
SYMBOLS = 256
SEED = 4
CHUNK = 1 << 18
LEVEL_STEPS = 1 << 12
UNKNOWN = "und"
#: Letters with a symbol of their own beside a-z; others share the rest by code point.
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœąćęłńśźżčďěňřšťůž"
OWN = "abcdefghijklmnopqrstuvwxyz" + ACCENTED


def symbol(c: str) -> int:
    """0 for no letter; small and capital forms of a letter are one symbol."""
    if not c.isalpha():
        return 0
    c = c.lower()[0]
    own = OWN.find(c)
    return own + 1 if own >= 0 else len(OWN) + 1 + ord(c) % (SYMBOLS - 1 - len(OWN))


@functools.cache
def letter_table() -> np.ndarray:
    """Symbol of each code point of the basic plane."""
    return np.array([symbol(chr(code)) for code in range(1 << 16)], np.uint8)


@functools.cache
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))


def ngram_vectors(codes: np.ndarray) -> np.ndarray:
    """One row per trigram code."""
    v = letter_vectors()
    first, second = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)
    return first[codes // (SYMBOLS * SYMBOLS)] * second[codes // SYMBOLS % SYMBOLS] * v[codes % SYMBOLS]


def raw_symbols(text: str) -> np.ndarray:
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = letter_table()[np.minimum(point, 0xFFFF)]
    if (beyond := point > 0xFFFF).any():
        far, place = np.unique(point[beyond], return_inverse=True)
        s[beyond] = np.array([symbol(chr(c)) for c in far.tolist()], np.uint8)[place]
    return s


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each text between two non-letters and runs of non-letters made one; text number of each."""
    s = raw_symbols(" ".join(["", *texts, ""]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.zeros(len(s), np.int64)
    owner[ends[:-1][ends[:-1] < len(s)]] = 1
    owner = np.cumsum(owner)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (owner[1:] != owner[:-1])
    return s[keep], owner[keep]


def _codes(s: np.ndarray) -> np.ndarray:
    s = s.astype(np.int64)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def bundle(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x DIM float32 sums of trigram vectors, number of letters of each text). Sums are whole numbers."""
    s, owner = symbols(texts)
    letters = np.bincount(owner[s > 0], minlength=len(texts))
    same = owner[2:] == owner[:-2]
    code = _codes(s)[same]
    own = owner[2:][same]
    used, column = np.unique(code, return_inverse=True)
    counts = np.bincount(own * len(used) + column, minlength=len(texts) * len(used)).reshape(len(texts), -1)
    out = np.zeros((len(texts), DIM), np.float32)
    for at in range(0, len(used), 2048):
        out += counts[:, at : at + 2048].astype(np.float32) @ ngram_vectors(used[at : at + 2048]).astype(np.float32)
    return out, letters


def bundle_long(text: str) -> tuple[np.ndarray, int]:
    """bundle([text]) of one text of any length: its symbols are a byte each, and their trigrams are summed piece by piece."""
    s = np.concatenate([np.zeros(1, np.uint8), *[raw_symbols(text[at : at + CHUNK]) for at in range(0, len(text), CHUNK)], np.zeros(1, np.uint8)])
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    s = s[keep]
    out = np.zeros(DIM, np.float64)
    for at in range(0, max(0, len(s) - 2), CHUNK):  # pieces share two symbols, so that each trigram is in one
        used, n = np.unique(_codes(s[at : at + CHUNK + 2]), return_counts=True)
        for i in range(0, len(used), 2048):
            out += n[i : i + 2048].astype(np.float64) @ ngram_vectors(used[i : i + 2048]).astype(np.float64)
    return out, int((s > 0).sum())


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """bundle() in slices of bounded size: few texts at once, and a very long text by itself."""
    sums, letters = np.zeros((len(texts), DIM), np.float64), np.zeros(len(texts), np.int64)
    batch: list[int] = []
    size = 0

    def flush() -> None:
        if batch:
            sums[batch], letters[batch] = bundle([texts[i] for i in batch])
            batch.clear()

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > CHUNK:
            sums[i], letters[i] = bundle_long(t)
            continue
        if len(batch) == 64 or size + len(t) > CHUNK:
            flush()
            size = 0
        batch.append(i)
        size += len(t)
    flush()
    return sums, letters


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def labelled(docs: DataFrame) -> DataFrame | None:
    """text and lang of all rows to learn from. None where no row has a label."""
    rows = docs.where(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    return None if rows.isEmpty() else rows


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each language: the sum of its documents' unit bundles, rounded to 1/4096.

    docs: doc_id, text, lang. Rows whose fold is held out, and null ids, texts or languages take no
    part; texts without a letter add nothing. All other rows are taken, repeated ones each time. An empty
    table teaches nothing. The driver holds a prototype for each value of lang.
    """
    rows = labelled(docs)
    if rows is None:
        return {}

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in chunks(batches, "text", 1 << 20):
            sums, letters = bundles(b.column("text").to_pylist())
            whole = np.rint(unit(sums) * 4096).astype(np.int64)
            langs = np.array(b.column("lang").to_pylist(), object)
            for k in set(langs):
                total[k] = total.get(k, 0) + whole[(langs == k) & (letters > 0)].sum(axis=0)
        if total:
            i = pa.array(np.tile(np.arange(DIM, dtype=np.int32), len(total)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(total), DIM).tolist(), pa.string()), i, pa.array(np.concatenate(list(total.values())))], ["lang", "i", "x"])

    got = rows.mapInArrow(run, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in got.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect():  # DIM values for each language
        v = np.array([x["x"] for x in r["v"]], np.float64)
        if v.any():
            out[r["lang"]] = v
    return out


def least_levels(docs: DataFrame, prototypes: dict[str, np.ndarray], quantile: float = 0.001) -> dict[str, float]:
    """The level below which a text is not of a language, fitted on the documents that learn() takes.

    A text's level is its bundle's projection on the unit prototype for each letter: the same for
    short and long texts of a language, and about 0 for random letters. A document's own part of the
    prototype is left out. The least level is a low quantile of the language's documents, but at
    least a quarter of their median (else labelled junk would let junk through) and at most half of
    it. A language of one document has no level to go by: 0. Levels are counted in steps of 1/LEVEL_STEPS, so
    that what a language's quantiles are taken from doesn't grow with its documents.
    """
    rows = labelled(docs) if prototypes else None
    if rows is None:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)

    def run(batches):
        prototypes = shared.value
        for b in chunks(batches, "text", 1 << 20):
            sums, letters = bundles(b.column("text").to_pylist())
            langs = np.array(b.column("lang").to_pylist(), object)
            for k in sorted(set(langs) & prototypes.keys()):
                own = sums[at := (langs == k) & (letters > 0)]
                others = prototypes[k] - np.rint(unit(own) * 4096)
                level = (own * unit(others)).sum(axis=1) / letters[at]
                level = level[others.any(axis=1)]
                step, n = np.unique(np.rint(level * LEVEL_STEPS).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(step), pa.string()), pa.array(step), pa.array(n.astype(np.int64))], ["lang", "step", "n"])

    steps = rows.mapInArrow(run, "lang string, step long, n long").groupBy("lang", "step").agg(F.sum("n").alias("n"))
    level = F.col("step") / F.lit(float(LEVEL_STEPS))
    got = steps.groupBy("lang").agg(F.percentile(level, F.array(F.lit(quantile), F.lit(0.5)), F.col("n")).alias("q"))
    fitted = {r["lang"]: float(np.clip(r["q"][0], r["q"][1] / 4, r["q"][1] / 2)) if r["q"][1] > 0 else 0.0 for r in got.collect()}
    return {k: fitted.get(k, 0.0) for k in prototypes}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], add: tuple[str, str] = ("lang_pred", "score"), least: dict[str, float] | None = None) -> DataFrame:
    """docs (text among its columns) with the language of the nearest prototype and its cosine, 0 to 1.

    Null texts and texts without a letter, and all texts where nothing was learned, are `und` with
    score 0. Prototypes are first centred on their mean, so that what languages share doesn't count;
    ties go to the language first in order. With `least` (least_levels), texts below their language's
    least level by more than two deviations of as many random letters are `und`, too: the centred cosine
    can't tell, since the nearest of centred prototypes is never at an obtuse angle.
    """
    bounded_batches(docs.sparkSession)
    names = sorted(prototypes)
    profile = np.array([unit(prototypes[k]) for k in names]).reshape(len(names), DIM)
    mean = profile.mean(axis=0) if len(names) > 1 else np.zeros(DIM)
    centred = unit(profile - mean)
    floor = None if least is None else np.array([least[k] for k in names])
    shared = docs.sparkSession.sparkContext.broadcast((centred, mean, profile, floor))

    def run(batches):
        centred, mean, profile, floor = shared.value
        for b in chunks(batches, "text", 1 << 20):
            sums, letters = bundles(b.column("text").to_pylist())
            cosine = unit(unit(sums) - mean) @ centred.T if len(names) else np.zeros((len(sums), 1))
            best = cosine.argmax(axis=1)
            known = (letters > 0) & (len(names) > 0)
            if floor is not None and len(names):
                n = np.maximum(letters, 1)
                known &= (sums * profile[best]).sum(axis=1) / n >= floor[best] - 2 / np.sqrt(n)
            lang = [names[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip((1 + cosine[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *add])

    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema], T.StructField(add[0], T.StringType()), T.StructField(add[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from docs' own labels.

    Null ids are never held out; repeated rows each get their own row. Null, empty and letterless texts
    are `und` with score 0, as are all where no row has a label. Texts count whole at any length. An
    empty table gives no row. Other columns of docs are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    prototypes = learn(docs)
    out = predict(docs.select("doc_id", "text"), prototypes)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`."""
    return identify(columns_first(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang"))
