"""Corpus pipeline: documents to packed training sequences, each stage by one operator of tessera.llm.

Every stage but the last returns the columns of documents, whatever else their names are. Null,
empty and very long texts, null and repeated ids, repeated rows and empty tables go through all
stages; each says what it makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, linededup, neardup, packing, pii
from tessera.llm.common import unused


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars (where docs has it) follows the text; that of a null text stays."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: null, empty and letterless texts, and texts in no learned language.

    Where docs has no label to learn from, all stay. Null ids are learned from never and judged like
    others; repeated rows share their fate.
    """
    own = docs.select("doc_id", "text", "lang")
    prototypes = langid.learn(own)
    if not prototypes:
        return docs
    found, score = unused(docs, "__lang__"), unused(docs, "__score__")
    out = langid.predict(docs, prototypes, add=(found, score), least=langid.least_levels(own, prototypes))
    return out.where(F.col(found) != langid.UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays, a text that was all boilerplate as an empty one, a null text as null."""
    return _sized(linededup.drop_boilerplate(docs, count=None))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays: that of the smallest id, then text hash; a row without an id only where none has one.

    Texts without a word are like no other text; of repeated rows one stays.
    """
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become placeholders; every row stays, null and empty texts as they are."""
    return _sized(pii.mask(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is tokenised, cut where it has more than 1024 ids, and packed into sequences of at most 1024; a null text is the end id alone."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Hyperdimensional scores, signatures and tokenisation have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the whole table documents, one after the other; a row for each packed piece. No documents give no piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
