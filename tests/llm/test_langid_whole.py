from pyspark.sql import functions as F

from tessera.llm import langid


def test_every_labelled_row_counts(spark):
    """Prototypes and least levels come from all rows that may be learned from, not from some 6,000 a language."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ab"), F.chr(97 + F.col("id") % 26)).alias("text"), F.lit("x").alias("lang"))
    rows = docs.where(~langid.held_out(F.col("doc_id"))).select("text").collect()
    assert len(rows) > 8000
    sums, _ = langid.bundles([r.text for r in rows])
    learned = langid.learn(docs)
    want = sum((int(v) for v in langid.np.rint(langid.unit(sums) * 4096)[:, 0]), 0)
    assert abs(learned["x"][0] - want) < 0.02 * abs(want)  # the last text of a batch has one trigram more
    own = langid.np.rint(langid.unit(sums) * 4096)
    level = (sums * langid.unit(learned["x"] - own)).sum(axis=1) / 3
    low, mid = langid.np.quantile(level, 0.001), langid.np.quantile(level, 0.5)
    assert abs(langid.least_levels(docs, learned)["x"] - float(langid.np.clip(low, mid / 4, mid / 2))) < 0.01
