"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, exactdup, langid, linededup, lm, neardup, packing, pii, resample, topk, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_linededup": linededup.op1_linededup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_lm": lm.op3_lm,
        "op4_langid": langid.op4_langid,
        "op5_ann": ann.op5_ann,
        "op6_bpe": bpe.op6_bpe,
        "op7_topk": topk.op7_topk,
        "op8_neardup": neardup.op8_neardup,
        "op9_packing": packing.op9_packing,
        "op10_pii": pii.op10_pii,
        "op11_trie": trie.op11_trie,
        "op12_exactdup": exactdup.op12_exactdup,
        "op13_resample": resample.op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_linededup": linededup.OP1_SQL,
        "op3_lm": lm.OP3_SQL,
        "op7_topk": topk.OP7_SQL,
        "op11_trie": trie.OP11_SQL,
        "op12_exactdup": exactdup.OP12_SQL,
        "op13_resample": resample.OP13_SQL,
    }
