"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, linededup, minhash, packing, simhash, tokens, toxicity, urlrules, warcindex

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    fs: list[Query] = [
        tokens.op1_token_counts,
        decontam.op2_decontamination,
        linededup.op3_line_dedup,
        urlrules.op4_url_filters,
        toxicity.op5_toxicity,
        simhash.op6_simhash_near_dedup,
        warcindex.op7_warc_index,
        minhash.op8_minhash_fingerprints,
        licenses.op9_license_scan,
        packing.op10_best_fit_packing,
    ]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    """The other operators' results, by compression, alignment, hashing or packing, are held against brute force in tests/llm."""
    return {"op4_url_filters": urlrules.oracle(), "op7_warc_index": warcindex.ORACLE}
