"""The corpus pipeline: five stages, each over all that the one before kept, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, linededup, packing, simhash, toxicity
from quern.llm.common import drop_settled, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Toxic documents go; blocks of lines that an earlier document has go; of near-duplicates one stays; documents with
#: stretches of the benchmark go; what is left is packed into bins. All but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity.stage),
    ("line_dedup", linededup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontamination", decontam.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL has neither zstandard dictionaries nor alignment; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
            if k:
                drop_settled(before)
    return docs
