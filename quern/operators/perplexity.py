"""Perplexity as a corpus statistic, by a language model that is counted with Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, tokens


class LanguageModel(Protocol):
    def perplexity(self, text: str) -> float: ...


#: Words whose probabilities every task holds: some 10 MB.
FREQUENT = 1 << 17


def unigram_perplexity(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", alpha: float = 1.0, most: int = FREQUENT) -> DataFrame:
    """(id, lang, perplexity) under the add-alpha unigram model of the document's own language in df.

    Words are counted first. The most frequent ones, FREQUENT at most, are
    broadcast with their probabilities, so most words of a text are summed up
    where they are read; only the rest, few in any text, move to be counted.
    Documents without a word have none and are left out.
    """
    spark = df.sparkSession
    words = df.where(F.col(lang).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang).alias("__lang"), F.explode(tokens(F.lower(F.col(text)))).alias("w"))
    model = words.groupBy("__lang", "w").agg(F.count(F.lit(1)).alias("c")).persist()
    try:
        size = spark.createDataFrame(model.groupBy("__lang").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("vocabulary")).toArrow())
        lp = F.log((F.col("c") + alpha) / (F.col("total") + alpha * F.col("vocabulary")))
        frequent = spark.createDataFrame(model.where(F.length("w") <= 100).orderBy(F.desc("c")).limit(most).join(F.broadcast(size), "__lang").select("__lang", "w", lp.alias("lp")).toArrow())
    finally:
        model.unpersist()
    rare = F.when(F.col("lp").isNull(), F.col("w"))
    seen = words.join(F.broadcast(frequent), ["__lang", "w"], "left").groupBy("__id", "__lang", rare.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("lp").alias("s"))
    # all occurrences of a rare word are here, so its count is theirs; what is summed up already stays by document
    counted = seen.withColumn("c", F.sum("n").over(Window.partitionBy("__lang", "w", F.when(F.col("w").isNull(), F.col("__id")))))
    scored = counted.join(F.broadcast(size), "__lang").select("__id", "__lang", "n", F.coalesce("s", F.col("n") * lp).alias("s"))
    return scored.groupBy("__id", "__lang").agg(F.exp(-F.sum("s") / F.sum("n")).alias("perplexity")).toDF(id_col, lang, "perplexity")


def model_perplexity(df: DataFrame, models: dict[str, Callable[[], LanguageModel]], text: str = "text", lang: str = "lang", fallback: str = "dutch") -> DataFrame:
    """df with perplexity and perplexity_key, "perplexity_<language>": models by language name, the fallback's for all others."""
    schema = df.withColumn("perplexity_key", F.lit("").cast("string")).withColumn("perplexity", F.lit(None).cast("double")).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, LanguageModel] = {}
        for b in it:
            keys, values = [], []
            for t, l in zip(b[text].to_pylist(), b[lang].to_pylist()):
                name = LANGUAGES.get(l or "", fallback)
                name = name if name in models else fallback
                if name not in loaded:
                    loaded[name] = models[name]()
                keys.append(f"perplexity_{name}")
                values.append(loaded[name].perplexity(t) if t else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string()), pa.array(values, pa.float64())], [*b.schema.names, "perplexity_key", "perplexity"])

    return df.mapInArrow(run, schema)


def summary(df: DataFrame, value: str = "perplexity", by: str = "lang") -> DataFrame:
    c = F.col(value)
    return df.groupBy(by).agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_dev"))


def histogram(df: DataFrame, value: str = "perplexity", digits: int = 3) -> DataFrame:
    return df.groupBy(F.round(value, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values of key: a report, so limited."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def detect_language(df: DataFrame, profiles: dict[str, list[str]], text: str = "text", lang: str = "lang") -> DataFrame:
    """lang filled where it is null: the language whose list of frequent words has most of the text's words; null if none has any."""
    toks = tokens(F.lower(F.col(text)))

    def hits(ws: list[str]) -> Column:
        return F.size(F.filter(toks, lambda w: w.isin(ws)))

    scores = F.array(*(F.struct(hits(ws).alias("n"), F.lit(l).alias("l")) for l, ws in sorted(profiles.items(), reverse=True)))
    best = F.array_max(scores)
    return df.withColumn(lang, F.coalesce(F.col(lang), F.when(best["n"] > 0, best["l"])))
