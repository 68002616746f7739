"""Readers and writers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id string, text string, url string, language string"


def parquet(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


#: Bytes of a file for each core below which a scan is spread over all of them.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's scan over as many parts as there are cores; a larger one as it is.

    A small file has one row group, and whatever follows would be one task's
    work. What is moved is SMALL bytes a core at most; larger tables come in
    many row groups and aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if SMALL // 16 < size < SMALL * cores else df


def documents(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """An in-memory source of (id, text, url, language)."""
    return spark.createDataFrame(list(rows), DOCUMENT)


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon-separated file with a header; every column a string."""
    return spark.read.option("sep", ";").option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def public_figures(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(name): labels and aliases, each once, of files with the columns label and aliases (joined by semicolons)."""
    df = spark.read.option("sep", ";").option("header", True).option("quote", '"').csv(path if isinstance(path, str) else list(path))
    names = F.array_union(F.array("label"), F.split(F.coalesce("aliases", F.lit("")), ";"))
    return df.select(F.explode(names).alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct()


def bad_words(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Lists by language from a folder of files named by language code, a word a line; empty lines are left out."""
    rows = spark.read.text(path).select(F.input_file_name().alias("f"), F.trim("value").alias("w")).where("w <> ''").distinct().collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(PurePath(r["f"]).stem, []).append(r["w"])
    return {k: sorted(v) for k, v in out.items()}


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_excluded(df: DataFrame, path: str) -> None:
    """Dropped rows, a folder for each reason."""
    df.write.mode("overwrite").partitionBy("drop_reason").parquet(path)
