"""Steps over streams. All but those that combine rows are stateless projections and run unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Pipeline, Step


def curate(spark: SparkSession, source: str, sink: str, checkpoint: str, steps: Sequence[Step], schema: str | None = None) -> StreamingQuery:
    """Parquet files of source through the steps to Parquet files of sink, all that is there now; exactly once by the checkpoint."""
    schema_ = schema or spark.read.parquet(source).schema
    out = Pipeline(steps).run(spark.readStream.schema(schema_).parquet(source))
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def combine_stream(df: DataFrame, time: str, delay: str = "10 minutes", separator: str = "\n", text: str = "text") -> DataFrame:
    """combine_rows over a stream: parts with the same row_splitter_id and time, out once the watermark has passed."""
    part = F.struct("row_splitter_pos", F.col(text).alias("t"))
    rows = df.withWatermark(time, delay).groupBy("row_splitter_id", time).agg(F.collect_list(part).alias("p"))
    return rows.select("row_splitter_id", time, F.array_join(F.transform(F.array_sort("p"), lambda x: x["t"]), separator).alias(text))


def counts_by_window(df: DataFrame, time: str = "ts", size: str = "5 minutes", by: str = "event_type", delay: str = "10 minutes") -> DataFrame:
    return df.withWatermark(time, delay).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
