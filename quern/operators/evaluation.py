"""Confusion metrics of predictions against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1 (0 where undefined), ratio of positives; best F1 first."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    counts = df.groupBy(*by).agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(~y & ~p).alias("tn"), n(y & ~p).alias("fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = counts.withColumn("precision", div(tp, tp + fp)).withColumn("recall", div(tp, tp + fn)).withColumn("f1", div(2 * tp, 2 * tp + fp + fn)).withColumn("ratio", div(tp + fn, tp + fp + tn + fn))
    return out.orderBy(F.desc("f1"), *by)


def rows_of(df: DataFrame, kind: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """The rows that are tp, fp, tn or fn."""
    y, p = {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}[kind]
    return df.where((F.col(label) == y) & (F.col(predicted) == p))
