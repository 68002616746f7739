"""What every step offers: annotate(df) adds statistics and a reason, apply(df) divides into kept and excluded rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import n_tokens, tokens
from ..functions.treebank import treebank_tokens


@dataclass(frozen=True, kw_only=True)
class Filter:
    """A row filter. Statistics go to the column `name`, the first failing rule to `name`_reason (null: keep).

    With do_filter=False, statistics are computed and every row is kept. Where
    a column `name` is there already, it is taken as the statistics. A null
    text has null statistics and is kept, as comparisons with null fail.
    """

    text: str = "text"
    lang: str = "lang"
    do_filter: bool = True
    tokenizer: str = "unicode"
    name = "filter"

    def tokens(self, c: Column) -> Column:
        """Words by the native expression, or by Treebank conventions in Arrow batches."""
        if self.tokenizer not in ("unicode", "treebank"):
            raise ValueError("tokenizer must be unicode or treebank")
        return treebank_tokens(c) if self.tokenizer == "treebank" else tokens(c)

    def n_tokens(self, c: Column) -> Column:
        return n_tokens(c) if self.tokenizer == "unicode" else F.size(self.tokens(c))

    def prepare(self, df: DataFrame) -> DataFrame:
        """Arrays that several statistics need, as columns whose names start with __."""
        return df

    def stats(self) -> Column:
        raise NotImplementedError

    def rules(self, s: Column) -> list[tuple[Column | None, str]]:
        raise NotImplementedError

    def held(self, df: DataFrame, only: Sequence[str] = ()) -> DataFrame:
        """df with the statistics, or only some of them, computed once a row.

        A generator stands between them and what uses them: the optimizer
        would otherwise write them out again for each use, and for a filter on
        the reason below the projection.
        """
        out = self.prepare(df)
        keep = [c for c in out.columns if not c.startswith("__")]
        s = self.stats()
        if only:
            s = F.struct(*(s[c].alias(c) for c in only))
        return out.select(*keep, F.explode(F.array(s)).alias(self.name))

    @property
    def reason(self) -> str:
        return f"{self.name}_reason"

    def annotate(self, df: DataFrame) -> DataFrame:
        out = df
        if self.name not in df.columns:
            out = self.held(df)
        whens = [F.when(cond, F.lit(why)) for cond, why in self.rules(F.col(self.name)) if cond is not None] if self.do_filter else []
        out = out.withColumn(self.reason, F.coalesce(*whens, F.lit(None).cast("string")) if whens else F.lit(None).cast("string"))
        return out

    def apply(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(kept with the columns of df, excluded with them and drop_reason)."""
        out = self.annotate(df)
        return out.where(F.col(self.reason).isNull()).select(*df.columns), out.where(F.col(self.reason).isNotNull()).select(*df.columns, F.col(self.reason).alias("drop_reason"))

    def counts(self, df: DataFrame) -> DataFrame:
        """(reason, n): rows by reason, null for kept ones."""
        return self.annotate(df).groupBy(F.col(self.reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def over(c: Column, limit: float | None) -> Column | None:
    """c > limit; no rule where the limit is None or 0."""
    return (c > limit) if limit else None


def under(c: Column, limit: float | None) -> Column | None:
    return (c < limit) if limit else None
