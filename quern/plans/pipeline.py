"""A list of steps, run lazily over one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.step import Filter

Step = Filter | Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Filters divide, other steps transform. excluded holds what each filter dropped, counters a count of the rows before each step.

    Counters are observed while the result is computed, so no step is run for
    them; counts() may be called once an action has run.
    """

    steps: Sequence[Step]
    excluded: dict[str, DataFrame] = field(default_factory=dict)
    counters: dict[str, Observation] = field(default_factory=dict)

    def run(self, df: DataFrame) -> DataFrame:
        for k, step in enumerate(self.steps):
            name = f"{k}-{step.name if isinstance(step, Filter) else getattr(step, '__name__', 'step')}"
            if not df.isStreaming:
                self.counters[name] = Observation(name)
                df = df.observe(self.counters[name], F.count(F.lit(1)).alias("rows"))
            if isinstance(step, Filter):
                df, self.excluded[name] = step.apply(df)
            else:
                df = step(df)
        return df

    def counts(self) -> dict[str, int]:
        return {k: o.get["rows"] for k, o in self.counters.items()}
