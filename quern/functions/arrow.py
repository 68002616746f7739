"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import TypeVar

import pyarrow as pa

Rows = TypeVar("Rows", pa.RecordBatch, pa.Array)
PART = 2 << 20


def parts(it: Iterable[Rows], most_bytes: int = PART) -> Iterator[Rows]:
    """Batches or arrays, those of more bytes in halves, down to one row. Empty ones are left out."""
    for b in it:
        todo = [b] if len_(b) else []
        while todo:
            x = todo.pop()
            if len_(x) > 1 and x.nbytes > most_bytes:
                h = len_(x) // 2
                todo += [x.slice(h), x.slice(0, h)]
            else:
                yield x


def len_(x: Rows) -> int:
    return x.num_rows if isinstance(x, pa.RecordBatch) else len(x)
