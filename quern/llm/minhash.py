"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

A document's set is that of the hashes of its runs of SHINGLE words. Each
hash goes into one of BINS bins by its high bits, and a bin keeps its
smallest rest: every shingle is hashed once. An empty bin takes the value of
the first bin that isn't empty in a sequence of bins drawn by a universal
hash of its number and the attempt (optimal densification), the same for all
documents. Of each value the lowest BITS bits of its hash are stored.

Two values that differ agree in their low bits with probability 2**-BITS, so
a share m of equal stored values estimates a Jaccard similarity of
(m - 2**-BITS) / (1 - 2**-BITS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
import pandas as pd

from .common import batches, chunks, pick, table
from .kernel import U64, mix, windows, words

SHINGLE, BINS, BITS = 5, 128, 8
_CHUNK = 1 << 20
SCHEMA = "doc_id long, n_shingles int, n_filled int, fingerprint binary"


def sequence(bins: int, attempt: int) -> np.ndarray:
    """The bin that each bin turns to at this attempt."""
    return (mix(np.arange(bins, dtype=U64) * U64(0x10001) + U64(attempt), 7) % U64(bins)).astype(np.int64)


def densify(values: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """values, by text and bin, with every empty bin of a text that has any value filled."""
    values = values.copy()
    left = empty & ~empty.all(1, keepdims=True)
    attempt = 1
    while True:
        row, bin_ = np.nonzero(left)
        if not len(row):
            return values
        src = sequence(values.shape[1], attempt)[bin_]
        ok = ~empty[row, src]
        values[row[ok], bin_[ok]] = values[row[ok], src[ok]]
        left[row[ok], bin_[ok]] = False
        attempt += 1


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> tuple[list[int], list[int], list[bytes | None]]:
    """Distinct shingles, filled bins and packed fingerprint of each text; no fingerprint where there is no word."""
    if bins & (bins - 1) or bits not in (1, 2, 4, 8, 16):
        raise ValueError("bins must be a power of two, bits one of 1, 2, 4, 8, 16")
    n_sh: list[int] = []
    n_fill: list[int] = []
    out: list[bytes | None] = []
    top = U64(64 - (bins.bit_length() - 1))
    for s, e in chunks(texts, _CHUNK):
        h, doc = windows(words(texts[s:e]), shingle)
        n = e - s
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
        h, doc = h[new], doc[new]
        slot = doc * bins + (h >> top).astype(np.int64)
        # sorted by text and hash: a bin's first is its smallest
        first = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, bool)
        values = np.zeros(n * bins, U64)
        empty = np.ones(n * bins, bool)
        values[slot[first]], empty[slot[first]] = h[first], False
        values, empty = values.reshape(n, bins), empty.reshape(n, bins)
        low = mix(densify(values, empty), 11) & U64((1 << bits) - 1)
        if bits >= 8:
            packed = low.astype("<u2" if bits == 16 else np.uint8)
        else:
            per = 8 // bits
            packed = (low.astype(np.uint8).reshape(n, bins // per, per) << (np.arange(per, dtype=np.uint8) * bits)).sum(2, dtype=np.uint8)
        filled = bins - empty.sum(1)
        n_sh += np.bincount(doc, minlength=n).tolist()
        n_fill += filled.tolist()
        out += [r.tobytes() if f else None for r, f in zip(packed, filled)]
    return n_sh, n_fill, out


def unpack(fp: bytes, bits: int = BITS) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(fp, "<u2")
    a = np.frombuffer(fp, np.uint8)
    per = 8 // bits
    return a if per == 1 else ((a[:, None] >> (np.arange(per, dtype=np.uint8) * bits)) & ((1 << bits) - 1)).ravel()


def estimate(a: bytes | None, b: bytes | None, bits: int = BITS) -> float | None:
    """The bias-corrected Jaccard estimate, from 0 to 1; None if either is None."""
    if a is None or b is None:
        return None
    chance = 2.0**-bits
    return float(max(0.0, (np.mean(unpack(a, bits) == unpack(b, bits)) - chance) / (1 - chance)))


def similarity(a: Column, b: Column, bits: int = BITS) -> Column:
    """estimate() of two fingerprint columns."""

    chance = 2.0**-bits

    @pandas_udf("double")
    def est(x: pd.Series, y: pd.Series) -> pd.Series:
        ok = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        p, q = (np.stack([unpack(v, bits) for v in c[ok]]) if ok.any() else np.zeros((0, 1)) for c in (x, y))
        out[ok] = np.maximum(0.0, ((p == q).mean(1) - chance) / (1 - chance))
        return pd.Series(out).where(ok, None)

    return est(a, b)


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, n_filled, fingerprint of bins * bits / 8 bytes.

    A text of fewer words than a shingle has one shingle of all its words; a
    null text, an empty one or one without a word has none and a null
    fingerprint. Repeated rows each get the same; a null doc_id stays null.
    Further columns of docs are left out; an empty table gives no rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 16 << 20):
            n, f, p = fingerprints(b["text"].to_pylist(), shingle, bins, bits)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int32()), pa.array(f, pa.int32()), pa.array(p, pa.binary())], ["doc_id", "n_shingles", "n_filled", "fingerprint"])

    return pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)


def op8_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
