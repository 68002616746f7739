"""Token counts: texts are encoded in batches inside of Arrow functions, and only lengths come back.

Long texts are split where a pre-token must end: before white space that
follows anything else, and where letters or digits meet anything but their
own kind. No alternative of the byte-level pre-tokenizer's pattern spans such
a place, so the counts of the pieces add up exactly; only an unbroken run of
letters, digits or signs stays whole. Pieces go into batches of about equal
bytes, so that a batch's cost doesn't depend on how long its texts are; Arrow
batches are cut by bytes as well.

The vocabulary file's bytes are broadcast, so executors need no file of their
own; each Python worker builds the encoder once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, pick, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE, BATCH, ARROW = 1 << 15, 1 << 18, 16 << 20
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")
SCHEMA = "doc_id long, n_tokens long, n_bytes long"

_built: dict[str, tiktoken.Encoding] = {}


def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    key = hashlib.sha1(vocabulary).hexdigest()
    if key not in _built:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _built[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _built[key]


def pieces(text: str, most: int = PIECE) -> list[str]:
    """text in pieces of most characters or a little more, cut at safe places only."""
    out, start = [], 0
    while len(text) - start > most:
        m = _SAFE.search(text, start + most)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def balanced(sizes: list[int], most: int = BATCH) -> list[list[int]]:
    """Indices of sizes in batches of about equal sums: largest first, each into the least full batch."""
    n = max(1, -(-sum(sizes) // most))
    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        total, k = heap[0]
        out[k].append(i)
        heapq.heapreplace(heap, (total + sizes[i], k))
    return [b for b in out if b]


def lengths(enc: tiktoken.Encoding, texts: list[str | None]) -> list[int | None]:
    """Tokens of each text; None for None, 0 for an empty text."""
    count: list[int | None] = [None if t is None else 0 for t in texts]
    parts = [(i, p, len(p) if p.isascii() else len(p.encode("utf-8", "replace"))) for i, t in enumerate(texts) if t for p in pieces(t)]
    for batch in balanced([n for _, _, n in parts]):
        for k, ids in zip(batch, enc.encode_ordinary_batch([parts[k][1] for k in batch], num_threads=1)):
            count[parts[k][0]] += len(ids)
    return count


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a row of docs: doc_id, n_tokens, n_bytes.

    Special tokens' strings count as ordinary text. A null text gives nulls, an
    empty one zeros; repeated rows are each counted; a null doc_id stays null.
    Texts of any length are counted whole, in pieces. Further columns of docs are left out; an empty table gives no rows.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for b in batches(it, ARROW):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lengths(enc, b["text"].to_pylist()), pa.int64()), b["n_bytes"]], ["doc_id", "n_tokens", "n_bytes"])

    src = pick(docs, doc_id="doc_id", text="text")
    return src.select(F.col("doc_id").cast("long"), "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(run, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
