"""Removal of toxic passages: texts are chunked, chunks scored by a model behind a protocol, and the toxic ones left out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS: dict[str, dict[str, str]] = {
    "nl": {"LABEL_0": "Acceptable", "LABEL_1": "Inappropriate", "LABEL_2": "Offensive", "LABEL_3": "Violent"},
    "en": {"LABEL_0": "Acceptable", "LABEL_1": "Toxic"},
}


class PassageScorer(Protocol):
    def score(self, chunks: Sequence[str], language: str) -> list[tuple[str, float]]: ...


class Lexicon:
    """The offline stand-in: LABEL_1 with the share of listed words (at least one makes it toxic), else LABEL_0."""

    def __init__(self, words: Mapping[str, Sequence[str]]) -> None:
        self.words = {k: frozenset(w.lower() for w in v) for k, v in words.items()}

    def score(self, chunks: Sequence[str], language: str) -> list[tuple[str, float]]:
        bad = self.words.get(language, frozenset())
        out = []
        for c in chunks:
            w = re.findall(r"\w+", c.lower())
            n = sum(x in bad for x in w)
            out.append(("LABEL_1", n / len(w)) if n else ("LABEL_0", 1.0))
        return out


def passages(text: str, limit: int = 512, measure: Callable[[str], int] = lambda t: len(t.split())) -> list[str]:
    """Chunks of at most limit, by paragraphs, lines, sentences, words, then characters, coarsest first; adjacent small ones joined."""

    def cut(t: str, seps: Sequence[str]) -> list[str]:
        if measure(t) <= limit or len(t) < 2:
            return [t]
        if not seps:
            half = len(t) // 2
            return cut(t[:half], ()) + cut(t[half:], ())
        parts = re.split(f"(?<={seps[0]})", t)
        out: list[str] = []
        for p in (x for part in parts if part for x in (cut(part, seps[1:]) if len(parts) == 1 or measure(part) > limit else [part])):
            if out and measure(out[-1] + p) <= limit:
                out[-1] += p
            else:
                out.append(p)
        return out

    return [p.strip() for p in cut(text, ("\n\n", "\n", r"[.!?]\s", r"\s")) if p.strip()]


_RECORD = pa.struct([("label", pa.string()), ("score", pa.float64()), ("sentence", pa.string()), ("start_index", pa.int32())])


def remove_toxic(df: DataFrame, make: Callable[[], PassageScorer], text: str = "text", lang: str = "lang", threshold: float = 0.0, max_chunk_length: int = 512, metadata: str = "toxic_language", measure: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """text without the chunks whose label isn't LABEL_0 and whose score is above threshold, the rest joined by spaces.

    metadata records what went: label, score, sentence, start_index (the sum of
    the lengths of the chunks before). Always written: where nothing went or
    the language isn't read, a placeholder of nulls stands. Such texts stay as
    they are; so do null ones. Chunks are measured in words, or by what measure
    makes once a worker: a count of the model's tokens.
    """
    kind = "array<struct<label:string,score:double,sentence:string,start_index:int>>"
    schema = df.withColumn(metadata, F.lit(None).cast(kind)).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        size = measure() if measure else lambda t: len(t.split())
        for b in it:
            texts, langs, meta = b[text].to_pylist(), b[lang].to_pylist(), []
            for k, (t, l) in enumerate(zip(texts, langs)):
                gone: list[dict] = []
                if t and l in LABELS:
                    chunks, rest, at = passages(t, max_chunk_length, size), [], 0
                    for c, (label, score) in zip(chunks, model.score(chunks, l)):
                        if label != "LABEL_0" and score > threshold:
                            gone.append({"label": LABELS[l].get(label, "Unknown"), "score": score, "sentence": c, "start_index": at})
                        else:
                            rest.append(c)
                        at += len(c)
                    if gone:
                        texts[k] = " ".join(rest)
                meta.append(gone or [dict.fromkeys(("label", "score", "sentence", "start_index"))])
            cols = [pa.array(texts, pa.string()) if n == text else b[n] for n in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(meta, pa.list_(_RECORD))], [*b.schema.names, metadata])

    return df.mapInArrow(run, schema)


def remove_listed_lines(df: DataFrame, words: Mapping[str, Sequence[str]], text: str = "text", lang: str = "lang") -> DataFrame:
    """The same with lines as chunks and a word list as the model, natively: text, n_removed, removed."""
    lines = F.split(F.col(text), "\n", -1)
    hit = None

    def listed(ws: Sequence[str]) -> Callable[[Column], Column]:
        return lambda x: F.lower(x).rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(ws) + r")([^\p{L}\p{N}_]|$)")

    def parted(has: Callable[[Column], Column]) -> Column:
        return F.struct(F.filter(lines, lambda x: ~has(x)).alias("rest"), F.filter(lines, has).alias("gone"))

    for l, ws in words.items():
        one = parted(listed(ws))
        hit = F.when(F.col(lang) == l, one) if hit is None else hit.when(F.col(lang) == l, one)
    out = df.withColumn("__x", hit)
    gone = F.coalesce(F.size(F.col("__x")["gone"]), F.lit(0))
    return out.withColumn("n_removed", gone).withColumn("removed", F.coalesce(F.col("__x")["gone"], F.array().cast("array<string>"))).withColumn(text, F.when(gone > 0, F.array_join(F.col("__x")["rest"], " ")).otherwise(F.col(text))).drop("__x")
