"""Toxic documents by compression distance.

Two zstandard dictionaries are trained on labelled text. The segments that
enter a dictionary are runs of byte grams (of zstandard's minimum match
length, inside words) whose document frequency in the one class is many times
that in the other, by more than the best of as many grams would have by
chance, most frequent last, where zstandard matches best; so the toxic
dictionary shortens only what marks toxic text, and the ordinary one only what
marks ordinary text. zstandard's own trainer chooses what is frequent in a
class, not what sets it apart: README has the figures. Every window of about 64 bytes is compressed
with each. Its margin is ordinary minus toxic length; a document's score is
the sum of its margins of at least two bytes by the root of its word count.
The threshold is calibrated on held-out labelled documents: each half is
scored by dictionaries trained on the other half.

Both dictionaries end in a primer that each window starts with, so that
zstandard never falls back to a stored block and lengths stay comparable.

The classifier is fitted on at most max_labelled labelled documents per
class, those of the smallest hash of doc_id; everything else covers all
documents. Fitting on fewer than MIN_TOXIC toxic examples gives a model that
calls nothing toxic.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, drop_settled, pick, settle, table

GRAM = 5
MIN_TOXIC = 4
_BATCH = 16 << 20
PRIMER = bytes([*range(0, 9), 11, 12, *range(14, 23)]) * 2
_WORD = re.compile(r"\w+")

SCHEMA = "doc_id long, toxic boolean, score double, n_windows int, n_toxic_windows int, worst_margin int, worst_window string"


def norm(text: str | None) -> str:
    return " ".join(_WORD.findall(text.lower())) if text else ""


class Grams:
    """Labelled texts as sets of words, and their byte grams, all as numbers."""

    def __init__(self, texts: list[str], toxic: list[bool]) -> None:
        ids: dict[str, int] = {}
        self.docs = [np.unique([ids.setdefault(w, len(ids)) for w in _WORD.findall(t.lower())]).astype(np.int64) for t in texts]
        self.toxic = toxic
        self.words = [f" {w} ".encode("utf-8", "replace") for w in ids]
        self.hash = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest()) for w in self.words], np.uint64)
        self.kept = self.thin()
        # grams of each word, in order
        self.ids: dict[bytes, int] = {}
        flat = [[self.ids.setdefault(w[k : k + GRAM], len(self.ids)) for k in range(len(w) - GRAM + 1)] for w in self.words]
        self.start = np.concatenate(([0], np.cumsum([len(g) for g in flat]))).astype(np.int64)
        self.flat = np.fromiter((x for g in flat for x in g), np.int64, int(self.start[-1]))
        self.names = list(self.ids)

    def of(self, words: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.flat[self.start[w] : self.start[w + 1]] for w in words.tolist()])) if len(words) else np.zeros(0, np.int64)

    def frequency(self, docs: list[int]) -> np.ndarray:
        """Texts by gram."""
        c = np.zeros(len(self.ids), np.int64)
        for d in docs:
            c[self.of(self.docs[d])] += 1
        return c

    def thin(self) -> list[int]:
        """Texts without near copies, so that no copied passage looks like a mark of its class."""
        seen: dict[tuple[bool, int], list[int]] = defaultdict(list)
        kept = []
        for d, w in enumerate(self.docs):
            if not len(w):
                continue
            keys = [(self.toxic[d], int(h)) for h in np.sort(self.hash[w])[:4]]
            if any(len(np.intersect1d(w, self.docs[o], True)) > 0.5 * min(len(w), len(self.docs[o])) for o in {o for k in keys for o in seen[k]}):
                continue
            for k in keys:
                seen[k].append(d)
            kept.append(d)
        return kept

    def segments(self, own: list[int], other: list[int], ratio: float, least: int) -> tuple[bytes, bytes]:
        """What marks own against other, rarest first: runs of marking grams.

        And of the grams in these runs those that other has as well: in the
        other dictionary, they make up for matches that mark nothing.
        """
        a, b = self.frequency(own), self.frequency(other)
        # Chernoff's bound of the chance that so many of a gram's texts are own ones, if it marked nothing, is below one in all grams
        n, p = np.maximum(a + b, 1), len(own) / max(1, len(own) + len(other))
        with np.errstate(divide="ignore", invalid="ignore"):
            chance = a * np.log(a / n / p) + np.where(b > 0, b * np.log(b / n / (1 - p)), 0.0)
            marks = (a >= least) & (a > ratio * (b + 0.4) * len(own) / max(1, len(other))) & (chance > np.log((a > 0).sum()))
        has = np.zeros(len(self.words), bool)
        has[np.repeat(np.arange(len(self.words)), np.diff(self.start))[marks[self.flat]]] = True
        runs_of: dict[int, set[bytes]] = {}
        for k in np.flatnonzero(has).tolist():
            w = self.words[k]
            covered = bytearray(len(w))
            for g in self.flat[self.start[k] : self.start[k + 1]]:
                if marks[g]:
                    name = self.names[g]
                    at = w.find(name)
                    while at >= 0:
                        covered[at : at + len(name)] = b"\1" * len(name)
                        at = w.find(name, at + 1)
            runs_of[k] = {w[m.start() : m.end()] for m in re.finditer(b"\1+", covered)}
        found: Counter[bytes] = Counter()
        for d in own:
            found.update({r for k in self.docs[d][has[self.docs[d]]].tolist() for r in runs_of[k]})
        runs = [s for s, n in sorted(found.items(), key=lambda x: (x[1], x[0])) if n >= 2]
        inner = {self.ids[s[i : i + GRAM]] for s in runs for i in range(len(s) - GRAM + 1)}
        inner = sorted((g for g in inner if b[g] and not marks[g]), key=lambda g: (b[g], self.names[g]))
        return b"\n".join(runs), b"\n".join(self.names[g] for g in inner)


def coder(dictionary: bytes):
    """bytes -> compressed length with this raw dictionary, by a setting that stores literals as they are."""
    p = zstandard.ZstdCompressionParameters(
        window_log=10 if len(dictionary) < 512 else max(10, len(dictionary).bit_length()), hash_log=14, chain_log=6, search_log=1,
        min_match=GRAM, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: float
    window: int = 64
    floor: int = 2
    held_out: dict | None = None

    def scorer(self):
        if self.threshold == float("inf"):
            return lambda text: (0.0, 0, 0, 0, None)
        a, b, size, floor = coder(self.ordinary), coder(self.toxic), self.window, self.floor
        cut = re.compile(rb"[^ ].{0,%d}(?= )|[^ ]+" % (size - 1), re.DOTALL)

        def score(text: str | None) -> tuple[float, int, int, int, bytes | None]:
            t = norm(text)
            if not t:
                return 0.0, 0, 0, 0, None
            total = hits = worst = n = 0
            where = None
            for w in cut.findall(t.encode("utf-8", "replace") + b" "):
                n += 1
                x = PRIMER + b" " + w + b" "
                m = len(a(x)) - len(b(x))
                if m >= floor:
                    total += m
                    hits += 1
                    if m > worst:
                        worst, where = m, w
            return total / (t.count(" ") + 1) ** 0.5, n, hits, worst, where

        return score


def fit(texts: list[str], toxic: list[bool], ratio: float = 25.0, least: int = 3, window: int = 64, weight: float = 1.0) -> Model:
    """Trains on labelled texts; half of them, by order, calibrates what the other half trains.

    weight: how many ordinary documents one ordinary text stands for, against a toxic one.
    """

    if sum(toxic) < MIN_TOXIC:
        return Model(b"", b"", float("inf"), window)
    grams = Grams(texts, toxic)

    def train(docs: list[int]) -> Model:
        own, other = [d for d in docs if toxic[d]], [d for d in docs if not toxic[d]]
        if not own:
            return Model(b"", b"", float("inf"), window)
        low = least if len(own) >= 40 else 2
        marks, shared = grams.segments(own, other, ratio, low)
        ordinary, also = grams.segments(other, own, ratio, max(low, len(other) // 50))
        return Model(also + b"\n" + marks + b"\n" + PRIMER, ordinary + b"\n" + shared + b"\n" + PRIMER, 0.0, window)

    scored = []
    for fold in (0, 1):
        s = train([i for i in grams.kept if i % 2 != fold]).scorer()
        scored += [(s(texts[i])[0], toxic[i]) for i in range(len(texts)) if i % 2 == fold]
    # the best F1 over held-out scores; of equal ones the middle of the widest gap
    scored.sort(reverse=True)
    positives, tp, fp, best = sum(t for _, t in scored), 0, 0.0, (-1.0, 1.0)
    for k, (s, t) in enumerate(scored):
        tp += t
        fp += weight * (not t)
        below = scored[k + 1][0] if k + 1 < len(scored) else 0.0
        if s > below:
            best = max(best, (2 * tp / (tp + fp + positives), (s + max(below, s / 2)) / 2))
    model = train(grams.kept)
    model.threshold = best[1]
    model.held_out = {"f1": best[0], "toxic": positives, "labelled": len(texts)}
    return model


def fit_on(docs: DataFrame, labels: DataFrame, max_labelled: int = 2000, max_chars: int = 50_000) -> Model:
    """fit() on labelled documents, one text each: at most max_labelled of each class, those of the smallest hash of doc_id.

    Labels without a document don't count; of several labels of a document the
    greatest does, and of its texts the least. Documents of more than
    max_chars characters aren't learned from, so the driver gets
    2 * max_labelled * max_chars characters at most; they are scored like all.
    """
    l = pick(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    d = pick(docs, doc_id="doc_id", text="text").where(F.length("text") <= max_chars)
    l = settle(d.select("doc_id").distinct().join(l, "doc_id"))
    order = F.xxhash64("doc_id")
    size = {r[0]: r[1] for r in l.groupBy("toxic").count().collect()}
    weight = (size.get(0, 0) / max_labelled if size.get(0, 0) > max_labelled else 1.0) / max(1.0, size.get(1, 0) / max_labelled)
    some = None
    for k in (1, 0):
        one = l.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(max_labelled)
        some = one if some is None else some.unionByName(one)
    rows = d.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(order, "doc_id").select("text", "toxic").toArrow()
    drop_settled(l)
    return fit(rows["text"].to_pylist(), [bool(x) for x in rows["toxic"].to_pylist()], weight=weight)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """One row a row of docs: doc_id, toxic, score, windows, toxic windows, the worst margin and its window.

    A null or empty text, or one without words, has no window: score 0, not
    toxic. Repeated rows are each scored; a null doc_id stays null; further
    columns of docs are left out. Texts of any length are read whole. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        score = m.scorer()
        for b in batches(it, _BATCH):
            out: list[tuple] = [score(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([o[2] > 0 and o[0] >= m.threshold for o in out], pa.bool_()), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int32()), pa.array([o[4].decode("utf-8", "replace") if o[4] else None for o in out], pa.string())],
                ["doc_id", "toxic", "score", "n_windows", "n_toxic_windows", "worst_margin", "worst_window"],
            )

    return pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_on(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, with all their columns; the model is fitted on the labelled ones among docs.

    Null and empty texts stay, with whatever doc_id; each of repeated rows is
    judged by its own text; an empty table gives none, and without labels
    nothing is toxic.
    """
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        score = m.scorer()
        for b in batches(it, _BATCH):
            keep = []
            for t in b.column(at).to_pylist():
                s = score(t)
                keep.append(not (s[2] > 0 and s[0] >= m.threshold))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
