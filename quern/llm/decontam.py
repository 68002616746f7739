"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Texts are normalised to their lower-cased words, one space apart. Patterns
are all runs of RUN words of an item, or the whole item if it is shorter, so
partial copies of RUN words or more are found, too. All items are searched,
however short; what is found says how many words it has, and stage() only
decides by stretches of MIN_WORDS words or more, as shorter answers occur by
chance. A text is normalised and scanned once; only where a pattern is found
are the offsets mapped back to the original text.

The automaton grows with the benchmark, not with the corpus. What is
broadcast are the items; each Python worker makes the patterns and builds the
automaton once. Up to MAX_CHARS characters of patterns go into one automaton,
which takes some 50 bytes a character; a larger benchmark is divided into as
many automata as it takes, each of which scans the texts, with the same
result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, pick, table

RUN, MIN_WORDS = 13, 5
MAX_CHARS = 8_000_000
_WORD = re.compile(r"\w+")
_FOUND = "doc_id long, item_id {}, start int, end int, n_words int, share double"

_BATCH = 16 << 20

_built: dict[str, object] = {}


def normal(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def patterns(items: list[tuple[int, str | None]], run: int = RUN) -> list[tuple[str, int, int]]:
    """(words, item, words of the item) of all runs; items without a word have none."""
    out = []
    for item, text in items:
        w = normal(text)
        for i in range(max(1, len(w) - run + 1) if w else 0):
            out.append((f" {' '.join(w[i : i + run])} ", item, len(w)))
    return out


def automaton(pats: list[tuple[str, int, int]]):
    a = ahocorasick.Automaton()
    by: dict[str, dict[int, int]] = {}
    for p, item, n in pats:
        by.setdefault(p, {})[item] = n
    for p, v in by.items():
        a.add_word(p, (len(p), list(v.items())))
    a.make_automaton()
    return a


def built(key: str, shared, run: int):
    """The automaton of these items; a worker holds the last one."""
    if key not in _built:
        _built.clear()
        _built[key] = automaton(patterns(shared.value, run))
    return _built[key]


def scan(a, text: str | None) -> list[tuple[int, int, int, int, float]]:
    """(item, start, end, words, share of the item) of each stretch of text that is copied from an item, in order.

    Runs that overlap or touch are one stretch; share is the part of the item's
    words that the stretch has, 1 at most.
    """
    w = normal(text)
    if not w:
        return []
    flat = f" {' '.join(w)} "
    hits = [(end - n + 1, end + 1, v) for end, (n, v) in a.iter(flat)] if len(a) else []
    if not hits:
        return []
    # word number by place of the space before it
    place, pos = {}, 0
    for k, x in enumerate(w):
        place[pos] = k
        pos += len(x) + 1
    place[pos] = len(w)
    spans: dict[int, list[list[int]]] = {}
    size: dict[int, int] = {}
    for s, e, v in hits:
        i, j = place[s], place[e - 1]
        for item, n in v:
            size[item] = n
            mine = spans.setdefault(item, [])
            if mine and i <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], j)
            else:
                mine.append([i, j])
    # words of the lower-cased text, mapped to the original
    low = text.lower()
    at = [m.span() for m in _WORD.finditer(low)]
    if len(low) != len(text):
        back = [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
        at = [(back[s], back[e - 1] + 1) for s, e in at]
    out = [(item, at[i][0], at[j - 1][1], j - i, min(1.0, (j - i) / size[item])) for item, mine in spans.items() for i, j in mine]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def shards(benchmark: DataFrame, run: int, most: int) -> Iterator[tuple[list, list[tuple[int, str]]]]:
    """Parts of the benchmark: the ids of its distinct items, and (place in these, text) of each. One part at a time is held."""
    rows = pick(benchmark, item_id="item_id", text="text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator()
    ids: list = []
    items: list[tuple[int, str]] = []
    held = 0
    for item, text in rows:
        n = sum(map(len, (w := normal(text)))) + len(w)
        n *= min(run, max(1, len(w) - run + 1))
        if held and held + n > most:
            yield ids, items
            ids, items, held = [], [], 0
        items.append((len(ids), text))
        ids.append(item)
        held += n
    if ids:
        yield ids, items


def contaminated(docs: DataFrame, benchmark: DataFrame, run: int = RUN, most: int = MAX_CHARS) -> DataFrame:
    """A row for each stretch of a document that an item has: doc_id, item_id, start and end in the original text, n_words, share.

    Null and empty texts have none, nor have null items and items without a
    word. Rows that repeat a doc_id each count; items count once by item_id
    and text, so an item_id with two texts is two items, each with its own
    share. A null doc_id or item_id stays null; item_id has the benchmark's
    type. Texts of any length are scanned whole. Further columns are left out;
    an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    src = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    item_type = benchmark.schema["item_id"].dataType
    schema = _FOUND.format(item_type.simpleString())
    kind = to_arrow_type(item_type)
    out = None
    for part in shards(benchmark, run, most):
        shared = spark.sparkContext.broadcast(part[1])
        names = spark.sparkContext.broadcast(part[0])

        def go(it: Iterator[pa.RecordBatch], shared=shared, names=names, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            a = built(key, shared, run)
            ids = pa.array(names.value, kind)
            for b in batches(it, _BATCH):
                rows, idx = [], []
                for k, t in enumerate(b["text"].to_pylist()):
                    for r in scan(a, t):
                        rows.append(r)
                        idx.append(k)
                cols = list(zip(*rows)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                item, *rest = (pa.array(c, t) for c, t in zip(cols, kinds))
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(idx, pa.int64())), ids.take(item), *rest], ["doc_id", "item_id", "start", "end", "n_words", "share"])

        one = src.mapInArrow(go, schema)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no stretch of a benchmark item of MIN_WORDS words or more, with all their columns.

    A null or empty text stays, with whatever doc_id; each of repeated rows is
    judged by its own text; an empty table gives none, an empty benchmark
    leaves all.
    """
    at = docs.columns.index("text")
    kept = docs
    for _, items in shards(table(spark, sf_dir, "benchmark"), RUN, MAX_CHARS):
        shared = spark.sparkContext.broadcast([(k, t) for k, t in items if len(normal(t)) >= MIN_WORDS])

        def go(it: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            a = built(key, shared, RUN)
            for b in batches(it, _BATCH):
                keep = []
                for t in b.column(at).to_pylist():
                    w = normal(t)
                    keep.append(not w or not len(a) or next(a.iter(f" {' '.join(w)} "), None) is None)
                yield b.filter(pa.array(keep, pa.bool_()))

        kept = kept.mapInArrow(go, docs.schema)
    return kept
