"""Best-fit packing of documents into bins of fixed capacity, by matching large items first.

A document longer than the capacity gives full bins of its own and a rest.
Items above a third of the capacity are large: at most two share a bin. From
the largest on, each is matched with the largest other one that still fits
beside it. Small items, largest first, then go where they leave the least
room; a new bin opens only where none has room.

A table is packed in groups of about group_items items, each by one task;
their number grows with the table. Rows that are alike in all that counts are
first reduced to one with a number of copies; runs of at most COPIES of these
go to groups by a hash, so neither a doc_id nor a text that a great many rows
have makes a group large. A group leaves at most about one bin partly filled
for want of items; which group an item is in is all that group_items changes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, settle, table

CAPACITY = 8192
GROUP_ITEMS = 20_000
COPIES = 1000
SCHEMA = "bin_id string, bin_size int, part int, doc_id long, start long, size int"


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices of sizes, each size from 1 to capacity. Equal sizes go in order of their index."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    large = [i for i in order if 3 * sizes[i] > capacity]
    small = order[len(large) :]
    up = large[::-1]
    keys = [sizes[i] for i in up]
    parent = list(range(len(up) + 1))  # the greatest place at or below one that is still free; 0 is none, places count from 1

    def free(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    bins: list[list[int]] = []
    room: list[int] = []
    for at in range(len(up), 0, -1):
        if free(at) != at:
            continue
        parent[at] = at - 1
        b, left = [up[at - 1]], capacity - keys[at - 1]
        k = free(min(at - 1, bisect_right(keys, left)))
        if k:
            parent[k] = k - 1
            b.append(up[k - 1])
            left -= keys[k - 1]
        bins.append(b)
        room.append(left)
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    sorted_rooms: list[int] = []
    for j in range(len(bins) - 1, -1, -1):
        if not spaces[room[j]]:
            insort(sorted_rooms, room[j])
        spaces[room[j]].append(j)
    for i in small:
        k = bisect_left(sorted_rooms, sizes[i])
        if k == len(sorted_rooms):
            bins.append([i])
            j, left = len(bins) - 1, capacity - sizes[i]
        else:
            r = sorted_rooms[k]
            j = spaces[r].pop()
            if not spaces[r]:
                sorted_rooms.pop(k)
            bins[j].append(i)
            left = r - sizes[i]
        if left:
            if not spaces[left]:
                insort(sorted_rooms, left)
            spaces[left].append(j)
    return bins


def grouped(items: DataFrame, capacity: int, group_items: int) -> DataFrame:
    """(bin_id, bin_size, part, start, piece, key): items of (key, size), one row each, packed.

    key is a struct of doc_id and what else tells rows apart; alike rows are
    told apart by nothing.
    """
    if not 1 <= capacity < 1 << 31:
        raise ValueError("capacity must be from 1 to 2**31 - 1")
    alike = settle(items.where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    total = alike.agg(F.sum("n")).first()[0] or 0
    n_groups = max(1, -(-total // group_items))
    some = alike.select("key", "size", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("run"))
    some = some.select("key", "size", F.least(F.lit(COPIES), F.col("n") - F.col("run") * COPIES).cast("int").alias("n"), F.pmod(F.xxhash64("key", "size", "run"), F.lit(n_groups)).alias("g"))
    key = alike.schema["key"].dataType.simpleString()

    def run(group: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        parts = t["key"].combine_chunks().flatten()
        by = [(t["size"], "descending"), *((f, "ascending") for f in parts)]
        order = pc.sort_indices(pa.table([c for c, _ in by], [str(k) for k in range(len(by))]), [(str(k), o) for k, (_, o) in enumerate(by)])
        t = t.take(order)
        g = group[0].as_py()
        out: list[tuple[str, int, int, int, int, int]] = []
        rests: list[tuple[int, int, int]] = []
        full = 0
        for i, (s, n) in enumerate(zip(t["size"].to_pylist(), t["n"].to_pylist())):
            for _ in range(n):
                for k in range(s // capacity):
                    out.append((f"{g}-f{full}", capacity, 0, i, k * capacity, capacity))
                    full += 1
                if s % capacity:
                    rests.append((i, s - s % capacity, s % capacity))
        for j, b in enumerate(pack([r[2] for r in rests], capacity)):
            filled = sum(rests[i][2] for i in b)
            out += [(f"{g}-{j}", filled, k, *rests[i]) for k, i in enumerate(b)]
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        bin_id, filled, part, of, start, size = (pa.array(c, k) for c, k in zip(cols, kinds))
        return pa.Table.from_arrays([bin_id, filled, part, start, size, t["key"].combine_chunks().take(of)], ["bin_id", "bin_size", "part", "start", "piece", "key"])

    return some.groupBy("g").applyInArrow(run, f"bin_id string, bin_size int, part int, start long, piece int, key {key}")


def packed(docs: DataFrame, capacity: int = CAPACITY, size_col: str | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """A row for each piece of a document in a bin: bin_id, bin_size, part, doc_id, start, size.

    Sizes are characters of text, or size_col's values where that is given.
    start and size delimit the piece in its document, in the same unit; pieces
    of a bin are numbered by part. Null and empty texts, and sizes that are
    null or not positive, take no room and have no row. Rows with a null doc_id
    are packed like others. Rows that repeat a doc_id are packed each. Sizes
    may be as large as a long. Further columns of docs are left out; an empty
    table gives no rows.
    """
    src = pick(docs, doc_id="doc_id", size=size_col) if size_col else pick(docs, doc_id="doc_id", size="text").withColumn("size", F.length("size"))
    items = src.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("key"), F.col("size").cast("long"))
    return grouped(items, capacity, group_items).select("bin_id", "bin_size", "part", "key.doc_id", "start", F.col("piece").alias("size"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in bins as in packed(), each with its part of the text and its document's lang and source.

    Rows that repeat a doc_id are documents of their own, rows that repeat all
    of these columns as well; null doc_ids, langs and sources stay. Null and
    empty texts have no piece; an empty table gives none.
    """
    src = pick(docs, doc_id="doc_id", text="text", lang="lang", source="source").where("length(text) > 0").withColumn("doc_id", F.col("doc_id").cast("long"))
    # two hashes of all columns, nulls told apart; alike rows have the same key, and of their texts one is kept
    none = F.concat_ws("", *(F.col(c).isNull().cast("int") for c in ("doc_id", "lang", "source")))
    keys = src.select("*", F.length("text").cast("long").alias("size"), *(F.xxhash64(F.lit(k), none, "doc_id", "lang", "source", "text").alias(f"k{k}") for k in (1, 2)))
    pieces = grouped(keys.select(F.struct("doc_id", "k1", "k2").alias("key"), "size"), CAPACITY, GROUP_ITEMS).select("*", F.col("key.k1").alias("p1"), F.col("key.k2").alias("p2"))
    text = keys.groupBy("k1", "k2").agg(*(F.min(c).alias(c) for c in ("doc_id", "lang", "source", "text")))
    both = text.join(pieces.hint("shuffle_hash"), (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")))
    return both.select("bin_id", "bin_size", "part", "doc_id", "start", F.col("piece").alias("size"), F.substring("text", (F.col("start") + 1).cast("int"), F.col("piece")).alias("text"), "lang", "source")
