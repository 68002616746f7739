"""A capture index by external merging of sorted runs: all captures in the order of URL key and timestamp.

1. Runs. Each input split is sorted by itself and written to the shared
   folder; rows know their run and their place in it.
2. Ranges. The runs are divided at the same keys into ranges of about
   RANGE_ROWS rows; of a range, one task gets a sorted piece of every run.
3. Merging. The task merges its pieces, k at once, with a loser tree: a match
   is replayed for each row along one path only, log2(k) comparisons.
4. Histories. Counts of the ranges, one row each, give every capture its
   place in the whole and its number in the history of its URL key, also
   where a history goes on across ranges.

The URL key is the host's labels in reverse order, without a leading www and
the scheme's usual port, then the path and query, all lower-cased, without
the fragment. Text that isn't a URL, and null, has the key "-".
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, settle, table

RANGE_ROWS = 200_000
MAX_BROADCAST = 64 << 20  # bytes; more ranges are joined by a shuffle
EPOCH = 1577836800  # 2020-01-01
DATED = (-62135596800 - EPOCH, 253402300799 - EPOCH)  # page_ids whose date is in the years 1 to 9999
_URL = r"^[a-z][a-z0-9+.-]*://([^/?#]*)([^#]*)"
ORDER = ("url_key", "timestamp", "page_id", "url", "digest")
_ROW = "url_key string, timestamp string, page_id long, url string, digest string, length long"


def url_key(url: Column) -> Column:
    low = F.lower(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(low, _URL, 1), r"^[^@]*@", ""), r"^www[0-9]*[.]", ""), r":(80|443)$", "")
    path = F.regexp_extract(low, _URL, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(F.substring(path, 1, 1) == "/", F.lit("")).otherwise(F.lit("/")), path)
    return F.coalesce(F.when(low.rlike(_URL), key), F.lit("-"))


class LoserTree:
    """Merges sorted sequences. Equal rows come in the order of their sequences."""

    def __init__(self, runs: Sequence[Sequence]) -> None:
        self.runs = runs
        self.k = len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * max(1, self.k)  # losers; the winner at 0
        for s in range(self.k - 1, -1, -1):
            self._replay(s, building=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.at[a], self.at[b]
        if x >= len(self.runs[a]):
            return False
        if y >= len(self.runs[b]):
            return True
        p, q = self.runs[a][x], self.runs[b][y]
        return p < q or (p == q and a < b)

    def _replay(self, s: int, building: bool = False) -> None:
        node = (s + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                if building:
                    self.tree[node] = s
                    return
            elif self._less(other, s):
                self.tree[node], s = s, other
            node //= 2
        self.tree[0] = s

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in the run) of each row in order."""
        if not self.k:
            return
        while True:
            s = self.tree[0]
            i = self.at[s]
            if i >= len(self.runs[s]):
                return
            yield s, i
            self.at[s] = i + 1
            self._replay(s)


def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: its pieces of runs, told apart by run and place, as one sorted sequence with rank and capture."""
    parts = [b for b in it if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    run, place = t["run"].to_numpy(), t["place"].to_numpy()
    order = np.lexsort((place, run))
    keys = list(zip(*(t[c].to_pylist() for c in ORDER)))
    keys = [tuple((x is not None, x) if x is None or not isinstance(x, str) else (True, x.encode("utf-8", "replace")) for x in k) for k in keys]
    cut = np.flatnonzero(np.diff(run[order])) + 1
    pieces = np.split(order, cut)
    tree = LoserTree([[keys[i] for i in p] for p in pieces])
    take = np.fromiter((pieces[s][i] for s, i in tree), np.int64, len(keys))
    t = t.take(pa.array(take))
    url = [keys[i][0] for i in take]
    capture, n = [], 0
    for i, k in enumerate(url):
        n = n + 1 if i and k == url[i - 1] else 1
        capture.append(n)
    names = [f.split()[0] for f in _ROW.split(", ")]
    out = pa.Table.from_arrays([*(t[c] for c in names), t["range"], pa.array(range(len(url)), pa.int64()), pa.array(capture, pa.int64())], [*names, "range", "rank", "capture"])
    yield from out.to_batches(max_chunksize=10_000)


def indexed(pages: DataFrame, timestamp: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row a row of pages, in order of URL key, timestamp and page_id: position, url_key, timestamp, capture, page_id, url, digest, length.

    timestamp names a column of 14-digit capture times; without one, captures
    are dated by page_id, a second each from 2020 on. digest is the SHA-1 of
    html and length its bytes, null where html is. Nulls come first; a null
    page_id without a timestamp column has none, nor has one that leads out of
    the years 1 to 9999. URLs and pages of any length are taken whole. Repeated rows are captures of
    their own. Further columns are left out; an empty table gives no rows.
    """
    spark = pages.sparkSession
    src = pick(pages, page_id="page_id", url="url", html="html", **({"at": timestamp} if timestamp else {}))
    when = F.col("at").cast("string") if timestamp else F.when(F.col("page_id").between(*DATED), F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.when(F.col("page_id").between(*DATED), F.col("page_id"))), "yyyyMMddHHmmss"))
    rec = src.select(url_key(F.col("url")).alias("url_key"), when.alias("timestamp"), F.col("page_id").cast("long"), "url", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("length"))
    runs = settle(rec.sortWithinPartitions(*ORDER).select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("place")))
    n = max(1, -(-runs.count() // range_rows))
    ranged = runs.repartitionByRange(n, *ORDER, "run", "place")  # run and place divide captures that are alike, too
    ranged = ranged.withColumn("range", F.spark_partition_id())
    merged = settle(ranged.mapInArrow(merge, _ROW + ", range int, rank long, capture long"))
    of_range = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("url_key").alias("low"), F.max_by("url_key", "rank").alias("high"), F.max_by("capture", "rank").alias("held")).orderBy("range")
    rows, start, key, held = [], 0, None, 0
    for r in of_range.toLocalIterator():
        carry = held if r["low"] == key else 0
        rows.append((r["range"], start, r["low"], carry))
        held = r["held"] + (carry if r["high"] == r["low"] else 0)
        start, key = start + r["n"], r["high"]
    info = spark.createDataFrame(rows, "range int, start long, low string, carry long")
    if sum(len(r[2] or "") + 40 for r in rows) < MAX_BROADCAST:
        info = F.broadcast(info)
    return merged.join(info, "range").select((F.col("start") + F.col("rank")).alias("position"), "url_key", "timestamp", (F.col("capture") + F.when(F.col("url_key") == F.col("low"), F.col("carry")).otherwise(0)).alias("capture"), "page_id", "url", "digest", "length")


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(table(spark, sf_dir, "pages"))


ORACLE = rf"""
    WITH a AS (SELECT page_id, url, html, lower(url) AS low FROM pages),
    b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(low, '{_URL}', 1), '^[^@]*@', ''), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host, regexp_extract(low, '{_URL}', 2) AS path FROM a),
    c AS (SELECT CASE WHEN regexp_matches(low, '{_URL}') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path LIKE '/%' THEN '' ELSE '/' END || path ELSE '-' END AS url_key,
                 CASE WHEN page_id BETWEEN {DATED[0]} AND {DATED[1]} THEN strftime(make_timestamp(({EPOCH} + CASE WHEN page_id BETWEEN {DATED[0]} AND {DATED[1]} THEN page_id END) * 1000000), '%Y%m%d%H%M%S') END AS timestamp, page_id, url, sha1(html) AS digest, octet_length(encode(html)) AS length FROM b)
    SELECT row_number() OVER (ORDER BY url_key NULLS FIRST, timestamp NULLS FIRST, page_id NULLS FIRST, url NULLS FIRST, digest NULLS FIRST) - 1 AS position, url_key, timestamp,
           row_number() OVER (PARTITION BY url_key ORDER BY timestamp NULLS FIRST, page_id NULLS FIRST, url NULLS FIRST, digest NULLS FIRST) AS capture, page_id, url, digest, length FROM c"""
