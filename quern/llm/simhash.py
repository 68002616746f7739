"""SimHash near-duplicates by pigeonring filtering, and one document kept of each group.

A document's signature has 256 bits: for each, the sign of the sum over its
distinct words of +1 or -1, by the bits of the word's hash. Two documents are
near-duplicates if at most TAU bits differ; groups are the connected
components, named by their smallest doc_id.

Search: equal signatures are first reduced to one row. The others are laid
out in rings, the bits of each in another order, of 16 segments of 16 bits.
Two signatures whose ring is equal for `width` bits from the start of a
segment on are candidates there; from that segment on, around the ring, the
differences of the first l segments together may be at most l * TAU / 16 for
l = 2, 3, 4, else the pair is dropped before its full Hamming distance is
taken.

The width grows with the logarithm of the number of signatures, so that a
bucket has about BUCKET rows whatever the table's size, and the number of
rings is the least for which a pair at TAU bits is found with probability
RECALL at least: 5 rings up to 4 million signatures.

What the rings leave out is then searched for between the groups that they
gave, completely: all pairs of blocks of BLOCK signatures are compared, by
parts of which one differs in few bits only, all whose flips are looked up
(parts(), across()). No link is lost; the work grows with the square of the
number of signatures, at a few nanoseconds a pair or less.

No bucket is cut off or sampled. In a bucket of more than LARGE rows one row
after the other becomes a leader and takes the rows within TAU of it; only
members of groups whose leaders differ by 3 * TAU at most are compared with
each other, which loses no link, so thousands of near copies cost no square.
A bucket that may have more than HOT rows is divided into tiles, and each
pair of tiles is a task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, chunks, drop_settled, pick, settle, table
from .kernel import U64, distinct, mix, words

BITS, SEGMENTS, TAU, CHAIN = 256, 16, 40, 4
RECALL, BUCKET = 0.96, 64
HOT, TASK_ROWS, BLOCK, COUNTED = 200_000, 250_000, 250_000, 1 << 17
_CHUNK, _BATCH = 1 << 20, 16 << 20


def signatures(texts: list[str | None]) -> list[bytes]:
    """32 bytes a text. A text without a word gets a hash of the text itself, so that only its exact copies match."""
    out: list[bytes] = []
    for a, b in chunks(texts, _CHUNK):
        part = texts[a:b]
        w = words(part)
        h, doc = distinct(w.hash, w.doc())
        n = len(part)
        at = np.searchsorted(doc, np.arange(n + 1))
        sig = np.zeros((n, BITS // 8), np.uint8)
        # texts are taken together while their distinct words are few; expanding a word takes 256 bytes
        i = 0
        while i < n:
            j = i + 1
            while j < n and at[j + 1] - at[i] <= 8192:
                j += 1
            sums = np.zeros((j - i, BITS), np.int32)
            full = np.flatnonzero(np.diff(at[i : j + 1]))
            for s in range(at[i], at[j], 8192 if j == i + 1 else max(1, at[j] - at[i])):
                e = min(at[j], s + 8192) if j == i + 1 else at[j]
                wide = np.stack([mix(h[s:e], k + 1) for k in range(BITS // 64)], 1)
                bits = np.unpackbits(wide.view(np.uint8), axis=1)
                if j == i + 1:
                    sums[0] += bits.sum(0, dtype=np.int32)
                else:
                    sums[full] = np.add.reduceat(bits, at[i:j][full] - at[i], axis=0, dtype=np.int32)
            sig[i:j] = np.packbits(2 * sums > np.diff(at[i : j + 1])[:, None], axis=1)
            i = j
        rows = [s.tobytes() for s in sig]
        for k in np.flatnonzero(np.diff(at) == 0):
            rows[k] = hashlib.sha256((part[k] or "").encode("utf-8", "replace")).digest()
        out += rows
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, sig) of documents that have an id and a text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, _BATCH):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(signatures(b["text"].to_pylist()), pa.binary())], ["doc_id", "sig"])

    return pick(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, sig binary")


def ring_bits(rings: int) -> np.ndarray:
    """The signature's bits in the order of each ring. The first has them as they are, the second takes one of each segment in turn, the others are shuffled."""
    orders = [np.arange(BITS), np.arange(BITS).reshape(SEGMENTS, -1).T.ravel()]
    orders += [np.argsort(mix(np.arange(BITS, dtype=U64), 1000 + r), kind="stable") for r in range(2, rings)]
    return np.array(orders[:rings])


def laid_out(sig: np.ndarray, rings: int) -> np.ndarray:
    """The segments of each signature's rings as 16-bit numbers: rows, rings * SEGMENTS."""
    bits = np.unpackbits(sig, axis=1)
    return np.ascontiguousarray(np.packbits(bits[:, ring_bits(rings)], axis=2).reshape(len(sig), -1)).view(">u2").astype(np.uint16)


def keys(seg: np.ndarray, rings: int, width: int) -> np.ndarray:
    """Of each segment of each ring the window's number in the high bits and its first width bits, 16 to 48 of them, below."""
    ring = seg.reshape(len(seg), rings, SEGMENTS).astype(U64)
    value = ring << U64(32) | np.roll(ring, -1, 2) << U64(16) | np.roll(ring, -2, 2)
    value >>= U64(48 - width)
    number = np.arange(rings * SEGMENTS, dtype=U64).reshape(rings, SEGMENTS)
    return (value | number << U64(48)).reshape(len(seg), -1).view(np.int64)


def hit_rate(width: int, tau: int = TAU, chain: int = CHAIN) -> float:
    """Probability that a window of width equal bits, and then the chain, is passed by a pair at tau bits, spread at random."""
    size = BITS // SEGMENTS
    equal = prod((BITS - width - k) / (BITS - k) for k in range(tau))  # none of the tau bits is in the window
    free, ways = BITS - width, {0: 1.0}  # differences in the chain so far, by hypergeometric steps
    for l in range(1, chain + 1):
        open_ = max(0, min(size, l * size - width))
        new: dict[int, float] = {}
        for had, p in ways.items():
            for k in range(0, min(open_, tau - had) + 1):
                q = comb(tau - had, k) * comb(max(0, free - (tau - had)), open_ - k) / comb(free, open_) if free - (tau - had) >= open_ - k else 0.0
                if (had + k) * SEGMENTS <= l * tau:
                    new[had + k] = new.get(had + k, 0.0) + p * q
        ways, free = new, free - open_
    return equal * sum(ways.values())


def layout(n: int, tau: int = TAU, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(width, rings) for n signatures."""
    width = min(48, max(16, (max(1, n) - 1).bit_length() - bucket.bit_length() + 1))
    if tau < 1:
        return width, 1
    return width, max(1, ceil(log(1 - recall) / log(1 - hit_rate(width, tau)) / SEGMENTS))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(U64) ^ b.view(U64)).sum(-1, dtype=np.int64)


def near(key: np.ndarray, seg: np.ndarray, tau: int = TAU, chain: int = CHAIN, large: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) with equal key and at most tau differing bits; of large buckets, enough to link whatever is linked.

    key is sorted; seg: each row's ring from the key's segment on, as SEGMENTS 16-bit numbers.
    """

    def keep(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sum_ = np.zeros(len(i), np.int64)
        for l in range(2, chain + 1):
            sum_ = sum_ + np.bitwise_count(seg[i, l - 1] ^ seg[j, l - 1])
            ok = sum_ * SEGMENTS <= l * tau
            i, j, sum_ = i[ok], j[ok], sum_[ok]
            if not len(i):
                return i, j
        full = distance(seg[i], seg[j]) <= tau
        return i[full], j[full]

    n = len(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((first, [n])))
    for k in np.flatnonzero(size > large):
        for i, j in led(seg[first[k] : first[k] + size[k]], tau):
            yield i + first[k], j + first[k]
    last = np.repeat(np.where(size > large, first, first + size), size)
    rest = np.flatnonzero(last - np.arange(n) > 1)
    shift = 1
    # a step for each distance in the bucket, over all buckets at once; long buckets' rows in slices
    while len(rest):
        for s in range(0, len(rest), 1 << 20):
            i = rest[s : s + (1 << 20)]
            yield keep(i, i + shift)
        shift += 1
        rest = rest[last[rest] - rest > shift]


def led(seg: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) within tau that link all rows that such pairs link, found by leaders."""
    left = np.arange(len(seg))
    leaders: list[int] = []
    members: list[np.ndarray] = []
    while len(left):
        inside = distance(seg[left], seg[left[0]]) <= tau
        leaders.append(int(left[0]))
        members.append(left[inside])
        yield np.full(int(inside.sum()) - 1, left[0]), members[-1][1:]
        left = left[~inside]
    many = np.array([len(m) for m in members])
    lead = seg[leaders]
    for a in range(len(leaders) - 1):
        # leaders themselves are further apart than tau, so two groups of one have no link
        b = np.flatnonzero((distance(lead[a + 1 :], lead[a]) <= 3 * tau) & ((many[a] > 1) | (many[a + 1 :] > 1))) + a + 1
        for k in b.tolist():
            for x in members[a].tolist():
                hit = members[k][distance(seg[members[k]], seg[x]) <= tau]
                if len(hit):
                    yield np.array([x]), hit[:1]
                    break


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of ids: (id, smallest id of its component) of each that isn't the smallest itself."""
    ids, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(ids))
    x, y = inv[: len(a)], inv[len(a) :]
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(ids))
    return ids[other], ids[root[other]]


def hot_keys(sigs: DataFrame, n: int, width: int, rings: int, hot: int, rows: int = COUNTED) -> DataFrame:
    """(key, tiles): keys that may have more than hot rows. A piece of the table, rows rows at most, reports a key only from hot / pieces rows on; the rest counts as that many. One window's keys are counted at a time, so memory is bounded by rows."""
    pieces = sigs.rdd.getNumPartitions() + n // rows
    least = hot // pieces

    def frequent(sig: np.ndarray) -> pa.RecordBatch:
        seg = np.concatenate([laid_out(sig[s : s + 4096], rings) for s in range(0, len(sig), 4096)]).reshape(len(sig), rings, SEGMENTS)
        k, c = [], []
        for r in range(rings):
            for w in range(SEGMENTS):
                value = seg[:, r, w].astype(U64) << U64(32) | seg[:, r, (w + 1) % SEGMENTS].astype(U64) << U64(16) | seg[:, r, (w + 2) % SEGMENTS]
                one, many = np.unique(value >> U64(48 - width) | U64(r * SEGMENTS + w) << U64(48), return_counts=True)
                k.append(one[many > least])
                c.append(many[many > least])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(k).view(np.int64)), pa.array(np.concatenate(c))], ["hot_key", "n"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0
        for b in it:
            sig = stacked(b["sig"])
            while len(sig):
                part, sig = sig[: rows - total], sig[rows - total :]
                held.append(part)
                total += len(part)
                if total == rows:
                    yield frequent(np.concatenate(held))
                    held, total = [], 0
        if total:
            yield frequent(np.concatenate(held))

    seen = sigs.select("sig").mapInArrow(count, "hot_key long, n long").groupBy("hot_key").agg((F.sum("n") + F.lit(least) * (F.lit(pieces) - F.count(F.lit(1)))).alias("n"))
    return seen.where(F.col("n") > hot).select("hot_key", F.ceil(F.col("n") / hot).cast("int").alias("tiles"))


def stacked(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def edges(sigs: DataFrame, tau: int = TAU, recall: float = RECALL, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(a, b), b < a: links between near-duplicate rows of (doc_id, sig) with distinct signatures; each bucket's as a forest."""
    n = sigs.count()
    width, rings = layout(n, tau, recall, bucket)
    windows = rings * SEGMENTS
    tiled = None
    if n > hot:
        some = settle(hot_keys(sigs, n, width, rings, hot))
        if some.head(1):
            tiled = some

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                seg = laid_out(stacked(part["sig"]), rings)
                turned = np.stack([np.roll(seg.reshape(len(seg), rings, SEGMENTS), -k, 2) for k in range(SEGMENTS)], 2)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(seg) * windows, [None, pa.py_buffer(np.ascontiguousarray(turned))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys(seg, rings, width).ravel()), part["doc_id"].take(pa.array(np.repeat(np.arange(len(seg)), windows))), raw], ["key", "doc_id", "ring"])

    def match(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in it if b.num_rows]
        if not got:
            return
        key, doc, tile = (np.concatenate([b[c].to_numpy() for b in got]) for c in ("key", "doc_id", "tile"))
        seg = np.concatenate([np.frombuffer(b"".join(b["ring"].to_pylist()), np.uint16).reshape(-1, SEGMENTS) for b in got])
        del got
        order = np.lexsort((key, tile))
        key, doc, tile, seg = key[order], doc[order], tile[order], np.ascontiguousarray(seg[order])
        bucket_ = np.cumsum(np.concatenate(([False], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))))
        a: list[np.ndarray] = []
        b_: list[np.ndarray] = []
        held = 0
        for i, j in near(bucket_, seg, tau):
            a.append(doc[i])
            b_.append(doc[j])
            held += len(i)
            if held > 1 << 22:
                x, y = forest(np.concatenate(a), np.concatenate(b_))
                a, b_, held = [x], [y], len(x)
        if held:
            x, y = forest(np.concatenate(a), np.concatenate(b_))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    rows = sigs.mapInArrow(split, "key long, doc_id long, ring binary")
    # enough parts for a task to hold one at ease; not by the cluster's setting, which knows nothing of how many windows there are
    parts = max(int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * windows // TASK_ROWS)
    if tiled is None:
        spread = rows.withColumn("tile", F.lit(0).cast("long")).repartition(parts, "key")
    else:
        t = F.coalesce("tiles", F.lit(1))
        own = F.pmod(F.xxhash64("doc_id"), t)
        # of t tiles, number x goes with each other one y, as pair (smaller, larger)
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), t.cast("long") - 1), lambda y: F.least(y, own) * F.lit(1 << 32) + F.greatest(y, own))
        spread = rows.join(tiled.hint("shuffle_hash"), F.col("key") == F.col("hot_key"), "left").select("key", "doc_id", "ring", F.explode(pairs).alias("tile")).repartition(parts, "key", "tile")
    return spread.mapInArrow(match, "a long, b long").distinct()


def parts(m: int, tau: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, bound) of m parts of a signature; the bounds make tau + 1.

    Two signatures at tau bits have, around the ring of parts, one from which on
    the differences of the first l parts are fewer than their l bounds, for each
    l: the differences less the bounds sum to -1 at most, and such a sequence has
    a rotation all of whose beginnings sum to less than 0.
    """
    cut = lambda whole: [k * whole // m for k in range(m + 1)]
    at, sums = cut(BITS), cut(tau + 1)
    return [(at[k], at[k + 1] - at[k], sums[k + 1] - sums[k]) for k in range(m)]


def flips(bits: int, most: int) -> np.ndarray:
    """The numbers of so many bits of which most at most are set."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.int32)


def cheapest(n: int, m: int, tau: int) -> int:
    """The number of parts with which n signatures are compared soonest with m: that of fewest lookups and candidates."""

    def cost(count: int) -> float:
        return sum(sum(comb(w, e) for e in range(t)) * n * (1 + m / 2**w) + 2**w / 8 for _, w, t in parts(count, tau))

    return min(range(11, 33), key=cost)


def value(sig: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The number that these bits, up to 24 of them, make."""
    at = first // 8
    out = np.zeros(len(sig), np.uint64)
    for k in range(at, at + 4):
        out = out << U64(8) | (sig[:, k].astype(U64) if k < sig.shape[1] else U64(0))
    return (out >> U64(32 - first % 8 - bits) & U64((1 << bits) - 1)).astype(np.int32)


def across(x: np.ndarray, of_x: np.ndarray, y: np.ndarray | None, of_y: np.ndarray | None, tau: int = TAU, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links between the groups of_x of signatures x and the groups of_y of y, or of_x themselves if y is None, that connect whatever pairs at most tau bits apart connect.

    Each part's values are looked up in a table with all flips of fewer bits
    than its bound, the pairs found there are tested with the next part, then
    whole. Pairs within one group are left out: where a group has more than few
    rows before they are listed, so large groups cost no square.
    """
    same = y is None
    if same:
        y, of_y = x, of_x
    names, at = np.unique(np.concatenate((of_x, of_y)), return_inverse=True)
    gx, gy = at[: len(x)], at[len(x) :]
    full_x, full_y = (np.ascontiguousarray(s).view(U64) for s in (x, y))
    found: list[np.ndarray] = []
    ring = parts(cheapest(len(x), len(y), tau), tau) if len(x) and len(y) else []
    for k, (first, bits, bound) in enumerate(ring):
        if bound < 1:
            continue
        first2, bits2, bound2 = ring[(k + 1) % len(ring)]
        many = (np.bincount(gy, minlength=len(names)) > few)[gx]
        vx, vy = value(x, first, bits), value(y, first, bits)
        order = np.lexsort((gy, vy)).astype(np.int32)
        start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(vy, minlength=1 << bits), out=start[1:])
        place = np.empty(len(y), np.int32)
        place[order] = np.arange(len(y), dtype=np.int32)
        next_x, next_y = value(x, first2, bits2), value(y, first2, bits2)[order]
        grouped_ = vy[order].astype(np.int64) << 32 | gy[order] if many.any() else None
        new: list[np.ndarray] = []
        for f, ones in zip((all_ := flips(bits, bound - 1)).tolist(), np.bitwise_count(all_).tolist()):
            v = vx ^ np.int32(f)
            # of two rows of one table, the one with the smaller value looks for the other
            rows = np.flatnonzero(v > vx) if same and f else np.arange(len(x))
            lo, hi = place[rows] + 1 if same and not f else start[v[rows]], start[v[rows] + 1]
            big = many[rows]
            if big.any():
                own = v[rows[big]].astype(np.int64) << 32 | gx[rows[big]]
                before, after = np.searchsorted(grouped_, own), np.searchsorted(grouped_, own, "right")
                rows = np.concatenate((rows[~big], rows[big], rows[big]))
                lo, hi = np.concatenate((lo[~big], lo[big], np.maximum(lo[big], after))), np.concatenate((hi[~big], np.minimum(hi[big], before), hi[big]))
            some = hi > lo
            rows, lo, n = rows[some], lo[some].astype(np.int64), (hi[some] - lo[some]).astype(np.int64)
            ends = np.cumsum(n)
            s = 0
            while s < len(rows):
                base = ends[s] - n[s]
                e = max(s + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
                j = np.arange(ends[e - 1] - base) + np.repeat(lo[s:e] - (ends[s:e] - n[s:e] - base), n[s:e])
                hit = np.flatnonzero(np.bitwise_count(np.repeat(next_x[rows[s:e]], n[s:e]) ^ next_y[j]) < bound + bound2 - ones)
                i, j = rows[s + np.searchsorted(ends[s:e] - base, hit, "right")], order[j[hit]]
                other = gx[i] != gy[j]
                i, j = i[other], j[other]
                near_ = np.bitwise_count(full_x[i] ^ full_y[j]).sum(1, dtype=np.int64) <= tau
                if near_.any():
                    new.append(np.unique(np.stack((gx[i[near_]], gy[j[near_]]), 1), axis=0))
                s = e
        if new:
            pairs = np.concatenate(new)
            found.append(pairs)
            a, b = forest(pairs[:, 0], pairs[:, 1])
            to = np.arange(len(names))
            to[a] = b
            gx, gy = to[gx], to[gy]
    if not found:
        return names[:0], names[:0]
    pairs = np.concatenate(found)
    return forest(names[pairs[:, 0]], names[pairs[:, 1]])


def left_out(sigs: DataFrame, root: DataFrame, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """(a, b), b < a: links between the groups of root (id, root) that near-duplicate rows of (doc_id, sig) make, all that there are.

    The table is divided into blocks, and each pair of blocks is a task's.
    """
    n = sigs.count()
    blocks = max(1, min(12, n // 4096), -(-n // block))
    own = F.pmod(F.xxhash64("sig"), F.lit(blocks))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda o: F.least(o, own) * F.lit(blocks) + F.greatest(o, own))
    rows = sigs.join(root, F.col("doc_id") == F.col("id"), "left").select("sig", F.coalesce("root", "doc_id").alias("of"), own.alias("own"), F.explode(pairs).alias("tile"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(stacked(b["sig"]), *(b[c].to_numpy() for c in ("of", "own", "tile"))) for b in it if b.num_rows]
        if not got:
            return
        sig, of, own_, tile = (np.concatenate(c) for c in zip(*got))
        del got
        for t in np.unique(tile).tolist():
            p, q = divmod(t, blocks)
            x, y = (np.flatnonzero((tile == t) & (own_ == o)) for o in (p, q))
            a, b = across(sig[x], of[x], *((None, None) if p == q else (sig[y], of[y])), tau)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition(blocks * (blocks + 1) // 2, "tile").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): of each id that has a smaller one in its component, the smallest. Alternating large and small stars."""
    e = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    count = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    was = None
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        new = settle(small)
        drop_settled(e)
        e = new
        now = e.agg(count).first()[0]
        if now == was:
            return e.toDF("id", "root")
        was = now


def groups(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row a document: doc_id, group_id (its group's smallest doc_id), keep.

    The smallest doc_id of a group is kept. Rows that repeat a doc_id are one
    document, matched by each of its texts. Rows with a null doc_id or text
    are left out. Empty texts and others without a word only match their exact
    copies. Texts of any length are read whole. Further columns of docs are
    left out; an empty table gives none.
    """
    return grouped(signed(docs), tau)


def grouped(sigs: DataFrame, tau: int = TAU) -> DataFrame:
    """groups() of rows (doc_id, sig)."""
    sigs = settle(sigs)
    one = settle(sigs.groupBy("sig").agg(F.min("doc_id").alias("doc_id")))
    links = edges(one, tau).union(sigs.join(one.select("sig", F.col("doc_id").alias("b")), "sig").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b"))
    root = components(links)
    more = settle(left_out(one, root, tau))
    if more.head(1):
        was, root = root, components(root.toDF("a", "b").union(more))
        drop_settled(was)
    drop_settled(more)
    drop_settled(one)
    return sigs.select("doc_id").distinct().join(root, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True)).alias("keep"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without all but the smallest doc_id of each group, with all their columns.

    A stage before may have cut from near copies what they have in common, and
    what is left of them doesn't match any more. Documents are therefore
    matched by the text they came with (in sf_dir's documents, by doc_id) as
    well as by the text they have now; only rows of docs are kept or dropped.
    A null doc_id or text stays; rows that repeat a doc_id stay or go together;
    an empty table gives none.
    """
    now = pick(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    came = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sigs = signed(now).union(signed(came).join(now.select("doc_id").distinct(), "doc_id", "left_semi")).distinct()
    gone = settle(grouped(sigs).where("not keep").select(F.col("doc_id").alias("gone_")))
    at = docs.columns.index("doc_id")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kept = plain.join(gone.hint("shuffle_hash"), (plain[f"c{at}"].cast("long") == F.col("gone_")) & plain[f"c{docs.columns.index('text')}"].isNotNull(), "left_anti")
    return kept.toDF(*docs.columns)
