"""Line dedup by pairwise alignment: blocks of lines that an earlier document has are deleted from the later one.

Lines. A line of text is long here, and copied passages start and end inside
of lines, so a line is divided further at places that only depend on the
words nearby: after the word with the least hash (of it and the next word) of
the NEAR words before it, itself and the NEAR after it, words that a sentence
or line ends with coming first. However short lines and sentences are, such a
place comes every 7 words or so; only runs of a few words over and over have
none. Words are lower-cased; punctuation doesn't count. What results, of four
words or more but at a text's ends, is called a line below.

Rare hashes. A line of seven words may recur by chance, or be a phrase that
millions of documents have. What is hashed is therefore, from each line on,
the shortest run of lines with MIN_BLOCK_WORDS words (and the shortest such
run that ends with the text): documents have a block of that many words in
common if and only if they share such a hash. Two documents that don't copy hardly ever do, so the hashes are rare by their
length; a limit of documents a hash would lose the passages that many have.

Pairs. Documents come in the order of doc_id, then of a 32-bit hash of the
text, by which rows of one doc_id with other texts are told apart.
Each hash has a first holder, the earliest document with it; a later document
is paired with the first holders of its hashes. So a hash in n documents
gives n - 1 links, not n**2, and needs no cap.

Alignment. Patience diff of each pair: runs that occur once on either side
are anchors, of which the longest increasing subsequence is kept and extended
over adjacent runs; what that aligns is a block. Runs that cross the blocks
are aligned again by themselves, until none is left, so moved and repeated
blocks are found as well. Only aligned blocks are deleted. The parts of lines
at both ends of a common passage stay, so a short one may have fewer words in
whole lines: of 3000 passages of 50 words of sf0.1, 3 if more than 35 of the
words are distinct, 85 if more than 25 are; of 60 words, 0 and 34 (more than
42 and 30 distinct).

A block only goes from documents after its first holder, so every line stays
somewhere.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, chunks, pick, settle, table
from .kernel import Q, U64, Words, mix, words

MIN_BLOCK_WORDS = 20
NEAR = 3
_CHUNK, _BATCH = 1 << 20, 16 << 20
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines: the index of their first word, their number of words, the text they are of."""
    n = len(w.hash)
    doc = w.doc()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), doc
    stops = np.zeros(len(w.raw) + 1, np.int32)
    np.cumsum(_STOP[w.raw], out=stops[1:])
    after = np.concatenate((w.start[1:], [len(w.raw)]))
    following = np.concatenate((w.hash[1:], w.hash[:1])) * np.concatenate((doc[1:] == doc[:-1], [False]))
    with np.errstate(over="ignore"):
        key = mix(w.hash + following * U64(Q)) >> U64(1)
    key[stops[after] == stops[w.end]] |= U64(1 << 63)
    least = np.ones(n, bool)
    for k in range(1, NEAR + 1):
        apart = doc[k:] != doc[:-k]
        least[k:] &= apart | (key[k:] < key[:-k])
        least[:-k] &= apart | (key[:-k] <= key[k:])
    begins = np.concatenate(([True], least[:-1] | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(begins)
    return first, np.diff(np.concatenate((first, [n]))), doc[first]


def line_hashes(w: Words, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), U64)
    most = 64  # a longer line goes on by the word: only texts of a few words over and over have one
    with np.errstate(over="ignore"):
        for t in range(min(most, int(count.max())) if len(first) else 0):
            i = np.flatnonzero(count > t)
            out[i] += w.hash[first[i] + t] * U64(pow(Q, t, 1 << 64))
        for k in np.flatnonzero(count > most):
            own = w.hash[first[k] + most : first[k] + count[k]]
            q = np.full(len(own), Q, U64)
            q[0] = U64(pow(Q, most, 1 << 64))
            out[k] += (own * np.multiply.accumulate(q)).sum(dtype=U64)
        return mix(out + count.astype(U64))


def runs(hashes: np.ndarray, count: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, number of lines, hash) of the shortest run with least words from each line on, and of each text's shortest that ends with it.

    Lines too near to their text's end have none of the former.
    """
    total = np.concatenate(([0], np.cumsum(count)))
    end = np.searchsorted(total, total[:-1] + least)
    at = np.flatnonzero(end <= np.searchsorted(doc, doc, "right"))
    last = np.flatnonzero(np.concatenate((doc[1:] != doc[:-1], [True])))[: len(doc)] + 1
    tail = np.searchsorted(total, total[last] - least, "right") - 1
    ok = (tail >= np.searchsorted(doc, doc[last - 1])) & (end[tail] != last)
    at, end = np.concatenate((at, tail[ok])), np.concatenate((end[at], last[ok]))
    out = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for t in range(int((end - at).max()) if len(at) else 0):
            i = np.flatnonzero(end - at > t)
            out[i] += hashes[at[i] + t] * U64(pow(Q, t, 1 << 64))
        return at, end - at, mix(out + (end - at).astype(U64))


def increasing(seq: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(seq)
    for i, x in enumerate(seq):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k], at[k] = x, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(found: list[tuple[int, int, int, bool]]) -> list[list[int]]:
    """Blocks [first line, there, lines] that a pair has in common, by patience diff over and over.

    found: (line of the later document, line of the earlier one, lines that
    are equal from there on, whether the run occurs once in either), ascending.
    """
    free: dict[tuple[int, int], tuple[int, bool]] = {}
    for i, j, n, once in found:
        free[i, j] = max(free.get((i, j), (0, False)), (n, once))
    blocks: list[list[int]] = []
    while free:
        order = sorted(free)
        anchors = [p for p in order if free[p][1]] or order
        mine: list[list[int]] = []
        for i, j in (anchors[k] for k in increasing([j for _, j in anchors])):
            if (i, j) not in free:
                continue  # in the block before
            while (i - 1, j - 1) in free:
                i, j = i - 1, j - 1
            b = [i, j, 0]
            while (at := free.pop((i, j), None)) is not None:
                b[2] = max(b[2], i - b[0] + at[0])
                i, j = i + 1, j + 1
            mine.append(b)
        blocks += mine
    return blocks


def decide(entries: list[tuple[int, int, object, int, bool]]) -> list[int]:
    """Lines of one document to delete, from (line, lines, holder, line there, once in either) of each run with an earlier holder."""
    by: dict[object, list[tuple[int, int, int, bool]]] = defaultdict(list)
    for i, n, holder, there, once in sorted(entries):
        by[holder].append((i, there, n, once))
    return sorted({k for mine in by.values() for i, _, n in aligned(mine) for k in range(i, i + n)})


def run_rows(docs: DataFrame, least: int) -> DataFrame:
    """(hash, doc_id, version, place) of all runs; place has from bit 11 on the line, from bit 1 on the number of lines, and 1 if the document has it again."""
    if not 1 <= least < 1024:
        raise ValueError("least must be from 1 to 1023 words")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, _BATCH):
            texts = b["text"].to_pylist()
            for s, e in chunks(texts, _CHUNK):
                w = words(texts[s:e])
                first, count, doc = lines(w)
                at, n, h = runs(line_hashes(w, first, count), count, doc, least)
                doc_of = doc[at]
                order = np.lexsort((h, doc_of))
                same = (h[order][1:] == h[order][:-1]) & (doc_of[order][1:] == doc_of[order][:-1])
                again = np.zeros(len(at), bool)
                again[order[1:][same]] = again[order[:-1][same]] = True
                place = ((at - np.searchsorted(doc, doc_of)) << 11) + (n << 1) + again
                take = pa.array(doc_of + s)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b["doc_id"].take(take), b["version"].take(take), pa.array(place)], ["hash", "doc_id", "version", "place"])

    src = pick(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null")
    return src.select(F.col("doc_id").cast("long"), F.hash("text").alias("version"), "text").mapInArrow(run, "hash long, doc_id long, version int, place long")


def shared_runs(docs: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, version, place, holder, there): runs of documents that an earlier one has, with its first holder.

    First holders come from an aggregation, so a hash that many documents have
    is combined before it is shuffled; its rows are then joined with one row,
    a join that can be split where it is skewed.
    """
    rows = run_rows(docs, least)
    first = F.min(F.struct("doc_id", "version", "place")).alias("first")
    held = rows.groupBy("hash").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("hash").alias("hash_"), "first")
    both = rows.join(held, F.col("hash") == F.col("hash_"))
    later = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("version") != F.col("first.version"))
    return both.where(later).select("doc_id", "version", "place", F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version")).alias("holder"), F.col("first.place").alias("there"))


def deletions(docs: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, version, gone): the numbers of the lines to delete, for documents with any.

    What is collected for a document are its own runs, one holder each.
    """
    per = shared_runs(docs, least).groupBy("doc_id", "version").agg(F.collect_list(F.struct("place", "holder", "there")).alias("e"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            flat = b["e"].flatten()
            place, there = (flat.field(k).to_numpy() for k in (0, 2))
            holder = list(zip(*(flat.field(1).field(k).to_numpy().tolist() for k in (0, 1))))
            line, n, back, once = (place >> 11).tolist(), (place >> 1 & 1023).tolist(), (there >> 11).tolist(), ((there | place) & 1 == 0).tolist()
            bound = np.concatenate(([0], np.cumsum(b["e"].value_lengths().to_numpy())))
            gone = [decide([(line[k], n[k], holder[k], back[k], once[k]) for k in range(i, j)]) for i, j in zip(bound, bound[1:])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["version"], pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "version", "gone"])

    return per.mapInArrow(run, "doc_id long, version int, gone array<int>")


def originals(text: str, places: list[int], raw: np.ndarray) -> list[int]:
    """Where in text the characters are that begin at these ascending bytes of its lower-cased form."""
    chars, at = [], 0
    for k, p in enumerate(places):
        chars.append((chars[-1] if chars else 0) + int(np.count_nonzero((raw[at:p] & 0xC0) != 0x80)))
        at = p
    low = text.lower()
    if len(low) == len(text):
        return chars
    # a few letters get longer when they are lower-cased
    wide = [k for k, c in enumerate(text) if len(c.lower()) > 1]
    extra = np.cumsum([0, *(len(text[k].lower()) - 1 for k in wide)])
    ends = np.array([k + int(e) for k, e in zip(wide, extra[1:])])  # the last character that a wide one turns into
    out = []
    for c in chars:
        m = int(np.searchsorted(ends, c))
        out.append(min(c - int(extra[m]), wide[m]) if m < len(wide) else c - int(extra[m]))
    return out


def erase(text: str, gone: list[int]) -> tuple[str, int, int, int]:
    """(text without these lines, its number of lines, lines removed, words removed).

    The cut goes from the start of a deleted run's first word to that of the
    next line's first word; a cut at the end goes to the end, and if no line is
    left nothing is. Whatever is outside of the cuts stays as it was.
    """
    w = words([text])
    first, count, _ = lines(w)
    gone = [g for g in sorted(set(gone)) if g < len(first)]
    if not gone or len(gone) == len(first):
        return ("" if gone else text), len(first), len(gone), int(count[gone].sum()) if gone else 0
    cuts, k = [], 0
    while k < len(gone):
        j = k
        while j + 1 < len(gone) and gone[j + 1] == gone[j] + 1:
            j += 1
        cuts += [int(w.start[first[gone[k]]]), int(w.start[first[gone[j] + 1]]) if gone[j] + 1 < len(first) else len(w.raw) - 1]
        k = j + 1
    at = [0, *originals(text, cuts, w.raw), len(text)]
    return "".join(text[a:b] for a, b in zip(at[::2], at[1::2])), len(first), len(gone), int(count[gone].sum())


def joined(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """docs with columns c0.. and gone; the place of text."""
    gone = settle(deletions(docs, least)).toDF("gone_id", "gone_version", "gone")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index("text")
    match = (plain[f"c{docs.columns.index('doc_id')}"].cast("long") == F.col("gone_id")) & (F.hash(plain[f"c{at}"]) == F.col("gone_version"))
    return plain.join(gone.hint("shuffle_hash"), match, "left").drop("gone_id", "gone_version"), at


def dedup(docs: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """One row a row of docs: doc_id, text without blocks of an earlier document, n_lines_removed, n_words_removed.

    A text of which no line is left becomes empty; a null text stays null, an
    empty one empty. Rows with a null doc_id stay as they are. Rows of one
    doc_id with other texts are documents of their own, in the order of a hash
    of the text; rows that repeat id and text are one document, whose own
    repeats are left alone. Texts of any length are read whole. Further columns
    of docs are left out; an empty table gives no rows.
    """
    both, _ = joined(pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")), least)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, _BATCH):
            out = [(t, 0, 0, 0) if t is None or not g else erase(t, g) for t, g in zip(b["c1"].to_pylist(), b["gone"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["c0"], pa.array([o[0] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int32())], ["doc_id", "text", "n_lines_removed", "n_words_removed"])

    return both.mapInArrow(run, "doc_id long, text string, n_lines_removed int, n_words_removed int")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the text that is left and, where there is such a column, its n_chars.

    A document of which no line is left goes. Nulls and repeated rows as in
    dedup(): a null doc_id or text stays with all its columns. An empty table
    gives none.
    """
    both, at = joined(docs, MIN_BLOCK_WORDS)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    names = both.columns[:-1]
    schema = docs.toDF(*names).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, _BATCH):
            texts, gone = b.column(at).to_pylist(), b["gone"].to_pylist()
            changed = [k for k, g in enumerate(gone) if g and texts[k] is not None]
            cols = list(b.columns)[:-1]
            keep = None
            if changed:
                for k in changed:
                    texts[k] = erase(texts[k], gone[k])[0]
                cols[at] = pa.array(texts, pa.string())
                if chars is not None:
                    n = cols[chars].to_pylist()
                    for k in changed:
                        n[k] = len(texts[k])
                    cols[chars] = pa.array(n, cols[chars].type)
                empty = {k for k in changed if not texts[k]}
                keep = pa.array([k not in empty for k in range(len(texts))], pa.bool_())
            out = pa.RecordBatch.from_arrays(cols, names)
            yield out if keep is None else out.filter(keep)

    return both.mapInArrow(run, schema).toDF(*docs.columns)
