"""The pipeline against a slow version of each stage, on rows with nulls, repeats and clashes; each stage is judged on its own input."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import decontam, linededup, packing, simhash, toxicity
from test_brute_force import WORDS, kernel_words, prose, slow_dedup, version_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark."""
    rng = random.Random(21)
    sf = tmp_path_factory.mktemp("sf")
    bad = ["zwixol", "brumpft", "quazzle"]
    items = [(k, prose(rng, 30)) for k in range(4)] + [(9, "short one"), (None, None)]
    passage = [prose(rng, 70) for _ in range(3)]
    texts = []
    for k in range(240):
        w = prose(rng, rng.randrange(40, 160)).split()
        if k % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        t = " ".join(w)
        if k % 10 == 3:
            t += "\n" + passage[k % 3] + "\n" + prose(rng, 20)
        if k % 15 == 7:
            t += " " + items[k % 4][1].upper()
        texts.append(t)
    for k in range(1, 30, 2):  # near copies
        w = texts[k].split()
        for _ in range(max(1, len(w) // 30)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
        texts.append(" ".join(w))
    texts += texts[1:20:2]  # exact ones
    rows = [(k, t, "en", "web" if k % 3 else "book", len(t)) for k, t in enumerate(texts)]
    rows += [(None, "no id but a text of some words", "en", "web", 30), (1000, None, "en", "web", None), (1001, "", None, "web", 0), (1002, "#!?", "en", None, 3), rows[2], (2, prose(rng, 50), "en", "web", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    labels = [(k, int(k % 6 == 0)) for k in range(0, 240, 2)] + [(7, None), (None, 1), (5000, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    return str(sf), items


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def steps(spark, corpus):
    """(name, rows before, rows after) of each stage, chained as run() does."""
    sf, _ = corpus
    now = rows_of(spark.read.parquet(f"{sf}/documents.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = rows_of(stage(spark, spark.createDataFrame(now, SCHEMA).repartition(2), sf))
        out[name] = (now, after)
        now = after
    return out


def test_toxicity(spark, steps, corpus):
    before, after = steps["toxicity"]
    model = toxicity.fit_on(spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{corpus[0]}/labels.parquet"))
    s = model.scorer()
    assert after == [r for r in before if not (s(r[1])[2] > 0 and s(r[1])[0] >= model.threshold)]
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert len([k for k in range(0, 240, 6) if k in gone]) >= 38 and len(gone - set(range(0, 240, 6))) <= 2


def test_line_dedup(spark, steps):
    before, after = steps["line_dedup"]
    docs = [(r[0], r[1]) for r in before if r[0] is not None and r[1] is not None]
    version_of.update({r[0]: r[1] for r in spark.createDataFrame([(t,) for _, t in docs], "t string").selectExpr("t", "hash(t)").collect()})
    gone = slow_dedup(docs, linededup.MIN_BLOCK_WORDS)
    want = []
    for r in before:
        g = gone.get((r[0], r[1]))
        if not g:
            want.append(r)
        elif t := linededup.erase(r[1], sorted(g))[0]:
            want.append((r[0], t, r[2], r[3], len(t)))
    assert after == sorted(want, key=str) and any(g for g in gone.values())
    # every word of the input is left somewhere
    assert {w for r in after for w in kernel_words(r[1] or "")} == {w for r in before for w in kernel_words(r[1] or "")}


def test_simhash(spark, steps, corpus):
    before, after = steps["simhash_near_dedup"]
    came = [tuple(r) for r in spark.read.parquet(f"{corpus[0]}/documents.parquet").select("doc_id", "text").collect()]
    ids = {r[0] for r in before if r[0] is not None and r[1] is not None}
    texts = [(d, t) for d, t in [*((r[0], r[1]) for r in before), *came] if d in ids and t is not None]
    sig = np.frombuffer(b"".join(simhash.signatures([t for _, t in texts])), np.uint8).reshape(-1, 32)
    dist = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(-1)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(dist <= simhash.TAU)):
        a, b = find(texts[i][0]), find(texts[j][0])
        root[max(a, b)] = min(a, b)
    assert after == [r for r in before if r[0] not in ids or r[1] is None or find(r[0]) == r[0]]
    assert not {k for k in range(240, 265)} & {r[0] for r in after}  # no copy is left, exact or near



def test_simhash_without_luck(spark, steps, corpus, monkeypatch):
    """The stage loses no link when its rings find hardly any pair."""
    before, after = steps["simhash_near_dedup"]
    monkeypatch.setattr(simhash, "layout", lambda *_: (48, 1))
    assert rows_of(simhash.stage(spark, spark.createDataFrame(before, SCHEMA), corpus[0])) == after


def test_decontamination(steps, corpus):
    before, after = steps["decontamination"]
    words = [decontam.normal(t) for _, t in corpus[1]]
    runs = {f" {' '.join(w[i : i + 13])} " for w in words if len(w) >= decontam.MIN_WORDS for i in range(max(1, len(w) - 12))}
    want = [r for r in before if not any(x in f" {' '.join(decontam.normal(r[1]))} " for x in runs)]
    assert after == want and len(want) < len(before)


def test_packing(steps):
    before, after = steps["best_fit_packing"]
    back: dict = {}
    for bin_id, bin_size, part, doc_id, start, size, text, lang, source in after:
        assert len(text) == size
        back.setdefault((doc_id, lang, source, text if start == 0 and size < packing.CAPACITY else None), []).append(text)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in before if r[1]), key=str) == sorted(((k[0], t, k[1], k[2]) for k, v in back.items() for t in v), key=str)
    bins: dict = {}
    for r in after:
        bins.setdefault(r[0], []).append((r[2], r[5], r[1]))
    for b in bins.values():
        assert sorted(p for p, _, _ in b) == list(range(len(b))) and sum(s for _, s, _ in b) == b[0][2] <= packing.CAPACITY and sum(3 * s > packing.CAPACITY for _, s, _ in b) <= 2
    sizes = [len(r[1]) for r in before if r[1]]
    assert len(bins) == len(packing.pack(sizes, packing.CAPACITY))


def test_run(spark, corpus, steps):
    """run() gives what the chained stages give: the same pieces, whichever bins alike ones went to."""
    rows = [tuple(r) for r in corpus_pipeline.run(spark, corpus[0]).collect()]
    pieces = lambda rs: sorted((tuple(r[3:]) for r in rs), key=str)
    assert pieces(rows) == pieces(steps["best_fit_packing"][1])


def test_toxicity_edges(spark, corpus):
    """The real scorer on odd rows; labels that conflict, are null or have no document; and texts too long to learn from."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    model = toxicity.fit_on(docs, spark.read.parquet(f"{corpus[0]}/labels.parquet"))
    rows = [(1, None), (2, ""), (None, "zwixol brumpft quazzle zwixol"), (3, "zwixol brumpft quazzle zwixol"), (3, "zwixol brumpft quazzle zwixol"), (4, "word " * 300_000 + "end"), (5, "#!?"), (6, "  zwixol brumpft\n" * 50_000)]
    out = sorted((tuple(r) for r in toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()), key=str)
    by = {r[0]: r for r in out}
    assert len(out) == len(rows) and [by[k][1] for k in (1, 2, 3, 4, 5, 6, None)] == [False, False, True, False, False, True, True]
    assert by[1][2:] == (0.0, 0, 0, 0, None) and by[4][3] > 20_000
    clash = spark.createDataFrame([(*r, "x", True, 1.0) for r in rows], "doc_id long, text string, TEXT string, toxic boolean, score double")
    assert sorted((tuple(r) for r in toxicity.classify(clash, model).collect()), key=str) == out
    twice = spark.createDataFrame([(k, v) for k in range(0, 240, 2) for v in (0, int(k % 6 == 0))], "doc_id long, toxic int")
    assert toxicity.fit_on(docs, twice).threshold == pytest.approx(model.threshold, rel=0.5)
    assert toxicity.fit_on(docs, twice.limit(0)).threshold == float("inf") and toxicity.fit_on(docs.limit(0), twice).threshold == float("inf")
    assert toxicity.fit_on(docs, twice, max_chars=0).threshold == float("inf")
