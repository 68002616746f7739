"""Each operator against a slow and simple version of itself, or an exact round trip."""

import random
import re
import textwrap

import numpy as np
import pytest

import __spark_entry__
from quern.llm import decontam, kernel, licenses, linededup, minhash, packing, simhash, tokens, toxicity, urlrules, warcindex

SF = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "nrstlmk"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- words


def test_words_and_windows():
    rng = random.Random(1)
    texts = [prose(rng, 30), "", None, "Ünïcode Wörds—and “quotes”, too…", "x", "a_b 12 c3"]
    w = kernel.words(texts)
    at = lambda k: [w.data[s:e].decode() for s, e in zip(w.start[w.bound[k] : w.bound[k + 1]], w.end[w.bound[k] : w.bound[k + 1]])]
    for k, t in enumerate(texts):
        assert at(k) == re.findall(r"\w+", (t or "").lower())
    by = {}
    for k in range(len(texts)):
        for word, h in zip(at(k), w.hash[w.bound[k] : w.bound[k + 1]]):
            assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)
    h, doc = kernel.windows(w, 3)
    seen = {}
    n = 0
    for k in range(len(texts)):
        ws = at(k)
        for i in range(max(1, len(ws) - 2)) if ws else ():
            assert seen.setdefault(tuple(ws[i : i + 3]), h[n]) == h[n] and doc[n] == k
            n += 1
    assert n == len(h) and len(set(seen.values())) == len(seen)


# --- 1


def test_token_counts(spark):
    enc = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    rng = random.Random(2)
    texts = [prose(rng, 20_000), "  lead and\n\n\ttrail  ", "don't <|endoftext|> 12345", "x" * 100_000, "été " * 20_000 + "\n\n \n" * 9_000 + "z"]
    assert all("".join(tokens.pieces(t, 100)) == t for t in texts)
    got = [r["n_tokens"] for r in tokens.token_counts(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [len(enc.encode_ordinary(t)) for t in texts]
    assert all(sum(len(enc.encode_ordinary(p)) for p in tokens.pieces(t, 64)) == n for t, n in zip(texts, got))
    sizes = [rng.randrange(1, 5000) for _ in range(300)]
    parts = tokens.balanced(sizes, 50_000)
    assert sorted(i for b in parts for i in b) == list(range(300)) and max(sum(sizes[i] for i in b) for b in parts) - min(sum(sizes[i] for i in b) for b in parts) <= 5000


# --- 2


@pytest.mark.parametrize("most", [decontam.MAX_CHARS, 500])
def test_decontamination(spark, most):
    rng = random.Random(3)
    items = [(k, prose(rng, rng.choice([1, 3, 7, 30]))) for k in range(12)] + [(20, None), (None, "alone without id"), (None, "a second one"), (21, "..."), (3, "item three has another text too"), (3, "item three has another text too")]
    texts = []
    for k in range(40):
        t = prose(rng, 60)
        if k % 3 == 0:
            _, item = items[k % 12]
            part = item.split()[:20] if k % 2 else item.split()
            t = t + "\nİ! " + ", ".join(part).upper() + "; " + prose(rng, 10)
        texts.append(t)
    texts.append("Alone, without ID: a second one! Item three has another text, too")
    rows = decontam.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), most=most).collect()
    got = [(r["doc_id"], r["item_id"], r["start"], r["end"], r["n_words"], r["share"]) for r in rows]
    want = set()
    for d, t in enumerate(texts):
        w, pos = decontam.normal(t), [m.span() for m in re.finditer(r"\w+", t)]
        for k, item in set(items):
            x = decontam.normal(item)
            n = min(len(x), decontam.RUN)
            marks = np.zeros(len(w) + 1, bool)
            for i in range(len(w) - n + 1 if n else 0):
                if any(w[i : i + n] == x[j : j + n] for j in range(len(x) - n + 1)):
                    marks[i : i + n] = True
            i = 0
            while i < len(w):
                if marks[i]:
                    j = i
                    while marks[j]:
                        j += 1
                    want.add((d, k, pos[i][0], pos[j - 1][1], j - i, min(1.0, (j - i) / len(x))))
                    i = j
                i += 1
    assert set(got) == want and len(got) == len(want) and {None, 3} <= {g[1] for g in got if g[0] == 40}


def test_decontamination_of_string_ids(spark):
    out = decontam.contaminated(frame(spark, ["what is the capital of it"]), spark.createDataFrame([("q-1", "The capital"), ("q-2", "Not here")], "item_id string, text string"))
    assert [tuple(r) for r in out.collect()] == [(0, "q-1", 8, 19, 2, 1.0)]


# --- 3


def test_line_dedup(spark):
    rng = random.Random(4)
    passage = [prose(rng, 70) for _ in range(4)]
    texts = [prose(rng, 200) for _ in range(12)]
    for k in range(1, 12, 2):
        w = texts[k].split()
        at = rng.randrange(10, 150)
        texts[k] = " ".join(w[:at]) + " " + passage[k % 4] + "\n" + " ".join(w[at:])
    texts += [texts[0], texts[2] + " " + texts[4], passage[1] + "\n" + prose(rng, 5) + "\n" + passage[3]]
    new = {r["doc_id"]: r["text"] for r in linededup.dedup(frame(spark, texts)).collect()}
    n = 50
    seen: set = set()
    for d, t in enumerate(texts):
        w, left = kernel_words(t), kernel_words(new[d])
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        repeated = grams & seen
        assert not repeated & {tuple(left[i : i + n]) for i in range(len(left) - n + 1)}, d
        if not repeated and not any(tuple(w[i : i + 12]) in seen for i in range(len(w) - 11)):
            assert new[d] == t
        seen |= grams | {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    assert new[12] == "" and new[0] == texts[0]
    # what is deleted is in an earlier document: every word run that is left out occurs there
    assert all(w in set(kernel_words(" ".join(texts))) for t in new.values() for w in kernel_words(t))
    assert linededup.increasing([5, 1, 2, 9, 3]) in ([1, 2, 4], [1, 2, 3])


def test_line_dedup_short_lines(spark):
    rng = random.Random(16)
    texts, copies = [], []
    for longest in (1, 2, 3, 4):
        for _ in range(30):
            rows = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, longest))) for _ in range(60)]
            rows = rows[: next(k for k in range(60) if sum(len(r.split()) for r in rows[: k + 1]) >= 59) + 1]
            texts += ["\n".join([prose(rng, 40), *rows, prose(rng, 40)]) for _ in range(2)]
            copies.append(kernel_words("\n".join(rows)))
    new = {r["doc_id"]: kernel_words(r["text"]) for r in linededup.dedup(frame(spark, texts)).collect()}
    for k, block in enumerate(copies):
        first, second = (kernel_words(t) for t in texts[2 * k : 2 * k + 2])
        left = {tuple(new[2 * k + 1][i : i + 40]) for i in range(len(new[2 * k + 1]) - 39)}
        assert new[2 * k] == first and len(second) - len(new[2 * k + 1]) >= linededup.MIN_BLOCK_WORDS
        assert not left & {tuple(block[i : i + 40]) for i in range(len(block) - 39)}


def kernel_words(t):
    return re.findall(r"\w+", t.lower())


def slow_dedup(docs, least):
    """Lines (as sets of numbers) that go from each (id, text): every pair, every place, no hashes of runs."""

    def split(t):
        w = kernel.words([t])
        first, count, _ = linededup.lines(w)
        have = [w.data[s:e].decode() for s, e in zip(w.start, w.end)]
        return [tuple(have[f : f + n]) for f, n in zip(first, count)]

    lines = [split(t) for _, t in docs]
    order = sorted(set(docs), key=lambda d: (d[0], version(d[1])))
    first_of = {d: k for k, d in enumerate(docs)}
    out = {}
    for n, later in enumerate(order):
        mine, gone = lines[first_of[later]], set()
        for earlier in order[:n]:
            other = lines[first_of[earlier]]
            for i in range(len(mine)):
                for j in range(len(other)):
                    size = k = 0
                    while size < least and i + k < len(mine) and j + k < len(other) and mine[i + k] == other[j + k]:
                        size += len(mine[i + k])
                        k += 1
                    if size >= least:
                        gone.update(range(i, i + k))
            k = size = 0  # what both end with
            while size < least and k < min(len(mine), len(other)) and mine[-1 - k] == other[-1 - k]:
                size += len(mine[-1 - k])
                k += 1
            if size >= least:
                gone.update(range(len(mine) - k, len(mine)))
        out[later] = gone
    return out


version_of = {}


def version(text):
    return version_of[text]


@pytest.mark.parametrize("seed", range(6))
def test_line_dedup_against_all_pairs(spark, seed):
    rng = random.Random(100 + seed)
    parts = [prose(rng, rng.randrange(5, 60)) + rng.choice([".\n", " "]) for _ in range(12)]
    docs = []
    for _ in range(40):
        chosen = [rng.choice(parts) if rng.random() < 0.7 else prose(rng, rng.randrange(1, 40)) + "\n" for _ in range(rng.randrange(1, 7))]
        if rng.random() < 0.3:
            chosen += chosen[::-1]
        docs.append((rng.randrange(30), "".join(chosen)))
    docs += [docs[3], (docs[3][0], docs[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    version_of.update({r[0]: r[1] for r in df.selectExpr("text", "hash(text)").collect()})
    want = {d: g for d, g in slow_dedup(docs, linededup.MIN_BLOCK_WORDS).items() if g}
    got = {(r["doc_id"], r["version"]): set(r["gone"]) for r in linededup.deletions(df).collect()}
    assert got == {(d, version(t)): g for (d, t), g in want.items()} and len(got) > 5
    # every line stays somewhere
    left = {w for r in linededup.dedup(df).collect() for w in kernel_words(r["text"])}
    assert left == {w for _, t in docs for w in kernel_words(t)}


def test_line_dedup_repeated_ids(spark):
    rng = random.Random(17)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (2, a), (2, b), (2, b)]
    out = sorted((r["doc_id"], r["text"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == sorted([(1, a), (2, ""), (2, b), (2, b)])


def test_alignment():
    # lines in reverse order, no two adjacent in the earlier document, share no run at all
    assert linededup.aligned([]) == []
    # anchors cross: both blocks are found, the second by another turn
    found = [(i, 10 + i, 3, True) for i in range(4)] + [(i, i - 8, 3, True) for i in range(8, 12)]
    assert sorted(linededup.aligned(found)) == [[0, 10, 6], [8, 0, 6]]
    # a run that both have twice is nobody's anchor, and is aligned all the same
    assert sorted(linededup.aligned([(0, 0, 2, False), (0, 9, 2, False), (5, 0, 2, False), (5, 9, 2, False)]))
    assert linededup.decide([(4, 2, "h", 0, True), (5, 2, "h", 1, True), (9, 3, "g", 7, True)]) == [4, 5, 6, 9, 10, 11]


def test_erase_offsets():
    t = "\n İİ first words of one line here. Second line has these other words. Third ones close it all now.  "
    w = kernel.words([t])
    first, count, _ = linededup.lines(w)
    assert len(first) > 2
    for k in range(len(first)):
        out, n, gone, _ = linededup.erase(t, [k])
        assert n == len(first) and gone == 1 and len(kernel.words([out]).hash) == len(w.hash) - count[k]
        assert out.startswith("\n ") and (k + 1 == len(first) or out.endswith("now.  "))
    assert linededup.erase(t, list(range(len(first))))[0] == "" and linededup.erase(t, [])[0] == t


def test_long_texts():
    """A text of many blocks has the hashes of its parts."""
    rng = random.Random(18)
    t = " ".join(prose(rng, 50) for _ in range(9000)) + " " + "x" * (3 * kernel.BLOCK) + " end"
    w = kernel.words([t])
    some = t.split()
    at = [0, 1, 200_000, 449_999, len(some) - 2, len(some) - 1]
    assert len(w.hash) == len(some) and [int(w.hash[k]) for k in at] == [int(kernel.words([some[k]]).hash[0]) for k in at]


# --- 4 and 7


def test_url_rules(spark):
    rng = random.Random(5)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['ads.', 'www.', 'm.', 'blog.'])}{rng.choice(['x', 'ad', 'shop'])}.example.{rng.choice(['com', 'net', 'xyz'])}/{rng.choice(['ads', 'login', 'docs', 'fr'])}/{rng.choice(['7', '12', ''])}{rng.choice(['', '?page=9', '?utm_a=1', '#top'])}" for _ in range(300)]
    out = {r["page_id"]: r for r in urlrules.apply_rules(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), most=400).collect()}
    rules = [urlrules.compile_rule(n, r) for n, r in urlrules.RULES]
    for k, u in enumerate(urls):
        hit = [r for r in rules if re.search(r.regex, u.lower())]
        assert out[k]["rules"] == ",".join(sorted(r.name for r in hit))
        assert out[k]["blocked"] == (any(not r.allow for r in hit) and not any(r.allow for r in hit))
    odd = [("a,b", "/ads/"), ("a", "/login^"), ("", "/fr/")]
    one, several = ([tuple(r) for r in urlrules.apply_rules(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), odd, most=m).orderBy("page_id").collect()] for m in (10**6, 1))
    assert one == several and any(r[2] == "a,b" for r in one)
    idx = urlrules.index(rules, {"ads": 5, "login": 1})
    assert sum(map(len, idx.values())) == len(rules)


def test_loser_tree_and_history(spark):
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert [runs[s][i] for s, i in warcindex.LoserTree(runs)] == sorted(x for r in runs for x in r)
    rows = [(k, f"http://h{rng.randrange(4)}.example.com/{rng.randrange(3)}", "x", f"2020{rng.randrange(10**10):010d}") for k in range(500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at string").repartition(7)
    out = [tuple(r) for r in warcindex.indexed(df, "at", range_rows=40).orderBy("position").collect()]
    want = sorted(((",".join(reversed(u.split("/")[2].split("."))) + ")/" + u.split("/")[3], at, p) for p, u, _, at in rows))
    assert [(r[1], r[2], r[4]) for r in out] == want and [r[0] for r in out] == list(range(500))
    n = {}
    for r in out:
        n[r[1]] = n.get(r[1], 0) + 1
        assert r[3] == n[r[1]]


def test_page_ids_of_any_size(spark):
    ids = [0, 2**63 - 1, -(2**63), 3 * 10**11, 10**18, warcindex.DATED[0], warcindex.DATED[1], warcindex.DATED[1] + 1, None]
    out = {r["page_id"]: r["timestamp"] for r in warcindex.indexed(spark.createDataFrame([(k, "http://a.b/", "x") for k in ids], "page_id long, url string, html string")).collect()}
    assert out == {k: None for k in ids} | {0: "20200101000000", warcindex.DATED[0]: "00010101000000", warcindex.DATED[1]: "99991231235959"}
    same = spark.createDataFrame([(None, None, None)] * 300, "page_id long, url string, html string").repartition(3)
    assert [r["position"] for r in warcindex.indexed(same, range_rows=50).orderBy("position").collect()] == list(range(300))


# --- 5


def test_toxicity_held_out():
    rng = random.Random(7)
    bad = ["zwixol", "brumpft", "quazzle"]
    texts, toxic = [], []
    for k in range(400):
        w = prose(rng, rng.randrange(30, 200)).split()
        t = k % 5 == 0
        if t:
            for _ in range(max(1, len(w) // 50)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        toxic.append(t)
    m = toxicity.fit(texts[:300], toxic[:300])
    s = m.scorer()
    got = [s(t)[0] >= m.threshold for t in texts[300:]]
    assert sum(a == b for a, b in zip(got, toxic[300:])) >= 97
    assert m.held_out["f1"] > 0.9 and s(None)[0] == 0 and s("")[0] == 0
    none = toxicity.fit(texts[:3], [False] * 3)
    assert none.scorer()(texts[0])[2] == 0


# --- 6


def test_simhash_recall_and_groups(spark):
    rng = random.Random(8)
    base = [prose(rng, rng.randrange(60, 250)) for _ in range(60)]
    texts = list(base)
    for k in range(120):
        w = base[k % 60].split()
        for _ in range(max(1, int(len(w) * rng.choice([0.01, 0.03, 0.06])))):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
        texts.append(" ".join(w))
    texts += base[:20] * 3
    sig = np.frombuffer(b"".join(simhash.signatures(texts)), np.uint8).reshape(-1, 32)
    one = np.frombuffer(simhash.signatures([texts[3]])[0], np.uint8)
    assert (one == sig[3]).all()
    want = all_near(sig)
    got = found_near(sig, 4096)
    assert got <= want and len(got) >= 0.99 * len(want)
    out = {r["doc_id"]: r for r in simhash.groups(frame(spark, texts)).collect()}
    for k in range(120):
        assert out[60 + k]["group_id"] == k % 60 and not out[60 + k]["keep"]
    assert sum(r["keep"] for r in out.values()) == 60


def all_near(sig, tau=simhash.TAU):
    dist = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(-1)
    return {(i, j) for i in range(len(sig)) for j in range(i + 1, len(sig)) if dist[i, j] <= tau}


def turned(sig):
    width, rings = simhash.layout(len(sig))
    seg = simhash.laid_out(sig, rings)
    key = simhash.keys(seg, rings, width).ravel()
    ring = np.stack([np.roll(seg.reshape(len(sig), rings, 16), -k, 2) for k in range(16)], 2).reshape(-1, 16)
    idx = np.repeat(np.arange(len(sig)), rings * 16)
    order = np.argsort(key, kind="stable")
    return key[order], np.ascontiguousarray(ring[order]), idx[order]


def found_near(sig, large):
    key, ring, idx = turned(sig)
    return {(min(x, y), max(x, y)) for i, j in simhash.near(key, ring, large=large) for x, y in zip(idx[i].tolist(), idx[j].tolist())}


@pytest.mark.parametrize("d, least", [(0, 1), (5, 1), (10, 1), (15, 1), (20, 0.999), (25, 0.999), (30, 0.995), (35, 0.99), (38, 0.97), (40, 0.96)])
def test_simhash_recall_by_distance(d, least):
    rng = np.random.default_rng(d)
    n = 1000
    sig = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    flip = np.zeros((n, 256), np.uint8)
    for row in flip:
        row[rng.permutation(256)[:d]] = 1
    both = np.concatenate((sig, sig ^ np.packbits(flip, axis=1)))
    got = found_near(both, 4096)
    assert sum((k, k + n) in got for k in range(n)) >= least * n


def test_simhash_layout():
    """Buckets don't grow with the table, and recall doesn't fall."""
    for n in (10, 10**5, 10**7, 10**9, 5 * 10**10):
        width, rings = simhash.layout(n)
        assert n / 2**width <= simhash.BUCKET and 1 - (1 - simhash.hit_rate(width)) ** (16 * rings) >= simhash.RECALL
    # the rate, by trying it out
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(40_000):
        bits = np.zeros(256, int)
        bits[rng.permutation(256)[: simhash.TAU]] = 1
        s = bits.reshape(16, 16).sum(1)
        hits += s[0] == 0 and all(s[:l].sum() * 16 <= l * simhash.TAU for l in (2, 3, 4))
    assert abs(hits / 40_000 - simhash.hit_rate(16)) < 0.006


def test_simhash_large_and_hot_buckets(spark):
    """Leaders, and tiles of hot keys, link what all pairs link."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (3, 32), dtype=np.uint8)
    rows = []
    for k in range(240):
        b = np.unpackbits(base[k % 3])
        b[16:][rng.permutation(240)[: rng.integers(0, 40)]] ^= 1
        rows.append(np.packbits(b))
    sig = np.unique(np.array(rows), axis=0)
    dist = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(-1)

    def roots(pairs):
        x, y = simhash.forest(*(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)))
        return dict(zip(x.tolist(), y.tolist()))

    seg = np.ascontiguousarray(sig.view(">u2").astype(np.uint16))
    same = np.all(sig[:, None, :2] == sig[None, :, :2], axis=2)
    want = roots([(i, j) for i in range(len(sig)) for j in range(i) if dist[i, j] <= simhash.TAU and same[i, j]])
    for _, rows_ in {tuple(s[:2]): [k for k in range(len(sig)) if (sig[k, :2] == s[:2]).all()] for s in sig}.items():
        got = roots([(rows_[a], rows_[b]) for i, j in simhash.led(seg[rows_], simhash.TAU) for a, b in zip(i.tolist(), j.tolist())])
        assert got == {k: v for k, v in want.items() if k in rows_}
    df = spark.createDataFrame([(k, bytes(s)) for k, s in enumerate(sig)], "doc_id long, sig binary").repartition(3)
    plain, tiled = ({tuple(r) for r in simhash.components(simhash.edges(df, hot=h)).collect()} for h in (10**6, 20))
    assert plain == tiled == set(roots(all_near(sig)).items())



def at_distance(rng, n, d):
    """n signatures, and n that differ from them in d bits each."""
    sig = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    flip = np.zeros((n, 256), np.uint8)
    for row in flip:
        row[rng.permutation(256)[:d]] = 1
    return np.concatenate((sig, sig ^ np.packbits(flip, axis=1)))


def test_simhash_loses_no_link(spark, monkeypatch):
    """Pairs at just TAU bits, of which the rings leave some out, and none at one more; in one block and in several."""
    rng = np.random.default_rng(40)
    sig = np.concatenate((at_distance(rng, 1000, simhash.TAU), at_distance(rng, 300, simhash.TAU + 1)))
    df = spark.createDataFrame([(k, bytes(s)) for k, s in enumerate(sig)], "doc_id long, sig binary").repartition(3)
    want = [*range(1000), *range(1000), *range(2000, 2600)]
    assert len(found_near(sig, 4096)) < 1000
    whole = simhash.left_out
    for block in (simhash.BLOCK, 600):
        monkeypatch.setattr(simhash, "left_out", lambda sigs, root, tau, block=block: whole(sigs, root, tau, block))
        assert [r["group_id"] for r in simhash.grouped(df).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("n, tau, few", [(900, 40, 64), (900, 40, 2), (600, 60, 64), (500, 5, 2), (200, 0, 64), (1, 40, 64), (0, 40, 64)])
def test_simhash_across(n, tau, few):
    """All pairs, with uneven bits and rows that are in groups already; within a table and between two."""
    rng = np.random.default_rng(n + tau)
    bits = (rng.random((n, 256)) < rng.random(256) * 0.6 + 0.2).astype(np.uint8)
    for k in range(n // 2):
        bits[n // 2 + k] = bits[k]
        bits[n // 2 + k][rng.permutation(256)[: rng.integers(max(0, tau - 3), tau + 4)]] ^= 1
    sig, ids = np.packbits(bits, axis=1), rng.permutation(n) + 1000
    of = ids.copy()
    of[: n // 5] = min(ids[: n // 5], default=0)
    i, j = (np.array(c, np.int64) for c in zip(*(all_near(sig, tau) or {(0, 0)})))

    def roots(*pairs):
        a, b = simhash.forest(*(np.concatenate([p[k] for p in pairs]) for k in (0, 1)))
        return dict(zip(a.tolist(), b.tolist()))

    want = roots((of, ids), (ids[i], ids[j])) if n else {}
    h = n // 3
    assert roots((of, ids), simhash.across(sig, of, None, None, tau, few)) == want
    assert roots((of, ids), simhash.across(sig[:h], of[:h], sig[h:], of[h:], tau, few), *(simhash.across(sig[s], of[s], None, None, tau, few) for s in (slice(h), slice(h, None)))) == want



def test_simhash_hot_keys_by_pieces(spark):
    """No key with more rows is missed, however small the pieces."""
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 256, (3000, 32), dtype=np.uint8)
    sig[:1200, 4:8], sig[500:, 10:12] = 7, 9
    df = spark.createDataFrame([(k, bytes(s)) for k, s in enumerate(sig)], "doc_id long, sig binary").repartition(2)
    key, c = np.unique(simhash.keys(simhash.laid_out(sig, 2), 2, 16), return_counts=True)
    for rows in (100, 1 << 17):
        got = {r["hot_key"]: r["tiles"] for r in simhash.hot_keys(df, 3000, 16, 2, 1000, rows).collect()}
        assert set(key[c > 1000].tolist()) <= set(got) and all(got[k] * 1000 >= n for k, n in zip(key.tolist(), c.tolist()) if n > 1000)


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root) if find(x) != x}
    a, b = np.array(links).T
    x, y = simhash.forest(a, b)
    assert dict(zip(x.tolist(), y.tolist())) == got


# --- 8


def test_minhash():
    rng = random.Random(10)
    a = [rng.choice(WORDS) for _ in range(400)]
    for share in (1.0, 0.8, 0.4, 0.0):
        b = a[: int(400 * share)] + [rng.choice(WORDS) + "q" for _ in range(400 - int(400 * share))]
        ta, tb = " ".join(a), " ".join(b)
        sa, sb = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        j = len(sa & sb) / len(sa | sb)
        for bits in (1, 4, 8, 16):
            n, f, p = minhash.fingerprints([ta, tb], bins=512, bits=bits)
            assert n == [len(sa), len(sb)] and len(p[0]) == 512 * bits // 8
            assert abs(minhash.estimate(p[0], p[1], bits) - j) < 0.15
    n, f, p = minhash.fingerprints(["one two", None, "", " ".join(a)] + [" ".join(a)])
    assert n[:3] == [1, 0, 0] and p[1] is None and p[2] is None and f[0] == 1 and p[3] == p[4] and len(set(p[0])) == 1
    # densification by one bin at a time
    values, empty = np.array([[5, 0, 0, 9]], np.uint64), np.array([[False, True, True, False]])
    want = values.copy()
    for k in (1, 2):
        t = 1
        while empty[0, minhash.sequence(4, t)[k]]:
            t += 1
        want[0, k] = values[0, minhash.sequence(4, t)[k]]
    assert (minhash.densify(values, empty) == want).all()


# --- 9


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_license_templates(name):
    s = licenses.Scanner()
    rng = random.Random(11)
    (r,) = s.scan(prose(rng, 30) + "\n" + licenses.TEMPLATES[name] + "\n" + prose(rng, 30))
    assert r[3] == name and r[7] and r[6] == 1.0 and (r[1], r[2]) == (1, 1)


def test_license_wording():
    s = licenses.Scanner()
    (r,) = s.scan(licenses.TEMPLATES["MIT/text"].replace("free of charge", "for a fee").replace(". ", ".\n"))
    assert r[3] == "MIT/text" and not r[7] and "charge" in r[8]
    assert s.scan("This license plate is new.") == [] and s.scan("All software has damages, they say.") == []


@pytest.mark.parametrize("name", licenses.TEMPLATES)
@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_license_wrapped(name, mark):
    rng = random.Random(13)
    parts = re.split(r"(?<=[.:;]) (?=[A-Z1-9])", licenses.TEMPLATES[name])
    rows = f"\n{mark.rstrip()}\n".join("\n".join(mark + x for x in textwrap.wrap(p, 72)) for p in parts)
    (r,) = licenses.Scanner().scan(prose(rng, 30) + "\n" + rows + "\n" + prose(rng, 30))
    assert r[3] == name and r[7] and (r[1], r[2]) == (1, 1 + rows.count("\n"))


@pytest.mark.parametrize("n", [1000, 5000, 20000])
def test_license_in_long_line(n):
    rng = random.Random(14)
    s = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        (r,) = s.scan(f"{prose(rng, n // 2)} {text} {prose(rng, n // 2)}")
        assert r[3] == name and r[7] and r[4] >= licenses.LEAST_SAVED


@pytest.mark.parametrize("between", [" ", "\n", "\n\n"])
def test_licenses_side_by_side(between):
    s = licenses.Scanner()
    assert [(r[0], r[3], r[7]) for r in s.scan(f"Released under the MIT License.{between}Licensed under the Apache License, Version 2.0.")] == [(0, "MIT/line", True), (1, "Apache-2.0/line", True)]
    names = [*licenses.TEMPLATES, *licenses.TEMPLATES]
    random.Random(15).shuffle(names)
    assert [(r[3], r[7]) for r in s.scan(between.join(licenses.TEMPLATES[n] for n in names))] == [(n, True) for n in names]


# --- 10


def test_packing(spark):
    rng = random.Random(12)
    for cap in (10, 100):
        sizes = [rng.randrange(1, cap + 1) for _ in range(400)]
        bins = packing.pack(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(400))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins) and all(sum(3 * sizes[i] > cap for i in b) <= 2 for b in bins)
        assert [sorted(b) for b in bins] == [sorted(b) for b in slow_pack(sizes, cap)]
        assert len(bins) <= 1.25 * sum(sizes) / cap + 1
    texts = [prose(rng, rng.randrange(1, 4000)) for _ in range(60)]
    rows = packing.packed(frame(spark, texts), 2000, group_items=20).collect()
    back = {}
    for r in rows:
        back.setdefault(r["doc_id"], []).append((r["start"], r["size"]))
    assert all("".join(texts[d][s : s + n] for s, n in sorted(v)) == texts[d] for d, v in back.items()) and len(back) == 60
    full = {}
    for r in rows:
        full[r["bin_id"]] = full.get(r["bin_id"], 0) + r["size"]
    assert all(full[r["bin_id"]] == r["bin_size"] <= 2000 for r in rows)


def test_packing_alike_rows(spark, monkeypatch):
    """Rows that are alike are packed each, in whichever group; sizes add up on both sides of every limit."""
    monkeypatch.setattr(packing, "COPIES", 7)
    rows = [(1, "ab")] * 50 + [(None, "xyz")] * 20 + [(k, "q" * (k % 9)) for k in range(60)]
    for group_items in (10, 10_000):
        out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), 10, group_items=group_items).collect()
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in out)
        assert got == sorted((-1 if d is None else d, len(t)) for d, t in rows if t)
        full = {}
        for r in out:
            full[r["bin_id"]] = full.get(r["bin_id"], 0) + r["size"]
        assert all(full[r["bin_id"]] == r["bin_size"] <= 10 for r in out)
    big = packing.packed(spark.createDataFrame([(1, 3_000_000_000), (2, 5)], "doc_id long, z long"), 1 << 24, "z").collect()
    assert sum(r["size"] for r in big) == 3_000_000_005 and max(r["start"] for r in big if r["doc_id"] == 1) == 3_000_000_000 // (1 << 24) * (1 << 24)


def test_packing_stage(spark):
    rows = [(1, "ab", "e", "s"), (1, "ab", "e", "s"), (1, "abc", "e", "s"), (None, "xyz", None, "s"), (None, "xyz", None, None), (2, None, "e", "s"), (3, "", "e", "s"), (4, "q" * 10_000 + "z" * 10_000, "e", "s")]
    out = packing.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "").collect()
    pieces = sorted(((r["doc_id"], r["start"], r["text"], r["lang"], r["source"]) for r in out), key=str)
    want = [r[:1] + (0,) + r[1:] for r in rows[:5]] + [(4, k, rows[7][1][k : k + 8192], "e", "s") for k in (0, 8192, 16384)]
    assert pieces == sorted(want, key=str) and all(r["size"] == len(r["text"]) for r in out)


def slow_pack(sizes, cap):
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    large, small = [i for i in order if 3 * sizes[i] > cap], [i for i in order if 3 * sizes[i] <= cap]
    bins = []
    while large:
        b = [large.pop(0)]
        fit = [i for i in large if sizes[i] <= cap - sizes[b[0]]]
        if fit:
            b.append(fit[0])
            large.remove(fit[0])
        bins.append(b)
    room = [cap - sum(sizes[i] for i in b) for b in bins]
    turn = {j: -j for j in range(len(bins))}  # of bins with equal room, the one that got it last
    clock = 0
    for i in small:
        fit = [j for j in range(len(bins)) if room[j] >= sizes[i]]
        clock += 1
        if fit:
            j = min(fit, key=lambda j: (room[j], -turn[j]))
        else:
            bins.append([])
            room.append(cap)
            j = len(bins) - 1
        bins[j].append(i)
        room[j] -= sizes[i]
        turn[j] = clock
    return bins


# --- the registered queries, and the pipeline


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)] + ["pipeline"])
def test_query(spark, name):
    qs = __spark_entry__.queries()
    (key,) = [k for k in qs if k == name or name.endswith("_") and k.startswith(name)]
    assert qs[key](spark, SF).count() > 0
