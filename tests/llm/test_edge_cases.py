"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import pytest

import corpus_pipeline
from quern.llm import decontam, licenses, linededup, minhash, packing, simhash, tokens, toxicity, urlrules, warcindex

LONG = "word " * 60_000 + "end."
ROWS = [(1, "Some ordinary text is here, and more of it."), (1, "Some ordinary text is here, and more of it."), (2, None), (3, ""), (None, "A text without an id stands here."), (4, LONG), (5, "#!? ..."), (6, " \n "), (7, "İstanbul'da ﬁne 🙂 text.")]
MODEL = toxicity.Model(b"", b"", float("inf"))

OPERATORS = {
    "tokens": tokens.token_counts,
    "decontam": lambda d: decontam.contaminated(d, d.sparkSession.createDataFrame([(1, "some ordinary text is here"), (1, None), (None, "x y z u v"), (2, "")], "item_id long, text string")),
    "linededup": linededup.dedup,
    "toxicity": lambda d: toxicity.classify(d, MODEL),
    "simhash": simhash.groups,
    "minhash": minhash.fingerprinted,
    "licenses": licenses.scanned,
    "packing": packing.packed,
}
#: Rows of the result for ROWS, and doc_ids that must or must not be there.
COUNTS = {"tokens": 9, "decontam": 2, "linededup": 9, "toxicity": 9, "simhash": 6, "minhash": 9, "licenses": 0}


def frame(spark, rows, extra=False):
    if extra:
        return spark.createDataFrame([(*r, "x", 1.0, "y", 3, True) for r in rows], "doc_id long, text string, TEXT string, score double, n_tokens string, gone int, keep boolean")
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(spark, name):
    out = OPERATORS[name](frame(spark, ROWS))
    rows = out.collect()
    if name in COUNTS:
        assert len(rows) == COUNTS[name]
    clash = OPERATORS[name](frame(spark, ROWS, True))
    assert clash.columns == out.columns and sorted(map(str, clash.collect())) == sorted(map(str, rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](frame(spark, []))
    assert out.count() == 0 and "doc_id" in out.columns


def test_values(spark):
    df = frame(spark, ROWS)
    t = {(r[0], r[1]): r for r in tokens.token_counts(df).collect()}
    assert (2, None) in t and (3, 0) in t and any(r[0] is None for r in t)
    g = {r["doc_id"]: r for r in simhash.groups(df).collect()}
    assert all(r["keep"] for r in g.values()) and set(g) == {1, 3, 4, 5, 6, 7}
    p = packing.packed(df).collect()
    assert sum(r["size"] for r in p if r["doc_id"] == 4) == len(LONG) and {r["doc_id"] for r in p} == {None, 1, 4, 5, 6, 7} and len([r for r in p if r["doc_id"] == 1]) == 2
    f = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprinted(df).collect()}
    assert f[2] is None and f[3] is None and f[5] is None and len(f[4]) == 128
    d = {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()}
    assert d[2] is None and d[3] == "" and d[4] == LONG


def test_pages(spark):
    rows = [(1, "http://A.example.com:80/x?q=1#top", "<p>"), (1, "http://A.example.com:80/x?q=1#top", "<p>"), (2, None, None), (3, "", ""), (None, "not a url", "x"), (4, "https://www.b.example.org", "y")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    w = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, URL string, position int")
    assert urlrules.apply_rules(p).count() == urlrules.apply_rules(w).count() == 6
    a, b = ([tuple(r) for r in warcindex.indexed(x).orderBy("position").collect()] for x in (p, w))
    assert a == b and [r[0] for r in a] == list(range(6))
    assert [(r[1], r[3]) for r in a][-3:] == [("com,example,a)/x?q=1", 1), ("com,example,a)/x?q=1", 2), ("org,example,b)/", 1)]
    none = p.limit(0)
    assert urlrules.apply_rules(none).count() == 0 and warcindex.indexed(none).count() == 0


def test_licenses_of_odd_rows(spark):
    mit = licenses.TEMPLATES["MIT/line"]
    rows = [(1, mit), (1, mit), (None, mit), (2, f"{mit}\n{mit}"), (3, mit.upper()), (4, "word " * 60_000 + mit), (5, "license"), (6, None), (7, ""), (8, "software license " * 300)]
    out = sorted((str(r["doc_id"]), r["license"], r["exact"]) for r in licenses.scanned(frame(spark, rows)).collect())
    assert out == sorted((d, "MIT/line", True) for d in ("1", "1", "None", "2", "2", "3", "4"))
    assert sorted(map(str, licenses.scanned(frame(spark, rows, True)).collect())) == sorted(map(str, licenses.scanned(frame(spark, rows)).collect()))
    many = licenses.scanned(frame(spark, rows), {"a": mit, "b": mit, "c": ""}).where("doc_id = 1").collect()
    assert {r["license"] for r in many} == {"a"}  # of equal templates the first


def test_long_urls(spark):
    long = "http://www.example.com/" + "a/" * 50_000 + "ads/x?page=9"
    p = spark.createDataFrame([(1, long, "x"), (2**63 - 1, long, "y" * 100_000)], "page_id long, url string, html string")
    assert [("ad-path" in r["rules"].split(","), "deep-page" in r["rules"].split(",")) for r in urlrules.apply_rules(p).collect()] == [(True, True)] * 2
    assert sorted(len(r["url_key"]) for r in warcindex.indexed(p).collect()) == [len("com,example)/") - 1 + len(long) - len("http://www.example.com/") + 1] * 2


def test_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ROWS]
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "never seen words stand in this one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{len(data)}-{k}"))
            out = spark.read.parquet(str(tmp_path / f"{len(data)}-{k}"))
            if k < 4:
                assert out.columns == docs.columns
                assert out.count() == len(data), name
                docs = out
        assert (out.count() > 0) == bool(data)
