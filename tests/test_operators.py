"""Formatters, masking, entities, passages, chunks, scores."""

import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import chunks, evaluation, formatters, ner, perplexity, pii, toxic
from quern.sources import tables


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_formatters(spark):
    assert one(spark, "“a”—b，c１…【x】５％", formatters.punctuation) == '"a" - b,c"...[x]５%'
    assert one(spark, "“a”", lambda c: formatters.punctuation(c, {"“": "<<"})) == "<<a”"
    assert one(spark, " \t f\u2003f\u00a0\u200bf\tg \n", formatters.whitespace) == "f f  f\tg"
    assert one(spark, "ab AB a1", lambda c: formatters.regex(c, ["r'(a)(b)'", "x"], [r"\2\1"], [re.IGNORECASE, 0])) == "ba BA a1"
    assert one(spark, "a.b\nc", lambda c: formatters.regex(c, ["a.*c"], ["$1"], [re.DOTALL])) == "$1"
    assert one(spark, None, formatters.unicode_fix) is None
    for dirty, clean in [("sÃ­, claro", "sí, claro"), ("schÃ¶n", "schön"), ("âœ” No problems", "✔ No problems"), ("&lt;3 &amp; more", "<3 & more"), ("e\u0301", "é"), ("ﬁne “quotes”\r\n", 'fine "quotes"\n'), ("plain", "plain"), ("Ã© and €", "é and €")]:
        assert formatters.repair(dirty) == clean
    with pytest.raises(ValueError, match="NFC"):
        formatters.unicode_fix(F.col("t"), "NFX")


def _luhn(m):
    d = [int(c) for c in m if c in "0123456789"]
    return bool(d) and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0


def _bsn(m):
    d = [int(c) for c in m if c in "0123456789"]
    return len(d) == 9 and sum(a * b for a, b in zip(d, (9, 8, 7, 6, 5, 4, 3, 2, -1))) % 11 == 0


def _iban(m):
    t = re.sub(r"\s", "", m, flags=re.ASCII).upper()
    return bool(re.match(pii._IBAN, t)) and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def masker(spec):
    """mask_text() of one string, match by match."""
    masks = [spec.mask] if isinstance(spec.mask, str) else list(spec.mask)
    valid = {None: lambda m: True, pii.luhn: _luhn, pii.bsn: _bsn, pii.iban: _iban}[spec.validator]
    r = spec.keyword_range if spec.keywords else 0

    def mask(text):
        used = []

        def one(m):
            near = text[max(0, m.start() - r) : m.end() + r].lower()
            if (r and not any(k in near for k in spec.keywords)) or not valid(m[0]):
                return m[0]
            used.append(masks[len(used) % len(masks)])
            return used[-1]

        return re.compile(spec.pattern, re.ASCII).sub(one, text), used

    return mask


CASES = [
    ("CreditCardNumber", "pay 4111 1111 1111 1111 now", "pay <credit_card_number> now"), ("CreditCardNumber", "pay 4111 1111 1111 1112 now", None), ("IBAN", "to NL91 ABNA 0417 1643 00.", "to <iban>."), ("IBAN", "to NL92 ABNA 0417 1643 00.", None),
    ("CreditCardExpiryDate", "exp 09/27", "exp <credit_card_expiry_date>"), ("CreditCardCVVCode", "cvv 123.", "cvv <credit_card_cvv_code>."), ("CreditCardCVVCode", "12:345", None), ("EuropeanVATNumber", "DE123456789", "<european_vat_number>"),
    ("EmailAddress", "(a.b@example.com)", "(<e-mail_address>)"), ("IPAddress", "at 192.168.1.255", "at <ip_address>"), ("IPAddress", "at 2001:db8::1", "at <ip_address>"), ("URL", "see https://a.example/x(y)z.", "see <url>."), ("URL", "see www.a.example/b", "see <url>"),
    ("MACAddress", "00:1B:44:11:3a:b7", "<mac_address>"), ("FilePath", "in C:\\a\\b.txt", "in <file_path>"), ("FilePath", "a/b/c/d.txt", "a<file_path>"), ("InternationalPhoneNumber", "+31 6 1234 5678.", "<international_phone_number>."),
    ("DutchLicensePlateNumber", "AB-12-CD", "<dutch_license_plate_number>"), ("DutchPhoneNumber", "06-12345678", "<dutch_phone_number>"), ("DutchPhoneNumber", "(020) 1234567", "<dutch_phone_number>"), ("DutchIdentityNumberBSN", "111222333", "<dutch_identity_number_bsn>"),
    ("DutchIdentityNumberBSN", "111222334", None), ("DutchIdentityDocumentNumber", "NX4BC5D67", "<dutch_identity_document_number>"), ("DutchVreemdelingenDocumentNumber", "v-nummer 1234567890", "v-nummer <dutch_vreemdelingen_document_number>"),
    ("DutchVreemdelingenDocumentNumber", "nummer 1234567890", None), ("BelgianIdentityNumber", "85.07.30-033.28", "<belgian_identity_number>"), ("BelgianLicencePlateNumber", "1-ABC-123", "<belgian_licence_plate_number>"), ("BelgianPhoneNumber", "0412345678", "<belgian_phone_number>"),
    ("BelgianPassportNumber", "ab123456", "<belgian_passport_number>"), ("DutchBelgianDriversLicenseNumber", "rijbewijs 1234567890", "rijbewijs <dutch_belgian_drivers_license_number>"), ("AustralianPassportNumber", "australia N1234567", "australia <australian_passport_number>"),
    ("AustralianTaxFileNumber", "TFN 123 456 782", "TFN <australian_tax_file_number>"), ("CanadianBankAccountNumber", "canadian 12345-678", "canadian <canadian_bank_account_number>"), ("CanadianPassportNumber", "AB123456", "<canadian_passport_number>"), ("CanadianPassportNumber", "ab123456", None),
    ("UKDriversLicenseNumber", "MORGA657054SM9IJ", "<uk_drivers_license_number>"), ("UKNationalInsuranceNumber", "AB 12 34 56 C", "<uk_national_insurance_number>"), ("UKNationalInsuranceNumber", "GB 12 34 56 C", None), ("USSocialSecurityNumber", "ssn 123-45-6789", "ssn <us_social_security_number>"),
    ("USSocialSecurityNumber", "ssn 666-45-6789", None), ("USIndividualTaxPayerIdentificationNumber", "912-70-1234", "<us_individual_tax_payer_identification_number>"), ("USBankAccountNumber", "savings account 1234567890", "savings account <us_bank_account_number>"), ("UK_USPassportNumber", "passport 123456789", "passport <uk_us_passport_number>"),
]


def test_catalogue(spark):
    assert len(pii.SPECS) == 34
    texts = [t for _, t, _ in CASES]
    for name in {n for n, _, _ in CASES}:
        spec = pii.SPECS[name]
        want = [(t, out or t) for n, t, out in CASES if n == name]
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "i int, t string")
        got = [r[0]["text"] for r in df.orderBy("i").select(pii.mask_text(F.col("t"), spec)).collect()]
        assert got == [w for _, w in want], name
        mask = masker(spec)
        assert [mask(t)[0] for t, _ in want] == got, name
    # both engines agree on every type and text
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    for spec in pii.SPECS.values():
        mask = masker(spec)
        assert [r[0]["text"] for r in df.select(pii.mask_text(F.col("t"), spec)).collect()] == [mask(t)[0] for t in texts], spec.name


def test_borders_beside_letters_of_any_script(spark):
    """Borders, spaces and case as in SQL: only ASCII counts as a word, the vertical tab isn't a space."""
    import duckdb

    from quern.functions.text import as_re2

    texts = ["Álvaro éEL y EL", "ÉELé EL\u0301", "éDE123456789é", "à123456789ß 123456789", "x\u0301EL", "d’EL", "912\x0b70\x0b1234 912\t70\t1234", "é/a/b/c", "a/b/c.é", "\u212aK:a1b \u017f.ab/cd", "wwé.a www.é/x", "éAB-12-CDé", "0é412345678 0412345678é", "éab123456", "_EL EL_"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    con = duckdb.connect()
    for spec in pii.SPECS.values():
        if "(?<" in spec.pattern or "(?!" in spec.pattern:
            continue
        want = con.execute(f"SELECT regexp_extract_all(t, '{spec.pattern.replace(chr(39), chr(39) * 2)}') FROM (SELECT unnest(?) AS t)", [texts]).fetchall()
        got = df.orderBy("i").select(F.regexp_extract_all("t", F.lit(spec.native), F.lit(0)).alias("h")).collect()
        assert [r["h"] for r in got] == [w[0] for w in want], spec.name
        if not spec.validator and not spec.keywords:
            n = df.orderBy("i").select(pii.count_matches(F.col("t"), spec).alias("n"), pii.mask_text(F.col("t"), spec)["count"].alias("m")).collect()
            assert [(r["n"], r["m"]) for r in n] == [(len(w[0]),) * 2 for w in want], spec.name
    for p in (r"\b-\b", r"a?\bé", r"(?:\bEL|x)\b", r"(?:[a-z]|-)\b", r"\b(?:é|a)"):
        want = con.execute(f"SELECT regexp_replace(t, '{p}', '<>', 'g') FROM (SELECT unnest(?) AS t)", [texts]).fetchall()
        assert [r[0] for r in df.orderBy("i").select(F.regexp_replace("t", as_re2(p), "<>")).collect()] == [w[0] for w in want], p


@pytest.mark.parametrize("name", ["pii_mask_ip_address", "pii_mask_mac_address", "pii_mask_dutch_license_plate_number"])
def test_masks_are_computed_once_after_the_texts_are_spread(spark, name):
    from quern.plans import queries

    lines = queries.QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    moved = [k for k, x in enumerate(lines) if "Repartition" in x]
    assert moved
    for k in moved:
        below = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
        assert not any("RLIKE" in x for x in lines[k:below])
    assert sum("regexp_replace" in x for x in lines) == 1


def test_texts_are_tested_for_digits_and_words_once(spark):
    from quern.functions.text import needs_digit
    from quern.plans import queries

    assert {s.name for s in pii.SPECS.values() if not needs_digit(s.pattern)} == {"EmailAddress", "IPAddress", "URL", "MACAddress", "FilePath", "EuropeanVATNumber"}
    assert not any(map(needs_digit, (r"a[0-9]*", r"[0-9]|a", r"[0-9a]", r"(?![0-9])a", r"(?:x|[0-9])y")))
    plan = queries.QUERIES["pii_counts_all_types"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("lower(text#") <= 4


def test_names_before_at_are_looked_for_once(spark):
    """A long run of what names are made of costs no square."""
    run = "word and more " * 8000
    text = run + "@ a.b@example.com x@y" + " @example.com" * 3
    began = time.monotonic()
    r = spark.createDataFrame([(text,)], "t string").select(pii.mask_text(F.col("t"), pii.SPECS["EmailAddress"]).alias("m")).first()["m"]
    assert time.monotonic() - began < 15
    m = "<e-mail_address>"
    assert r["text"] == f"{run}@{m} x@{m}{m}{m}" and r["count"] == 4


def test_windows_masks_and_chains(spark):
    spec = pii.Spec("x", r"\b[0-9]{3}\b", ["<a>", "<b>"], None, ("key",), 14)
    text = "key 123 and 456 ........................ 789"
    assert one(spark, text, lambda c: pii.mask_text(c, spec)["text"]) == masker(spec)(text)[0] == "key <a> and <b> ........................ 789"
    with pytest.raises(ValueError):
        pii.register("y", None, "<y>")
    df = spark.createDataFrame([(1, "mail a@example.com from 10.0.0.1", "nl"), (2, "nothing", "nl"), (3, "a@example.com", "xx"), (4, None, "nl")], "doc_id int, text string, lang string")
    out = {r["doc_id"]: r for r in pii.by_chain(df, {"nl": pii.CHAINS["computer"]}).collect()}
    assert out[1]["text"] == "<e-mail_address> from <ip_address>" and out[2]["pii"] is None and out[3]["text"] == "a@example.com" and "xx" in out[3]["pii_message"] and out[4]["text"] is None
    assert [d["entity_type_counts"] for d in out[1]["pii"]] == [[1], [1], [0], [0], [0]]
    steps = [pii.SPECS["URL"], ner.step(group=True)]
    r = pii.run_chain(spark.createDataFrame([(1, "Yesterday Jan de Vries met Piet Jansen. Then Vries Jan left.", "nl")], "doc_id int, text string, lang string"), steps).first()
    assert "<person>1" in r["text"] and "<person>2" in r["text"]


def test_counts_of_all_types(spark, tmp_path):
    from quern.plans import queries

    found = ["mail a.b@example.com", "iban NL91ABNA0417164300", "card 4111111111111111", "bsn 111222333", "ssn 123-45-6789", "see /home/someone/file.txt", "bel 06-12345678 of (020) 1234567", "rijbewijs 1234567890", "australia N1234567", "mac 00:1b:44:11:3a:22"]
    spark.createDataFrame(list(enumerate([*found, *found[:3], None])), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("pages", "customer", "supplier"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(10).write.parquet(str(tmp_path / f"{name}.parquet"))
    n = {r["type"]: r["n"] for r in queries.QUERIES["pii_counts_all_types"](spark, str(tmp_path)).collect()}
    masks = {k.removeprefix("pii_mask_").replace("_", ""): f for k, f in queries.QUERIES.items() if k.startswith("pii_mask_")}
    assert set(n) == {s.name for s in pii.SPECS.values()} and len(masks) == len(n)
    assert n == {t: sum(r["n"] for r in masks[t.lower().replace("_", "")](spark, str(tmp_path)).collect()) for t in n}
    assert all(n[t] for t in ("EmailAddress", "FilePath", "DutchPhoneNumber", "USSocialSecurityNumber"))


def test_entities():
    assert "".join(ner.split_chunks("ab cd  efg h", 4)) == "ab cd  efg h" and all(len(c) <= 4 or " " not in c.strip() for c in ner.split_chunks("ab cd  efg h", 4))
    assert ner.split_chunks("abcdef", 4, "characters") == ["abcd", "ef"] and "".join(ner.split_chunks("One. Two! Three", 6, "sentences")) == "One. Two! Three"
    toks = [{"start": 0, "end": 3, "text": "Jan", "label": "B-PER", "score": 0.5}, {"start": 4, "end": 6, "text": "Bo", "label": "I-PER", "score": 0.9}, {"start": 9, "end": 12, "text": "ACM", "label": "B-ORG", "score": 0.4}]
    assert [(e["text"], e["label"], e["score"]) for e in ner.merge_tags(toks)] == [("Jan Bo", "PER", 0.9), ("ACM", "ORG", 0.4)]
    es = [{"start": 0, "end": 1, "text": "A B", "label": "p", "score": 1}, {"start": 2, "end": 3, "text": "C", "label": "p", "score": 1}, {"start": 4, "end": 5, "text": "b, d", "label": "p", "score": 1}]
    assert [e["mask"] for e in ner.group_names(es)] == ["<p>1", "<p>2", "<p>1"]
    assert ner.replace_spans("x y z", [{"start": 0, "end": 1, "text": "x", "label": "home address", "score": 1}, {"start": 4, "end": 5, "text": "z", "label": "q", "score": 1}], valid=lambda t: t != "z")[0] == "<home_address> y z"


def test_names_and_synthetic(spark):
    names = spark.createDataFrame([(1, "Ann Bo"), (1, "Bo"), (2, "Bo Ann")], "doc_id int, name string")
    assert [tuple(r) for r in ner.co_occurrence(names).collect()] == [("ann", "bo", 2)]
    known = spark.createDataFrame([("Ann Bo",)], "name string")
    assert sorted((r["name"], r["is_public"]) for r in ner.public_figures(names, known).collect()) == [("Ann Bo", True), ("Bo", False), ("Bo Ann", False)]
    assert pii.not_known(known, "name")(names, "name").count() == 2
    df = spark.createDataFrame([(1, "NAME", "X"), (1, "NAME", " x"), (2, "NAME", "X"), (1, "OTHER", "X")], "d int, k string, v string")
    a, b, c, o = [r[0] for r in df.select(ner.synthetic(F.col("k"), F.col("v"), F.col("d"))).collect()]
    assert a == b and o == "[OTHER]" and " " in a


class Flaky:
    def __init__(self, endpoint):
        self.n = 0

    def process(self, chunk, entity_types, mode):
        if "fail" in chunk:
            raise OSError
        return [{"start": m.start(), "end": m.end(), "text": m[0], "label": "NAME", "score": 1.0} for m in re.finditer("Ann|Bo", chunk)]


def test_remote(spark):
    df = spark.createDataFrame([(1, "Ann and Bo. fail Ann."), (2, None)], "doc_id int, text string")
    r = {x["doc_id"]: x for x in ner.remote(df, Flaky, chunk_chars=12, keep=["Bo"]).collect()}
    assert r[1]["text"] == "[NAME] and Bo. fail Ann." and r[1]["failed_chunks"] == [1] and r[2]["text"] is None


def test_toxic(spark):
    df = spark.createDataFrame([(1, "You are nice.\nYou moron you.\nBye now.", "en"), (2, "moron", "fr"), (3, "fine", "en"), (4, None, "en")], "doc_id int, text string, lang string")
    out = {r["doc_id"]: r for r in toxic.remove_toxic(df, lambda: toxic.Lexicon({"en": ["moron"]}), max_chunk_length=3).collect()}
    assert out[1]["text"] == "You are nice. Bye now." and out[1]["toxic_language"][0]["label"] == "Toxic" and out[1]["toxic_language"][0]["start_index"] == 13
    assert out[2]["text"] == "moron" and out[2]["toxic_language"][0]["label"] is None and out[3]["toxic_language"][0]["sentence"] is None
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in toxic.remove_listed_lines(df, {"en": ["moron"]}).collect()}[1] == ("You are nice. Bye now.", 1)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a|b||c"), (2, "")], "doc_id int, text string")
    rows = chunks.split_rows(df, "|")
    assert rows.count() == 5
    assert {r["doc_id"]: r["text"] for r in chunks.combine_rows(rows, "|").collect()} == {1: "a|b||c", 2: ""}
    with pytest.raises(ValueError):
        chunks.combine_rows(df)
    t = chunks.translation_chunks(spark.createDataFrame([(1, "ab\ncdefg")], "doc_id int, text string"), 3)
    assert [(r["chunk_id"], r["text"]) for r in t.orderBy("row_splitter_pos").collect()] == [("[0:3]", "ab "), ("[3:6]", "cde"), ("[6:8]", "fg")]
    assert [tuple(r) for r in chunks.combine_translations(chunks.translate(t, "opus", dry_run=True)).select("doc_id", "text", "chunk_id", "input_text").collect()] == [(1, "ab  cde fg", "[0:3],[3:6],[6:8]", ["ab ", "cde", "fg"])]
    with pytest.raises(NotImplementedError):
        chunks.translation_chunks(df, mode="tokens")
    assert chunks.affixes("google/madlad400") == ("", "<2nl> ") and chunks.affixes("GemmaX2-28", "French", "Dutch")[0].startswith("Translate this from French to Dutch")
    with pytest.raises(ValueError):
        chunks.affixes("other")
    assert list(chunks.batched([1, 2, 3], 2)) == [(1, 2), (3,)]
    with pytest.raises(ValueError):
        list(chunks.batched([1], 0))


class Half:
    name = "half"

    def generate(self, prompts, max_tokens, temperature):
        return [p if "keep" in p else "" for p in prompts]


def test_generate(spark):
    df = spark.createDataFrame([(1, "keep {x}"), (2, "drop")], "doc_id int, text string")
    (r,) = chunks.generate(df, "Q: {text}", Half, batch_size=1).collect()
    assert r["text"] == "Q: keep {x}" and r["meta"]["model_name"] == "half" and r["meta"]["input_text"] == "keep {x}" and r["meta"]["max_tokens"] == 2
    with pytest.raises(Exception, match="nothing"):
        chunks.generate(df, "{text}", Half, debug=True).collect()


def test_scores(spark):
    p = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("b", 0, 0)], "name string, label int, predicted int")
    rows = {r["name"]: r for r in evaluation.confusion(p, ["name"]).collect()}
    assert (rows["a"]["tp"], rows["a"]["fp"], rows["a"]["fn"], rows["a"]["f1"]) == (1, 1, 1, 0.5) and rows["b"]["f1"] == 0 and evaluation.rows_of(p, "fp").count() == 1
    d = spark.createDataFrame([(1, "a a b", "en"), (2, "", "en")], "doc_id int, text string, lang string")
    s = perplexity.unigram_perplexity(d)
    import math

    want = math.exp(-(2 * math.log(3 / 5) + math.log(2 / 5)) / 3)
    assert [round(r["perplexity"], 9) for r in s.collect()] == [round(want, 9)]
    assert perplexity.summary(s).first()["n"] == 1 and perplexity.histogram(s).first()["n"] == 1

    m = perplexity.model_perplexity(d, {"dutch": Fixed}).collect()
    assert {r["perplexity_key"] for r in m} == {"perplexity_dutch"} and m[1]["perplexity"] is None
    l = perplexity.detect_language(spark.createDataFrame([("de kat", None), ("x", "fr")], "text string, lang string"), {"nl": ["de"], "en": ["the"]})
    assert [r["lang"] for r in l.collect()] == ["nl", "fr"]


class Fixed:
    def perplexity(self, text):
        return 3.0


def test_sources(spark, tmp_path):
    (tmp_path / "f.csv").write_text('label;aliases\nAnn Bo;"A. Bo; Annie"\nCy;\n')
    assert sorted(r[0] for r in tables.public_figures(spark, str(tmp_path / "f.csv")).collect()) == ["A. Bo", "Ann Bo", "Annie", "Cy"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "en").write_text("bad\n\nworse\n")
    assert tables.bad_words(spark, str(tmp_path / "w")) == {"en": ["bad", "worse"]}
    df = tables.documents(spark, [("1", "t", None, "en")])
    tables.write_excluded(df.withColumn("drop_reason", F.lit("r")), str(tmp_path / "x"))
    assert tables.parquet(spark, str(tmp_path / "x")).count() == 1
    tables.write_metrics(df, str(tmp_path / "m"))
    assert tables.fixtures(spark, str(tmp_path / "m")).first()["text"] == "t"


@pytest.mark.parametrize("most", [0, 1, 5, 1000])
def test_perplexity_whatever_is_broadcast(spark, most):
    """The same, however many words are frequent; repeated and null ids, null and empty texts; rare words alone move."""
    import math
    from collections import Counter

    rows = [(1, "a b a c", "en"), (1, "a d", "en"), (2, "A b b", "nl"), (3, "", "en"), (4, None, "en"), (5, "x y", None), (None, "a z", "en"), (None, "b", "en"), (6, "b" * 200 + " b", "nl")]
    of = [(i, l, w) for i, t, l in rows if l for w in (t or "").lower().split()]
    c, total = Counter((l, w) for _, l, w in of), Counter(l for _, l, _ in of)
    kinds = Counter(l for l, _ in c)
    want = {}
    for i, l in {(i, l) for i, l, _ in of}:
        ws = [w for j, m, w in of if (j, m) == (i, l)]
        want[i, l] = math.exp(-sum(math.log((c[l, w] + 1) / (total[l] + kinds[l])) for w in ws) / len(ws))
    got = {(r["doc_id"], r["lang"]): r["perplexity"] for r in perplexity.unigram_perplexity(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=most).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_steps_take_large_batches_in_parts(spark):
    from quern.functions import arrow

    long = pa.record_batch({"t": ["x" * 1000] * 100})
    assert [b.num_rows for b in arrow.parts([long], 30_000)] == [25] * 4 and [len(a) for a in arrow.parts([long["t"], long["t"][:0]], 1)] == [1] * 100
    assert pa.concat_arrays([b["t"] for b in arrow.parts([long], 30_000)]) == long["t"]
    text = "Jan de Vries was here. " * 200
    df = spark.createDataFrame([(k, text, "nl") for k in range(1000)], "doc_id int, text string, lang string").coalesce(1)
    out = pii.run_chain(df, [ner.step(labels=("person",))]).select("text").distinct().collect()
    assert [r["text"] for r in out] == [text.replace("Jan de Vries", "<person>")]
    out = df.select(formatters.unicode_fix(F.concat("text", F.lit(" schÃ¶n"))).alias("t")).distinct().collect()
    assert [r["t"] for r in out] == [text + " schön"]
