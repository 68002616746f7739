"""Queries over labelled rows of their own: whole small tables, with the result that each row must have.

They hold what the driver's tables don't have (personal data with its
keywords, mojibake, model output) and what SQL has no expression for. The SQL
of each is its expected rows, written by hand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks, evaluation, filters, formatters, ner, perplexity, pii, toxic
from .pipeline import Pipeline
from .queries import MODELS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_KINDS = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return " || ".join("'" + p.replace("'", "''") + "'" for p in v.split("\n")).replace("' || '", "' || chr(10) || '") if "\n" in v else "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else repr(v)


def labelled(name: str, given: str, rows: Sequence[tuple], f: Callable[[DataFrame], DataFrame], result: str, want: Sequence[tuple]) -> None:
    """A query of f over rows of the schema given, whose result has the schema result and the rows want. A number that is null reads -1."""
    cols = [x.split() for x in result.split(", ")]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = f(spark.createDataFrame(list(rows), given))
        return out.select(*((F.col(c) if k in ("string", "boolean") else F.coalesce(F.col(c), F.lit(-1))).cast(k).alias(c) for c, k in cols))

    run.__name__ = name
    QUERIES[name] = run
    body = ", ".join("(" + ", ".join(_value(-1 if v is None and k not in ("string", "boolean") else v) for v, (_, k) in zip(r, cols)) + ")" for r in want)
    SQL[name] = f"SELECT {', '.join(f'{c}::{_KINDS[k]} AS {c}' for c, k in cols)} FROM (VALUES {body}) AS t({', '.join(c for c, _ in cols)})"


# --- personal data, by type: a text, and what is left of it (None: nothing is found) --------------------------------

_FAR = "filler " * 60  # more than the 300 characters in which a keyword counts

PII: dict[str, list[tuple[str, str | None]]] = {
    "CreditCardNumber": [
        ("pay 4111 1111 1111 1111 now", "pay <credit_card_number> now"), ("or 5500-0000-0000-0004.", "or <credit_card_number>."), ("amex 378282246310005", "amex <credit_card_number>"), ("order 4111 1111 1111 1112", None), ("on 2024 and 2025", None),
        ("4012888888881881 and 4222222222222", "<credit_card_number> and 4222222222222"),
    ],
    "CreditCardCVVCode": [("my cvv is 123.", "my cvv is <credit_card_cvv_code>."), ("code 1234", "code <credit_card_cvv_code>"), ("from 12:345", None), ("a-123", None), ("number 12345", None)],
    "CreditCardExpiryDate": [("valid to 09/27", "valid to <credit_card_expiry_date>"), ("12-29!", "<credit_card_expiry_date>!"), ("13/27", None), ("on 9/27", None)],
    "IBAN": [
        ("to NL91 ABNA 0417 1643 00.", "to <iban>."), ("DE89370400440532013000", "<iban>"), ("GB29 NWBK 6016 1331 9268 19", "<iban>"), ("BE68 5390 0754 7034 please", "<iban> please"), ("to NL92 ABNA 0417 1643 00.", None), ("NL91 is short", None),
    ],
    "EuropeanVATNumber": [("VAT DE123456789", "VAT <european_vat_number>"), ("NL123456789B01", "<european_vat_number>"), ("ATU12345678 or BE0123456789", "<european_vat_number> or <european_vat_number>"), ("DE12345", None), ("XDE123456789", None)],
    "EmailAddress": [("(a.b@example.com)", "(<e-mail_address>)"), ("x_y+z@mail.example.org,", "<e-mail_address>,"), ("me@localhost", None), ("@handle only", None)],
    "IPAddress": [("at 192.168.1.255", "at <ip_address>"), ("at 2001:db8::1", "at <ip_address>"), ("host 10.0.0.1:80", "host <ip_address>:80"), ("v 1.2.3", None)],
    "URL": [("see https://a.example/x(y)z.", "see <url>."), ("see www.a.example/b", "see <url>"), ("ftp://files.example.net/pub", "<url>"), ("no link here", None)],
    "MACAddress": [("00:1B:44:11:3a:b7", "<mac_address>"), ("00-1b-44-11-3a-b7 up", "<mac_address> up"), ("001b.4411.3ab7", "<mac_address>"), ("00:1b:44:11:3a", None)],
    "FilePath": [("in C:\\a\\b.txt", "in <file_path>"), ("see /usr/share/x.conf", "see /usr<file_path>"), ("a/b/c/d.txt", "a<file_path>"), ("either/or", None)],
    "InternationalPhoneNumber": [("+31 6 1234 5678.", "<international_phone_number>."), ("call +14155552671", "call <international_phone_number>"), ("+ 31 6", None), ("06 1234 5678", None)],
    "DutchLicensePlateNumber": [("plate AB-12-CD", "plate <dutch_license_plate_number>"), ("12-ABC-3", "<dutch_license_plate_number>"), ("G-123-BB gone", "<dutch_license_plate_number> gone"), ("AB12CD", None), ("ab-12-cd", None)],
    "DutchPhoneNumber": [("06-12345678", "<dutch_phone_number>"), ("(020) 1234567", "<dutch_phone_number>"), ("0201234567.", "<dutch_phone_number>."), ("+31612345678", "<dutch_phone_number>"), ("0612", None)],
    "DutchIdentityNumberBSN": [("bsn 111222333", "bsn <dutch_identity_number_bsn>"), ("123456782", "<dutch_identity_number_bsn>"), ("bsn 111222334", None), ("11122233", None)],
    "DutchIdentityDocumentNumber": [("NX4BC5D67", "<dutch_identity_document_number>"), ("paspoort SPECI2014 hier", "paspoort <dutch_identity_document_number> hier"), ("NX4BC5D6", None), ("nx4bc5d67", None)],
    "DutchVreemdelingenDocumentNumber": [
        ("v-nummer 1234567890", "v-nummer <dutch_vreemdelingen_document_number>"), ("1234567890 is mijn VNR", "<dutch_vreemdelingen_document_number> is mijn VNR"), ("nummer 1234567890", None), (f"vnr {_FAR}1234567890", None), ("vnr 123456789", None),
    ],
    "BelgianIdentityNumber": [("85.07.30-033.28", "<belgian_identity_number>"), ("nr 85073003328 ok", "nr <belgian_identity_number> ok"), ("85.07.30", None)],
    "BelgianLicencePlateNumber": [("1-ABC-123", "<belgian_licence_plate_number>"), ("ABC 123", "<belgian_licence_plate_number>"), ("AB-12", None)],
    "BelgianPhoneNumber": [("0412345678", "<belgian_phone_number>"), ("02 123 45 67 a", "<belgian_phone_number> a"), ("12345", None)],
    "BelgianPassportNumber": [("ab123456", "<belgian_passport_number>"), ("EK123456 valid", "<belgian_passport_number> valid"), ("E123456", None)],
    "DutchBelgianDriversLicenseNumber": [("rijbewijs 1234567890", "rijbewijs <dutch_belgian_drivers_license_number>"), ("Mijn RIJBEWIJS: 5566778899", "Mijn RIJBEWIJS: <dutch_belgian_drivers_license_number>"), ("nummer 1234567890", None), (f"rijbewijs {_FAR}1234567890", None)],
    "AustralianDriversLicenseNumber": [("australian driver 12345678", "australian driver <australian_drivers_license_number>"), ("driver 12345678", None), ("australian 12", None)],
    "AustralianBankAccountNumber": [("australian bank 123456789", "australian bank <australian_bank_account_number>"), ("aus bank: 123456", "aus bank: <australian_bank_account_number>"), ("bank 123456789", None), ("australian bank 12345", None)],
    "AustralianPassportNumber": [("australia N1234567", "australia <australian_passport_number>"), ("PA1234567 of Australia", "<australian_passport_number> of Australia"), ("N1234567", None), ("australia Q1234567", None)],
    "AustralianTaxFileNumber": [("TFN 123 456 782", "TFN <australian_tax_file_number>"), ("tax file number 12345678", "tax file number <australian_tax_file_number>"), ("number 123 456 782", None)],
    "CanadianBankAccountNumber": [("canadian 12345-678", "canadian <canadian_bank_account_number>"), ("canadian bank 1234567", "canadian bank <canadian_bank_account_number>"), ("bank 1234567", None), ("canadian 123456", None)],
    "CanadianPassportNumber": [("AB123456", "<canadian_passport_number>"), ("ab123456", None), ("AB12345", None)],
    "UKDriversLicenseNumber": [("MORGA657054SM9IJ", "<uk_drivers_license_number>"), ("no MORGA657054SM9I", None)],
    "UKNationalInsuranceNumber": [("AB 12 34 56 C", "<uk_national_insurance_number>"), ("NI JG103759A.", "NI <uk_national_insurance_number>."), ("GB 12 34 56 C", None), ("AB123456E", None)],
    "UKUniqueTaxpayerReferenceNumber": [("tax reference 1234567890", "tax reference <uk_unique_taxpayer_reference_number>"), ("number 1234567890", None), (f"tax {_FAR}1234567890", None)],
    "USSocialSecurityNumber": [("ssn 123-45-6789", "ssn <us_social_security_number>"), ("Social Security Number: 219 09 9999", "Social Security Number: <us_social_security_number>"), ("ssn 666-45-6789", None), ("123-45-6789", None), ("ssn 123-00-6789", None)],
    "USIndividualTaxPayerIdentificationNumber": [("912-70-1234", "<us_individual_tax_payer_identification_number>"), ("itin 900801234", "itin <us_individual_tax_payer_identification_number>"), ("812-70-1234", None)],
    "USBankAccountNumber": [("savings account 1234567890", "savings account <us_bank_account_number>"), ("U.S. 123456789012", "U.S. <us_bank_account_number>"), ("account 1234567890", None), ("us bank 123456789", None)],
    "UK_USPassportNumber": [("passport 123456789", "passport <uk_us_passport_number>"), ("A12345678 in my Passport", "<uk_us_passport_number> in my Passport"), ("number 123456789", None)],
}

for _name, _cases in PII.items():

    def _mask(df: DataFrame, spec: pii.Spec = pii.SPECS[_name]) -> DataFrame:
        m = df.withColumn("m", pii.mask_text(F.col("text"), spec))
        return m.select("k", F.col("m.text").alias("masked"), F.col("m.count").alias("n"))

    _want = [(k, out or t, (out or "").count(pii.SPECS[_name].mask)) for k, (t, out) in enumerate(_cases)]
    labelled(f"pii_labelled_{_name.lower()}", "k int, text string", [(k, t) for k, (t, _) in enumerate(_cases)], _mask, "k int, masked string, n int", _want)


def _scored(df: DataFrame) -> DataFrame:
    """Confusion by type of all labelled texts: a type is predicted where its pattern changes the text."""
    out = None
    for name, spec in pii.SPECS.items():
        one = df.where(F.col("type") == name).select("type", "label", F.coalesce(pii.mask_text(F.col("text"), spec)["text"] != F.col("text"), F.lit(False)).cast("int").alias("predicted"))
        out = one if out is None else out.unionByName(one)
    return evaluation.confusion(out, ["type"]).select("type", "tp", "fp", "tn", "fn", "f1")


_ALL = [(n, t, int(w is not None and w != t)) for n, cs in PII.items() for t, w in cs]
labelled(
    "pii_labelled_f1", "type string, text string, label int", _ALL, _scored, "type string, tp long, fp long, tn long, fn long, f1 double",
    [(n, sum(x == n and y for x, _, y in _ALL), 0, sum(x == n and not y for x, _, y in _ALL), 0, 1.0) for n in PII],
)

# --- chains ---------------------------------------------------------------------------------------------------------

CHAINS: dict[str, list[tuple[str, str]]] = {
    "computer": [("mail a@example.com from 10.0.0.1", "<e-mail_address> from <ip_address>"), ("https://x.example/a and 00:1B:44:11:3a:b7", "<url> and <mac_address>"), ("in C:\\a\\b.txt", "in <file_path>"), ("nothing here", "nothing here")],
    "banking": [("4111 1111 1111 1111 cvv 123 till 09/27", "<credit_card_number> cvv <credit_card_cvv_code> till <credit_card_expiry_date>"), ("NL91 ABNA 0417 1643 00 vat DE123456789", "<iban> vat <european_vat_number>")],
    "common": [("+31 6 1234 5678.", "<international_phone_number>."), ("06 1234", "06 1234")],
    "dutch": [("AB-12-CD 06-12345678", "<dutch_license_plate_number> <dutch_phone_number>"), ("bsn 111222333 doc NX4BC5D67", "bsn <dutch_identity_number_bsn> doc <dutch_identity_document_number>"), ("v-nummer 1234567890", "v-nummer <dutch_vreemdelingen_document_number>")],
    "belgian": [("85.07.30-033.28 1-ABC-123", "<belgian_identity_number> <belgian_licence_plate_number>"), ("ab123456", "<belgian_passport_number>"), ("rijbewijs 1234567890", "rijbewijs <dutch_belgian_drivers_license_number>")],
    "australian": [("australia PA1234567", "australia <australian_passport_number>"), ("tfn 123 456 782", "tfn <australian_tax_file_number>")],
    "canadian": [("canadian 12345-678 AB123456", "canadian <canadian_bank_account_number> <canadian_passport_number>")],
    "uk": [("MORGA657054SM9IJ AB 12 34 56 C", "<uk_drivers_license_number> <uk_national_insurance_number>"), ("tax 1234567890", "tax <uk_unique_taxpayer_reference_number>"), ("passport 123456789", "passport <uk_us_passport_number>")],
    "us": [("ssn 123-45-6789", "ssn <us_social_security_number>"), ("912-70-1234", "<us_individual_tax_payer_identification_number>"), ("savings account 1234567890", "savings account <us_bank_account_number>"), ("passport A12345678", "passport <uk_us_passport_number>")],
    "everything_nl": [("Vandaag belde Jan de Vries vanaf 06-12345678 uit", "Vandaag belde <person> vanaf <dutch_phone_number> uit"), ("bsn 111222333, a@example.com", "bsn <dutch_identity_number_bsn>,<e-mail_address>"), ("stuur naar NL91ABNA0417164300", "stuur naar <iban>")],
    "everything_en": [("we saw Mary Jane Smith at 10.0.0.1", "we saw <person> at <ip_address>"), ("my ssn is 123-45-6789 and card 4111 1111 1111 1111", "my ssn is <us_social_security_number> and card <credit_card_number>"), ("by Acme Tools Ltd since 1990", "by <organisation> since 1990")],
}

for _name, _pairs in CHAINS.items():

    def _chain(df: DataFrame, steps: Sequence[str] = pii.CHAINS[_name], lang: str = "en" if _name.endswith("en") else "nl") -> DataFrame:
        out = pii.run_chain(df.withColumn("lang", F.lit(lang)), steps, models=MODELS)
        return out.select("k", "text", F.col("pii").isNotNull().alias("changed"))

    labelled(f"pii_labelled_chain_{_name}", "k int, text string", [(k, t) for k, (t, _) in enumerate(_pairs)], _chain, "k int, text string, changed boolean", [(k, w, w != t) for k, (t, w) in enumerate(_pairs)])


def _by_language(df: DataFrame) -> DataFrame:
    out = pii.by_chain(df, {"nl": pii.CHAINS["common"], "en": pii.CHAINS["computer"]})
    return out.select("k", "text", F.col("pii").isNotNull().alias("changed"), F.col("pii_message").alias("message"))


labelled(
    "pii_labelled_languages", "k int, text string, lang string", [(1, "+31612345678 a@example.com", "nl"), (2, "+31612345678 at 10.0.0.1", "en"), (3, "10.0.0.1", "xx"), (4, "10.0.0.1", None), (5, None, "nl"), (6, "nothing", "en")], _by_language,
    "k int, text string, changed boolean, message string",
    [(1, "<international_phone_number> a@example.com", True, None), (2, "+31612345678 at <ip_address>", True, None), (3, "10.0.0.1", False, "language not supported: xx"), (4, "10.0.0.1", False, "language not supported: "), (5, None, False, None), (6, "nothing", False, None)],
)
labelled("pii_labelled_counters", "k int, text string, lang string", [(1, "+31612345678", "nl"), (2, "none", "nl"), (3, "x", "xx")], lambda df: pii.counters(pii.by_chain(df, {"nl": pii.CHAINS["common"]})), "total long, formatted long, not_formatted long", [(3, 1, 2)])
labelled(
    "pii_labelled_masks_in_turn", "k int, text string", [(1, "key 123 and 456 and 789"), (2, "123 alone"), (3, "key " + "." * 20 + " 123")], lambda df: df.select("k", pii.mask_text(F.col("text"), pii.Spec("x", r"\b[0-9]{3}\b", ["<a>", "<b>"], None, ("key",), 20)).alias("m")).select("k", "m.text", F.array_join("m.masks", ",").alias("masks")),
    "k int, text string, masks string", [(1, "key <a> and <b> and <a>", "<a>,<b>,<a>"), (2, "123 alone", ""), (3, "key " + "." * 20 + " 123", "")],
)
labelled(
    "pii_labelled_verdict", "k int, label int, entity string, before string, after string", [(1, 1, "06-1", "bel 06-1", "bel <x>"), (2, 1, "06-1", "bel 06-1", "bel 06-1"), (3, 0, None, "niets", "niets"), (4, 0, None, "niets", "<x>")], lambda df: df.select("k", pii.verdict(F.col("label"), F.col("entity"), F.col("before"), F.col("after")).alias("predicted")),
    "k int, predicted int", [(1, 1), (2, 0), (3, 0), (4, 1)],
)
labelled(
    "pii_labelled_not_known", "id int, label string", [(1, "Ann Bo"), (2, " ann BO "), (3, "Someone Else"), (4, None)], lambda df: pii.not_known(df.sparkSession.createDataFrame([("Ann Bo",), ("Cor Dee",)], "label string"))(df, "label"), "id int, label string", [(3, "Someone Else"), (4, None)]
)
labelled(
    "validate_labelled", "k int, kind string, v string",
    [(1, "iban", "NL91ABNA0417164300"), (2, "iban", "nl91 abna 0417 1643 00"), (3, "iban", "NL91ABNA0417164301"), (4, "iban", "ZZ91ABNA0417164300"), (5, "iban", "NO9386011117947"), (6, "iban", "FR1420041010050500013M02606"), (7, "iban", "FR1420041010050500013M0260"), (8, "iban", None), (9, "luhn", "79927398713"), (10, "luhn", "79927398710"), (11, "luhn", "4111-1111 1111-1111"), (12, "luhn", "x"), (13, "bsn", "111222333"), (14, "bsn", "123.456.782"), (15, "bsn", "12345678"), (16, "bsn", "000000001")],
    lambda df: df.select("k", F.when(F.col("kind") == "iban", pii.iban(F.col("v"))).when(F.col("kind") == "luhn", pii.luhn(F.col("v"))).otherwise(pii.bsn(F.col("v"))).alias("ok")),
    "k int, ok boolean", [(1, True), (2, True), (3, False), (4, False), (5, True), (6, True), (7, False), (8, False), (9, True), (10, False), (11, True), (12, False), (13, True), (14, True), (15, False), (16, False)],
)

# --- entities -------------------------------------------------------------------------------------------------------

_NAMES = "Yesterday Jan de Vries met Piet Jansen. Then Vries Jan left with Acme Tools Ltd."


def _entities(group: bool = False, masks: str | Sequence[str] | None = None, valid: Callable[[str], bool] | None = None) -> Callable[[DataFrame], DataFrame]:
    return lambda df: pii.run_chain(df, [ner.step(group=group, masks=masks, valid=valid)]).select("k", "text", F.aggregate(F.flatten(F.transform("pii", lambda x: x["entity_type_counts"])), F.lit(0), lambda a, b: a + b).alias("n"))


def _not_jan(t: str) -> bool:
    return "Jan" not in t


labelled("ner_labelled_masks", "k int, text string, lang string", [(1, "we met Piet Jansen and Acme Tools Ltd here", "nl"), (2, "nobody here", "nl"), (3, None, "nl"), (4, "seen Piet Jansen", "zz")], _entities(), "k int, text string, n int", [(1, "we met <person> and <organisation> here", 2), (2, "nobody here", None), (3, None, None), (4, "seen <person>", 1)])
labelled("ner_labelled_groups", "k int, text string, lang string", [(1, "we met Piet Jansen, then Anna Bakker, then Karel Jansen", "nl")], _entities(group=True), "k int, text string, n int", [(1, "we met <person>1, then <person>2, then <person>1", 3)])
labelled("ner_labelled_own_masks", "k int, text string, lang string", [(1, "we met Piet Jansen and Acme Tools Ltd here", "nl")], _entities(masks=["[P]", "[O]"]), "k int, text string, n int", [(1, "we met [P] and [O] here", 2)])
labelled("ner_labelled_validator", "k int, text string, lang string", [(1, "we met Piet Jansen and Anna Bakker", "nl")], _entities(valid=_not_jan), "k int, text string, n int", [(1, "we met Piet Jansen and <person>", 1)])
labelled("ner_labelled_long_text", "k int, text string, lang string", [(1, "word " * 1998 + "we met Piet Jansen " + "word " * 1500, "nl")], _entities(), "k int, text string, n int", [(1, "word " * 1998 + "we met <person> " + "word " * 1500, 1)])


def _udf(f: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """A helper of single strings over the column text."""
    return lambda df: df.select("k", F.udf(f, "string")("text").alias("out"))


labelled("ner_labelled_chunks", "k int, text string", [(1, "ab cd  efg h"), (2, "abcdefgh")], _udf(lambda t: "|".join(ner.split_chunks(t, 4))), "k int, out string", [(1, "ab |cd  |efg |h"), (2, "abcdefgh")])
labelled("ner_labelled_chunks_by_characters", "k int, text string", [(1, "abcdef")], _udf(lambda t: "|".join(ner.split_chunks(t, 4, "characters"))), "k int, out string", [(1, "abcd|ef")])
labelled("ner_labelled_chunks_by_sentences", "k int, text string", [(1, "One. Two! Three")], _udf(lambda t: "|".join(ner.split_chunks(t, 6, "sentences"))), "k int, out string", [(1, "One. |Two! |Three")])


def _tags(spec: str) -> str:
    toks = [dict(zip(("start", "end", "text", "label", "score"), (int(a), int(b), t, l, float(s)))) for a, b, t, l, s in (x.split("/") for x in spec.split(" "))]
    return " ".join(f"{e['start']}-{e['end']}:{e['text'].replace(' ', '_')}:{e['label']}:{e['score']:g}" for e in ner.merge_tags(toks, "_"))


labelled(
    "ner_labelled_tags", "k int, text string", [(1, "0/3/Jan/B-PER/0.5 4/6/Bo/I-PER/0.9 9/12/ACM/B-ORG/0.4"), (2, "0/2/Wa/PER/0.5 2/5/ter/PER/0.7 7/9/Al/PER/0.6"), (3, "0/3/Jan/B-PER/0.5 4/7/Bos/B-PER/0.6")], _udf(_tags), "k int, out string",
    [(1, "0-6:Jan_Bo:PER:0.9 9-12:ACM:ORG:0.4"), (2, "0-5:Water:PER:0.7 7-9:Al:PER:0.6"), (3, "0-3:Jan:PER:0.5 4-7:Bos:PER:0.6")],
)
labelled("ner_labelled_co_occurrence", "doc_id int, name string", [(1, "Ann Bo"), (1, "Bo"), (2, "Bo Ann"), (2, "Cor"), (3, "Cor.")], ner.co_occurrence, "part_a string, part_b string, n long", [("ann", "bo", 2), ("ann", "cor", 1), ("bo", "cor", 1)])
labelled("ner_labelled_public_figures", "k int, name string", [(1, "Ann Bo"), (2, "Bo"), (3, " Ann Bo "), (4, None)], lambda df: ner.public_figures(df, df.sparkSession.createDataFrame([("Ann Bo",), ("Ann Bo",)], "name string")), "k int, is_public boolean", [(1, True), (2, False), (3, True), (4, False)])

_SHAPES = {
    "NAME": "^[A-Z][a-z]+ [A-Z][a-z]+$", "NAME_GIVEN": "^[A-Z][a-z]+$", "NAME_FAMILY": "^[A-Z][a-z]+$", "LOCATION_CITY": "^[A-Z][a-z]+$", "DRIVER_LICENSE": "^[0-9]{10}$", "HEALTHCARE_NUMBER": "^[0-9]{9}$", "NUMERICAL_PII": "^[0-9]{8}$",
    "PASSPORT_NUMBER": "^[A-NP-Z]{2}[A-NP-Z0-9]{6}$|^[A-Z]{2}[A-Z0-9]{5}[0-9]$", "LOCATION_COORDINATE": "^5[0-3][.][0-9]{5}, [3-7][.][0-9]{5}$", "USERNAME": "^[a-z]+[0-9]{3}$", "URL": "^https://[a-z0-9]+[.]example[.]com$", "EMAIL_ADDRESS": "^[a-z0-9]+@example[.]com$", "PHONE_NUMBER": "^06[0-9]{8}$", "UNKNOWN": r"^\[UNKNOWN\]$",
}


def _synthetic(df: DataFrame) -> DataFrame:
    """Of each kind: it has the right shape, is the same for the same key in a document, and another in another."""
    v = lambda key, seed: ner.synthetic(F.col("kind"), F.lit(key), F.lit(seed))
    shape = None
    for k, p in _SHAPES.items():
        shape = F.when(F.col("kind") == k, v("Ann", 1).rlike(p)) if shape is None else shape.when(F.col("kind") == k, v("Ann", 1).rlike(p))
    return df.select("kind", shape.alias("shaped"), (v("Ann", 1) == v(" ann ", 1)).alias("same"), F.size(F.array_distinct(F.array(*(v("Ann", k) for k in range(4))))).between(2, 4).alias("varied"))


labelled("synthetic_labelled", "kind string", [(k,) for k in _SHAPES], _synthetic, "kind string, shaped boolean, same boolean, varied boolean", [(k, True, True, k != "UNKNOWN") for k in _SHAPES])


class Finder:
    """A service that finds "SECRET" and numbers, fails on "boom" and, every other time, on "flaky"."""

    def __init__(self, endpoint: int) -> None:
        self.tries = 0

    def alive(self) -> bool:
        return True

    def process(self, chunk: str, entity_types: Sequence[str], mode: str) -> list[dict]:
        self.tries += 1
        if "boom" in chunk or ("flaky" in chunk and self.tries % 2):
            raise OSError("unavailable")
        at = chunk.find("SECRET")
        return [] if at < 0 else [{"start": at, "end": at + 6, "text": "SECRET", "label": "NAME", "score": 1.0, "mask": "Jo"}]


def _remote(df: DataFrame) -> DataFrame:
    out = ner.remote(df, Finder, attempts=4, wait=0.0)
    return out.select("doc_id", "text", F.array_join(F.col("failed_chunks").cast("array<string>"), ",").alias("failed"))


labelled("remote_labelled", "doc_id int, text string", [(1, "a SECRET b"), (2, "boom SECRET"), (3, "flaky SECRET"), (4, None), (5, "")], _remote, "doc_id int, text string, failed string", [(1, "a [NAME] b", ""), (2, "boom SECRET", "0"), (3, "flaky [NAME]", ""), (4, None, ""), (5, "", "")])
labelled("remote_labelled_synthetic", "doc_id int, text string", [(1, "a SECRET b")], lambda df: ner.remote(df, Finder, mode="SYNTHETIC"), "doc_id int, text string", [(1, "a Jo b")])
labelled("remote_labelled_public", "doc_id int, text string", [(1, "a SECRET b")], lambda df: ner.remote(df, Finder, keep=(" SECRET ",)), "doc_id int, text string", [(1, "a SECRET b")])

# --- toxic passages, generation, translation --------------------------------------------------------------------------

_LEX = {"en": ["moron"], "nl": ["sukkel"]}


def _toxic(df: DataFrame, **options: object) -> DataFrame:
    out = toxic.remove_toxic(df, lambda: toxic.Lexicon(_LEX), **options)
    e = F.get("toxic_language", F.lit(0))
    return out.select("k", "text", e["label"].alias("label"), F.round(e["score"], 6).alias("score"), e["sentence"].alias("sentence"), e["start_index"].alias("start_index"), F.size("toxic_language").alias("n"))


_TOX = "k int, text string, label string, score double, sentence string, start_index int, n int"
labelled(
    "toxic_labelled_chunks", "k int, text string, lang string", [(1, "A good day to all. You moron go away. Fine then now.", "en"), (2, "Dag jij sukkel.", "nl"), (3, "You moron.", "xx"), (4, None, "en"), (5, "All is well.", "en")], lambda df: _toxic(df, max_chunk_length=5), _TOX,
    [(1, "A good day to all. Fine then now.", "Toxic", 0.25, "You moron go away.", 18, 1), (2, "", "Inappropriate", round(1 / 3, 6), "Dag jij sukkel.", 0, 1), (3, "You moron.", None, None, None, None, 1), (4, None, None, None, None, None, 1), (5, "All is well.", None, None, None, None, 1)],
)
labelled("toxic_labelled_threshold", "k int, text string, lang string", [(1, "You moron go away.", "en"), (2, "moron", "en")], lambda df: _toxic(df, threshold=0.5), _TOX, [(1, "You moron go away.", None, None, None, None, 1), (2, "", "Toxic", 1.0, "moron", 0, 1)])
labelled("toxic_labelled_passages", "k int, text string", [(1, "One two. Three four five.\n\nSix seven."), (2, "aa bb cc dd"), (3, "  ")], _udf(lambda t: "|".join(toxic.passages(t, 2))), "k int, out string", [(1, "One two.|Three four|five.|Six seven."), (2, "aa bb|cc dd"), (3, "")])
labelled("toxic_labelled_lines", "k int, text string, lang string", [(1, "fine\nyou moron\nok", "en"), (2, "moronic", "en"), (3, "you moron", "nl")], lambda df: toxic.remove_listed_lines(df, _LEX), "k int, text string, n_removed int", [(1, "fine ok", 1), (2, "moronic", 0), (3, "you moron", 0)])


class Shout:
    """A model that gives the prompt in capitals, and nothing for "drop"."""

    name = "madlad-test"

    def generate(self, prompts: Sequence[str], max_tokens: int, temperature: float) -> list[str]:
        return ["" if "drop" in p else p.upper() for p in prompts]


labelled("llm_labelled_generate", "k int, text string", [(1, "abc"), (2, "drop me"), (3, "xyz xyz")], lambda df: chunks.generate(df.coalesce(1), "Say {text}!", Shout, batch_size=2).select("k", "text", "meta.model_name", "meta.input_text"), "k int, text string, model_name string, input_text string", [(1, "SAY ABC!", "madlad-test", "abc"), (3, "SAY XYZ XYZ!", "madlad-test", "xyz xyz")])
labelled("llm_labelled_prompt_cut", "k int, text string", [(1, "abcdefghij"), (2, ""), (3, None)], lambda df: df.select("k", chunks.prompt(F.col("text"), "<{text}>", 12).alias("prompt")), "k int, prompt string", [(1, "<abcd>"), (2, "<>"), (3, None)])
labelled("llm_labelled_batches", "k int, text string", [(1, "abcde")], _udf(lambda t: "|".join("".join(b) for b in chunks.batched(t, 2))), "k int, out string", [(1, "ab|cd|e")])
labelled("translate_labelled", "doc_id int, text string", [(1, "abc\ndef")], lambda df: chunks.combine_translations(chunks.translate(chunks.translation_chunks(df, 4), "madlad-test", Shout).orderBy("row_splitter_pos")), "doc_id int, text string, chunk_id string", [(1, "<2NL> ABC  <2NL> DEF", "[0:4],[4:7]")])
labelled("translate_labelled_affixes", "k int, text string", [(1, "opus-mt"), (2, "madlad400"), (3, "GemmaX2-28"), (4, "x-bible")], _udf(lambda t: "[{}][{}]".format(*chunks.affixes(t)).replace("\n", "/")), "k int, out string", [(1, "[][]"), (2, "[][<2nl> ]"), (3, "[Translate this from English to Dutch:/English:][/Dutch:]"), (4, "[][>>nld<<]")])


class Pairs:
    """A tokenizer whose tokens are two characters each."""

    def encode(self, text: str) -> list[str]:
        return [text[i : i + 2] for i in range(0, len(text), 2)]

    def decode(self, tokens: Sequence[str]) -> str:
        return "".join(tokens)


labelled("translate_labelled_tokens", "doc_id int, text string", [(1, "abcdefg"), (2, ""), (3, None), (4, "x\ny")], lambda df: chunks.translation_chunks(df, 2, mode="tokens", tokenizer=Pairs).select("doc_id", "row_splitter_pos", "chunk_id", "text"), "doc_id int, row_splitter_pos int, chunk_id string, text string", [(1, 0, "[0:2]", "abcd"), (1, 1, "[2:4]", "efg"), (4, 0, "[0:2]", "x y")])

class Repeats:
    """A causal model: repeats the prompt, then goes on."""

    name = "causal"

    def generate(self, prompts: Sequence[str], max_tokens: int, temperature: float) -> list[str]:
        return [f"{p} and so on" for p in prompts]


labelled("translate_labelled_stripped", "k int, text string", [(1, "abc"), (2, "x y")], lambda df: chunks.generate(df, "{text}", lambda: chunks.Stripped(Repeats())), "k int, text string", [(1, "and so on"), (2, "and so on")])
labelled("translate_labelled_engines", "k int, text string", [(1, "opus-mt-en-nl"), (2, "GemmaX2-28"), (3, "madlad400-10b")], _udf(chunks.engine), "k int, out string", [(1, "marian"), (2, "causal"), (3, "seq2seq")])
labelled("translate_labelled_titles", "k int, title string, chunk_id string", [(1, "A page", "[0:4]"), (2, None, "[4:8]")], chunks.titled, "k int, chunk_title string", [(1, "A page[0:4]"), (2, "[4:8]")])
labelled("toxic_labelled_measured", "k int, text string, lang string", [(1, "moron. Fine.", "en")], lambda df: toxic.remove_toxic(df, lambda: toxic.Lexicon(_LEX), max_chunk_length=7, measure=lambda: len), "k int, text string", [(1, "Fine.")])


def _model(texts: Sequence[str], labels: Sequence[str], language: str) -> list[list[dict]]:
    """Finds "Bo Li" as tagged tokens, with labels of its own."""
    return [[{"start": t.find("Bo"), "end": t.find("Bo") + 2, "text": "Bo", "label": "B-PER", "score": 0.9}, {"start": t.find("Li"), "end": t.find("Li") + 2, "text": "Li", "label": "I-PER", "score": 0.8}] if "Bo Li" in t else [] for t in texts]


labelled("ner_labelled_adapter", "k int, text string, lang string", [(1, "here is Bo Li now", "en"), (2, "nobody", "en")], lambda df: pii.run_chain(df, [ner.step(lambda: ner.Adapter(_model, ["en"], names={"person": "PER"}, tags=True), labels=["person"])]), "k int, text string", [(1, "here is <person> now"), (2, "nobody")])
labelled("ner_labelled_registry", "k int, text string", [(1, "capitals")], lambda df: df.select("k", F.lit(ner.recognizer("capitals") is ner.CapitalizedNames).alias("ok"), F.udf(lambda _: ner.device(), "string")("text").alias("device")), "k int, ok boolean, device string", [(1, True, "cpu")])
labelled("ner_labelled_service_labels", "k int", [(1,)], lambda df: df.select("k", F.lit(sum(n in ner.SERVICE_LABELS for n in pii.SPECS)).alias("n"), F.lit(ner.SERVICE_LABELS["IBAN"]).alias("iban"), F.lit(len(ner.SELECTION)).alias("kinds")), "k int, n int, iban string, kinds int", [(1, 34, "BANK_ACCOUNT", 23)])

# --- filters --------------------------------------------------------------------------------------------------------

_WORDS8 = "There are some words in this line here."


def _reason(f: filters.Filter) -> Callable[[DataFrame], DataFrame]:
    return lambda df: f.annotate(df).select("k", F.col(f.reason).alias("reason"))


_GQ = filters.GopherQuality(min_doc_words=10, max_doc_words=1000, min_avg_word_length=3, max_avg_word_length=8)
labelled(
    "gopher_labelled_reasons", "k int, text string, lang string",
    [(1, "Much too short.", "en"), (2, "an to " * 20, "en"), (3, "incomprehensible " * 20, "en"), (4, "#letters " * 20, "en"), (5, "... letters " * 20, "en"), (6, "- bullet lines with words\n" * 10, "en"), (7, "a line that ends so ...\n" * 3 + "words " * 50, "en"), (8, "%$ words @! " * 20, "en"), (9, "letters words " * 20, "en"), (10, "the letters and the words " * 10, "en"), (11, "de letters en de woorden " * 10, "nl"), (12, "les lettres et les mots " * 10, "fr"), (13, None, "en"), (14, "words and the letters " * 300, "en")],
    _reason(_GQ), "k int, reason string",
    [(1, "gopher_short_doc"), (2, "gopher_below_avg_threshold"), (3, "gopher_above_avg_threshold"), (4, "gopher_too_many_hashes"), (5, "gopher_too_many_ellipsis"), (6, "gopher_too_many_bullets"), (7, "gopher_too_many_end_ellipsis"), (8, "gopher_below_alpha_threshold"), (9, "gopher_enough_stop_words"), (10, None), (11, None), (12, None), (13, None), (14, "gopher_long_doc")],
)
_LONG = "One more paragraph that is a good deal longer than the others are, and stands here twice, word by word."
labelled(
    "gopher_repetition_labelled_reasons", "k int, text string",
    [(1, "same line here\n" * 4), (2, "same paragraph\n\n" * 4), (3, f"First one.\n\nSecond one.\n\nThird one.\n\n{_LONG}\n\n{_LONG}"), (4, f"First one.\nSecond one.\nThird one.\n{_LONG}\n{_LONG}"), (5, "go now, go now, go now, go now"), (6, " ".join(f"word{i}" for i in range(40))), (7, ""), (8, None)],
    _reason(filters.GopherRepetition()), "k int, reason string",
    [(1, "dup_line_frac"), (2, "dup_para_frac"), (3, "dup_para_char_frac"), (4, "dup_line_char_frac"), (5, "top_2_gram"), (6, None), (7, None), (8, None)],
)
labelled(
    "gopher_repetition_labelled_ngrams", "k int, text string", [(1, "a b c d e a b c d e x"), (2, "a b c d e f g h i j"), (3, "x x x x x x x x x x x x x x x")],
    lambda df: filters.GopherRepetition().annotate(df).select("k", F.explode(F.col("gopher_repetition")["dup_n_grams"]).alias("n", "f")).select("k", "n", F.round("f", 6).alias("frac")).where("n < 7"), "k int, n int, frac double",
    [(1, 5, round(5 / 21, 6)), (1, 6, 0.0), (2, 5, 0.0), (2, 6, 0.0), (3, 5, round(10 / 29, 6)), (3, 6, round(12 / 29, 6))],
)
labelled("filters_labelled_off", "k int, text string, lang string", [(1, "short", "en"), (2, None, "en"), (3, "{ lorem ipsum", "en")], lambda df: _GQ.__class__(do_filter=False).annotate(filters.NordicPileQuality(do_filter=False).annotate(df)).select("k", F.col("gopher_quality_reason").alias("a"), F.col("nordicpile_reason").alias("b")), "k int, a string, b string", [(1, None, None), (2, None, None), (3, None, None)])
labelled(
    "nordicpile_labelled_reasons", "k int, text string", [(1, "Some words stand here 12345678"), (2, "one two three"), (3, "ab cd ef\n" * 3), (4, "extraordinarily\n" * 10), (5, f"{_WORDS8}\n" * 3), (6, " \n "), (7, None)], _reason(filters.NordicPileQuality(min_n_char=15)), "k int, reason string",
    [(1, "nordicpile_digit_fraction"), (2, "nordicpile_short_doc"), (3, "nordicpile_mean_med_char"), (4, "nordicpile_mean_med_word"), (5, None), (6, "empty_text"), (7, None)],
)
labelled(
    "line_length_labelled", "k int, text string", [(1, "a line of text\r\nand another one"), (2, "short"), (3, ""), (4, "abc\u2028defghijklmnop"), (5, None), (6, "x" * 11_000)], lambda df: filters.LineLength().annotate(df).select("k", "line_length.line_length", "line_length.avg_line_length", F.col("line_length_reason").alias("reason")),
    "k int, line_length int, avg_line_length double, reason string", [(1, 15, 14.5, None), (2, 5, 5.0, "min_line_length"), (3, 0, 0.0, "min_line_length"), (4, 13, 8.0, "avg_line_length"), (5, None, None, None), (6, 11000, 11000.0, "max_line_length")],
)
labelled(
    "fineweb_labelled_reasons", "k int, text string", [(1, "No end marks at all\n" * 3), (2, "Ends.\n" + "x\n" * 8 + "x."), (3, f"{_WORDS8}\n{_WORDS8}"), (4, f"{_WORDS8}\nAnother line is this one, quite another."), (5, "a\nb\nc.\nd"), (6, None)], _reason(filters.FineWebQuality(short_line_thr=0.9)), "k int, reason string",
    [(1, "line_punct_ratio"), (2, "short_line_ratio"), (3, "char_dup_ratio"), (4, None), (5, "short_line_ratio"), (6, None)],
)
_OK = "This line has enough words and ends well."
labelled(
    "c4_labelled_quality", "k int, text string",
    [(1, f"{_OK}\n" * 5), (2, f"{_OK}\n" * 4), (3, f"{_OK}\n" * 5 + "menu item"), (4, f"{_OK}\n" * 5 + "Lorem ipsum stands here too."), (5, f"{_OK}\n" * 5 + "A curly { stands here too."), (6, f"{_OK}\n" * 5 + "Please enable javascript on this site."), (7, f"{_OK}\n" * 5 + "Read our privacy policy before you go."), (8, f"{_OK} [12] [edit]\n" * 5), (9, f"{_OK[:-1]} [12].\n" * 5), (10, f"{_OK}\n" * 5 + "Ends with dots ..."), (11, f"{_OK}\n" * 5 + f"A word {'x' * 1001} ends it."), (12, ""), (13, None)],
    lambda df: filters.C4Quality().annotate(df).select("k", "c4_quality.num_sentences", F.length("c4_quality.text").alias("kept"), F.col("c4_quality_reason").alias("reason")), "k int, num_sentences int, kept int, reason string",
    [(1, 5, 209, None), (2, 4, 167, "too_few_sentences"), (3, 5, 209, None), (4, None, 238, "lorem_ipsum"), (5, None, 236, "curly_bracket"), (6, 5, 209, None), (7, 5, 209, None), (8, 0, 0, "too_few_sentences"), (9, 5, 214, None), (10, 5, 209, None), (11, 5, 209, None), (12, 0, 0, "too_few_sentences"), (13, None, None, None)],
)
labelled(
    "c4_labelled_sentences", "k int, text string", [(1, f"{_OK} {_OK} {_OK} {_OK} {_OK} menu item"), (2, f"{_OK} Too few. {_OK}"), (3, None)], lambda df: filters.C4Quality(split_paragraph=False, min_num_sentences=3).annotate(df).select("k", "c4_quality.num_sentences", "c4_quality.text", F.col("c4_quality_reason").alias("reason")),
    "k int, num_sentences int, text string, reason string", [(1, 4, " ".join([_OK] * 4), None), (2, 2, f"{_OK} {_OK}", "too_few_sentences"), (3, None, None, None)],
)
_BAD = {"en": ["bad word", "vile"], "ja": ["sm", "悪い"], "zh": ["性", "坏"], "nl": []}
labelled(
    "c4_labelled_badwords", "doc_id int, text string, lang string",
    [(1, "a vile thing", "en"), (2, "vileness", "en"), (3, "BAD WORD!", "en"), (4, "smを", "ja"), (5, "とても悪いです", "ja"), (6, "性", "zh"), (7, "很坏的", "zh"), (8, "vile", "nl"), (9, "vile", None), (10, None, "en")],
    lambda df: filters.C4BadWords(words=_BAD).annotate(df).select("doc_id", F.col("c4_badwords_reason").isNotNull().alias("bad")), "doc_id int, bad boolean",
    [(1, True), (2, False), (3, True), (4, False), (5, True), (6, False), (7, True), (8, False), (9, True), (10, False)],
)
labelled("c4_labelled_badwords_substring", "doc_id int, text string, lang string", [(1, "vileness", "en"), (2, "good", "en")], lambda df: filters.C4BadWords(words=_BAD, match_mode="substring").annotate(df).select("doc_id", F.col("c4_badwords_reason").isNotNull().alias("bad")), "doc_id int, bad boolean", [(1, True), (2, False)])
labelled(
    "c4_labelled_badwords_kept_share", "n int", [(1000,)],
    lambda df: filters.C4BadWords(words=_BAD, keep_fraction=0.3).annotate(df.select(F.explode(F.sequence(F.lit(1), "n")).alias("doc_id"), F.lit("vile").alias("text"), F.lit("en").alias("lang"))).agg(F.count_if(F.col("c4_badwords_reason").isNull()).between(250, 350).alias("about_a_third"), F.count(F.lit(1)).alias("n")),
    "about_a_third boolean, n long", [(True, 1000)],
)
labelled("tokens_labelled_treebank", "k int, text string, lang string", [(1, "Don't stop, it's (very) good. " * 10, "en")], lambda df: filters.GopherQuality(tokenizer="treebank", min_doc_words=5).annotate(df).select("k", "gopher_quality.n_non_symbol_words"), "k int, n_non_symbol_words int", [(1, 70)])

# --- formatters, scores, language, pipeline ---------------------------------------------------------------------------

_DIRTY = [("sÃ­, claro", "sí, claro"), ("schÃ¶n", "schön"), ("âœ” No problems", "✔ No problems"), ("&lt;3 &amp; more", "<3 & more"), ("e\u0301", "é"), ("plain", "plain"), (None, None)]
labelled("fmt_labelled_unicode", "k int, text string", [(k, t) for k, (t, _) in enumerate(_DIRTY)], lambda df: df.select("k", formatters.unicode_fix(F.col("text")).alias("out")), "k int, out string", [(k, w) for k, (_, w) in enumerate(_DIRTY)])
labelled("fmt_labelled_punctuation", "k int, text string", [(1, "“a”—b，c１…【x】"), (2, "plain"), (3, None)], lambda df: df.select("k", formatters.punctuation(F.col("text")).alias("out")), "k int, out string", [(1, '"a" - b,c"...[x]'), (2, "plain"), (3, None)])
labelled("fmt_labelled_whitespace", "k int, text string", [(1, " f\u2003f\u00a0f\u3000f "), (2, "een gewone zin"), (3, None)], lambda df: df.select("k", formatters.whitespace(F.col("text")).alias("out")), "k int, out string", [(1, "f f f f"), (2, "een gewone zin"), (3, None)])
labelled("fmt_labelled_regex", "k int, text string", [(1, "ab AB"), (2, None)], lambda df: df.select("k", formatters.regex(F.col("text"), ["(a)(b)"], [r"\2\1"], [2]).alias("out")), "k int, out string", [(1, "ba BA"), (2, None)])
labelled("eval_labelled_confusion", "t string, label int, predicted int", [("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("a", 0, 1), ("b", 0, 0)], lambda df: evaluation.confusion(df, ["t"]), "t string, tp long, fp long, tn long, fn long, precision double, recall double, f1 double, ratio double", [("a", 1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5), ("b", 0, 0, 1, 0, 0.0, 0.0, 0.0, 0.0)])
labelled("eval_labelled_rows", "k int, label int, predicted int", [(1, 1, 1), (2, 1, 0), (3, 0, 0), (4, 0, 1)], lambda df: evaluation.rows_of(df, "fn").select("k", F.lit("fn").alias("kind")).union(evaluation.rows_of(df, "fp").select("k", F.lit("fp"))), "k int, kind string", [(2, "fn"), (4, "fp")])
labelled("language_labelled", "k int, text string, lang string", [(1, "the cat and the dog", None), (2, "de kat en de hond", None), (3, "zzz", None), (4, "the cat", "xx"), (5, None, None)], lambda df: perplexity.detect_language(df, {"en": ["the", "and"], "nl": ["de", "en"]}), "k int, lang string", [(1, "en"), (2, "nl"), (3, None), (4, "xx"), (5, None)])


class Length:
    def perplexity(self, text: str) -> float:
        return float(len(text))


labelled("perplexity_labelled_models", "k int, text string, lang string", [(1, "abc", "en"), (2, "abcd", "zz"), (3, None, "en"), (4, "ab", None)], lambda df: perplexity.model_perplexity(df, {"english": Length, "dutch": Length}).select("k", "perplexity_key", "perplexity"), "k int, perplexity_key string, perplexity double", [(1, "perplexity_english", 3.0), (2, "perplexity_dutch", 4.0), (3, "perplexity_english", None), (4, "perplexity_dutch", 2.0)])


def _counted(df: DataFrame) -> DataFrame:
    p = Pipeline([filters.LineLength(), filters.C4Quality(min_num_sentences=2)])
    p.run(df).count()
    for out in p.excluded.values():
        out.count()
    return df.sparkSession.createDataFrame(sorted(p.counts().items()), "step string, n long")


labelled("pipeline_labelled_counters", "k int, text string", [(1, f"{_OK}\n{_OK}"), (2, "x"), (3, f"{_OK}\nmenu item"), (4, f"{_OK}\n{_OK}")], _counted, "step string, n long", [("0-line_length", 4), ("1-c4_quality", 3)])
