"""Entities in text: recognizers behind a protocol, masking of their spans, grouping of name mentions, synthetic values."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import parts

Entity = dict  # start, end, text, label, score and, once chosen, mask; offsets in characters


class EntityRecognizer(Protocol):
    """Loaded once per Python worker. languages: those it reads; texts in others are left alone."""

    languages: Sequence[str]
    max_chars: int

    def recognize(self, texts: Sequence[str], labels: Sequence[str], language: str) -> list[list[Entity]]: ...


class CapitalizedNames:
    """The offline stand-in: two or more capitalised words in a row, none opening a sentence alone, are a person; with a company suffix, an organisation."""

    languages = ("nl", "en", "de", "fr", "es")
    max_chars = 5000
    _run = re.compile(r"[^\W\d_a-z]\w+(?:[ -](?:(?:van|de|der|den|von|da|di|la|le) )*[^\W\d_a-z]\w+)+(?: (?:BV|NV|Inc|Ltd|GmbH|SA|LLC)\b)?")
    _org = re.compile(r" (?:BV|NV|Inc|Ltd|GmbH|SA|LLC)$")

    def recognize(self, texts: Sequence[str], labels: Sequence[str], language: str) -> list[list[Entity]]:
        out = []
        for t in texts:
            found = []
            for m in self._run.finditer(t):
                label = "organisation" if self._org.search(m[0]) else "person"
                if label in labels:
                    found.append({"start": m.start(), "end": m.end(), "text": m[0], "label": label, "score": 1.0})
            out.append(found)
        return out


#: Recognizers by name. Adapters of real models are added by register(); each loads its model once a worker.
RECOGNIZERS: dict[str, Callable[[], EntityRecognizer]] = {"capitals": CapitalizedNames}


def register(name: str, make: Callable[[], EntityRecognizer]) -> None:
    RECOGNIZERS[name] = make


def recognizer(name: str) -> Callable[[], EntityRecognizer]:
    if name not in RECOGNIZERS:
        raise ValueError(f"no recognizer {name}; there are {', '.join(sorted(RECOGNIZERS))}")
    return RECOGNIZERS[name]


class Adapter:
    """A model as a recognizer: predict gives, for each text, (start, end, label, score) or tags of tokens to be merged.

    names: the model's label for each of ours. Labels that nobody asked for and
    scores below least are left out.
    """

    def __init__(self, predict: Callable[[Sequence[str], Sequence[str], str], Sequence[Sequence[Entity]]], languages: Sequence[str], max_chars: int = 5000, names: Mapping[str, str] | None = None, tags: bool = False, least: float = 0.0) -> None:
        self.predict, self.languages, self.max_chars, self.tags, self.least = predict, languages, max_chars, tags, least
        self.names = dict(names or {})

    def recognize(self, texts: Sequence[str], labels: Sequence[str], language: str) -> list[list[Entity]]:
        ours = {self.names.get(l, l): l for l in labels}
        out = []
        for t, found in zip(texts, self.predict(texts, list(ours), language)):
            es = merge_tags(found) if self.tags else [dict(e) for e in found]
            out.append([e | {"text": t[e["start"] : e["end"]], "label": ours[e["label"]]} for e in es if e["label"] in ours and e["score"] >= self.least])
        return out


def device() -> str:
    """Where a worker's model goes: the GPU that Spark gave the task (spark.task.resource.gpu.amount), else the CPU."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    gpus = ctx.resources().get("gpu") if ctx else None
    return f"cuda:{gpus.addresses[0]}" if gpus and gpus.addresses else "cpu"


def split_chunks(text: str, limit: int, mode: str = "words") -> list[str]:
    """Pieces of at most limit characters that join to the text: by characters, words or sentences. A longer word or sentence is a piece of its own."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if mode == "characters":
        return [text[i : i + limit] for i in range(0, len(text), limit)]
    if mode not in ("words", "sentences"):
        raise ValueError("mode must be words, sentences or characters")
    parts = re.findall(r"\S+\s*|\s+" if mode == "words" else r".+?(?:[.!?]+[\"')\]]*\s+|$)|\s+", text, re.DOTALL)
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(p) <= limit:
            out[-1] += p
        else:
            out.append(p)
    return out


def shifted(entities: Sequence[Sequence[Entity]], chunks: Sequence[str]) -> list[Entity]:
    """Entities of chunks, with offsets in the whole text."""
    out, at = [], 0
    for es, c in zip(entities, chunks):
        out += [e | {"start": e["start"] + at, "end": e["end"] + at} for e in es]
        at += len(c)
    return out


def merge_tags(tokens: Sequence[Entity], space_replacer: str | None = None) -> list[Entity]:
    """Token tags B-x and I-x as entities: an I- tag or a token that touches the last one goes on with it; score is the greatest."""
    out: list[Entity] = []
    for t in tokens:
        tag, _, label = t["label"].partition("-")
        if not label:
            tag, label = "B", t["label"]
        text = t["text"].replace(space_replacer, " ") if space_replacer else t["text"]
        last = out[-1] if out else None
        if last and last["label"] == label and (tag == "I" or t["start"] == last["end"]):
            gap = " " * (t["start"] - last["end"]) if not text.startswith(" ") else ""
            last |= {"end": t["end"], "text": last["text"] + gap + text, "score": max(last["score"], t["score"])}
        else:
            out.append({"start": t["start"], "end": t["end"], "text": text.strip(), "label": label, "score": t["score"]})
    return out


def name_parts(name: str) -> set[str]:
    return set(re.sub(r"[^\w\s]", "", name).lower().split())


def group_names(entities: Sequence[Entity], mask: str | None = None) -> list[Entity]:
    """Entities with masks numbered by group: mentions of a label that share a part of the name, directly or through others, are one group."""
    out = [dict(e) for e in entities]
    number: dict[str, int] = {}
    for label in dict.fromkeys(e["label"] for e in out):
        mine = [e for e in out if e["label"] == label]
        root = list(range(len(mine)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        first: dict[str, int] = {}
        for i, e in enumerate(mine):
            for p in name_parts(e["text"]):
                a, b = find(i), find(first.setdefault(p, i))
                root[max(a, b)] = min(a, b)
        groups: dict[int, int] = {}
        for i, e in enumerate(mine):
            g = groups.setdefault(find(i), len(groups) + 1)
            e["mask"] = f"{mask or default_mask(label)}{g}"
        number[label] = len(groups)
    return out


def default_mask(label: str) -> str:
    return f"<{label.replace(' ', '_').lower()}>"


def replace_spans(text: str, entities: Sequence[Entity], masks: Sequence[str] | str | None = None, labels: Sequence[str] = (), valid: Callable[[str], bool] | None = None) -> tuple[str, list[Entity], list[Entity]]:
    """(text with masks for entities, entities replaced, entities that the validator kept). From the right, so offsets hold."""
    done, kept = [], []
    for e in sorted(entities, key=lambda e: -e["start"]):
        if valid and not valid(e["text"]):
            kept.append(e)
            continue
        m = e.get("mask") or (masks if isinstance(masks, str) else masks[list(labels).index(e["label"])] if masks and e["label"] in labels else default_mask(e["label"]))
        text = text[: e["start"]] + m + text[e["end"] :]
        done.append(e | {"mask": m})
    return text, done[::-1], kept[::-1]


def recognize_long(model: EntityRecognizer, text: str, labels: Sequence[str], language: str, batch: int = 32) -> list[Entity]:
    chunks = split_chunks(text, model.max_chars)
    found: list[list[Entity]] = []
    for i in range(0, len(chunks), batch):
        found += model.recognize(chunks[i : i + batch], labels, language)
    return shifted(found, chunks)


_DID = pa.struct([("entity_types", pa.list_(pa.string())), ("entity_type_counts", pa.list_(pa.int32())), ("masks", pa.list_(pa.string())), ("mask_counts", pa.list_(pa.int32()))])


def step(make: Callable[[], EntityRecognizer] = CapitalizedNames, labels: Sequence[str] = ("person", "organisation"), masks: Sequence[str] | str | None = None, group: bool = False, lang: str = "lang", valid: Callable[[str], bool] | None = None, fallback: str = "nl") -> Callable[[DataFrame, str, str], DataFrame]:
    """A step of pii.run_chain: masks what the recognizer finds. Languages that it doesn't read are taken as the fallback."""

    def run_on(df: DataFrame, text: str, did: str) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = make()
            for b in parts(it):
                langs = b[lang].to_pylist() if lang in b.schema.names else [fallback] * b.num_rows
                texts, dids = b[text].to_pylist(), b[did].to_pylist()
                for k, t in enumerate(texts):
                    if not t:
                        continue
                    l = langs[k] if langs[k] in model.languages else fallback
                    found = recognize_long(model, t, labels, l)
                    if group:
                        found = group_names(found, masks if isinstance(masks, str) else None)
                    texts[k], done, _ = replace_spans(t, found, masks, labels, valid)
                    ty, ma = (Counter(e[key] for e in done) for key in ("label", "mask"))
                    dids[k] = [*(dids[k] or []), {"entity_types": list(ty), "entity_type_counts": list(ty.values()), "masks": list(ma), "mask_counts": list(ma.values())}]
                cols = [pa.array(texts, pa.string()) if n == text else pa.array(dids, pa.list_(_DID)) if n == did else b[n] for n in b.schema.names]
                yield pa.RecordBatch.from_arrays(cols, b.schema.names)

        return df.mapInArrow(run, df.schema)

    return run_on


def co_occurrence(names: DataFrame, doc: str = "doc_id", name: str = "name") -> DataFrame:
    """(part_a, part_b, n): documents in which two parts of names occur, part_a before part_b in the alphabet."""
    parts = names.select(doc, F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace(name, r"[^\w\s]", "")), r"\s+"))).alias("p")).where("p <> ''").distinct()
    a, b = parts.toDF("d", "part_a"), parts.toDF("d", "part_b")
    return a.join(b, "d").where("part_a < part_b").groupBy("part_a", "part_b").agg(F.count(F.lit(1)).alias("n"))


def public_figures(df: DataFrame, figures: DataFrame, name: str = "name") -> DataFrame:
    """df with is_public: the trimmed full name is a label or alias of figures (a table of one column, name)."""
    known = figures.select(F.trim(F.col(figures.columns[0])).alias("__n")).distinct().withColumn("__k", F.lit(True))
    return df.join(known, F.trim(F.col(name)) == F.col("__n"), "left").withColumn("is_public", F.coalesce("__k", F.lit(False))).drop("__n", "__k")


# --- synthetic replacement ----------------------------------------------------------------------------------------

_FIRST = "Anna Bram Clara Daan Emma Finn Greet Hugo Iris Jan Kees Lotte Mees Nina Otto Piet Roos Sem Tess Vera".split()
_LAST = "Bakker Visser Smit Meijer Mulder Bos Vos Peters Hendriks Dekker Brouwer Kok Jacobs Postma Kuiper".split()
_CITY = "Amstelhoek Beekdorp Cruquius Duinrand Elsloo Grootveld Havenstad Kleinbeek Oosterwold Zuidkamp".split()
_SAFE = "ABCDEFGHIJKLMNPQRSTUVWXYZ123456789"


def synthetic(kind: Column, key: Column, seed: Column, chance: float = 1.0) -> Column:
    """A replacement of this kind of entity, the same for the same key and seed (the document); else [KIND].

    Values are functions of a hash, so no state is kept between rows.
    """
    h = lambda n: F.xxhash64(F.lower(F.trim(key)), seed.cast("string"), kind, F.lit(n))
    num = lambda n, digits: F.lpad(F.pmod(h(n), F.lit(10**digits)).cast("string"), digits, "0")
    pick_of = lambda n, xs: F.get(F.array(*map(F.lit, xs)), F.pmod(h(n), F.lit(len(xs))).cast("int"))
    letters = lambda n, k, xs: F.concat(*(pick_of(n + i, xs) for i in range(k)))
    unit = lambda n: F.pmod(h(n), F.lit(1_000_000)) / 1e6
    user = F.concat(F.lower(pick_of(1, _FIRST)), num(2, 3))
    made = {
        "NAME": F.concat(pick_of(1, _FIRST), F.lit(" "), pick_of(2, _LAST)), "NAME_GIVEN": pick_of(1, _FIRST), "NAME_FAMILY": pick_of(2, _LAST), "LOCATION_CITY": pick_of(1, _CITY),
        "DRIVER_LICENSE": num(1, 10), "HEALTHCARE_NUMBER": num(1, 9), "NUMERICAL_PII": num(1, 8), "PASSPORT_NUMBER": F.concat(letters(1, 2, list(_SAFE[:25])), letters(3, 5, list(_SAFE)), num(9, 1)),
        "LOCATION_COORDINATE": F.concat(F.format_number(50.75 + unit(1) * 2.8, 5), F.lit(", "), F.format_number(3.35 + unit(2) * 3.85, 5)),
        "USERNAME": user, "URL": F.concat(F.lit("https://"), user, F.lit(".example.com")), "EMAIL_ADDRESS": F.concat(user, F.lit("@example.com")), "PHONE_NUMBER": F.concat(F.lit("06"), num(1, 8)),
    }
    out: Column | None = None
    for k, v in made.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    tag = F.concat(F.lit("["), kind, F.lit("]"))
    return F.when(unit(99) < chance, F.coalesce(out, tag)).otherwise(tag)


# --- remote service -----------------------------------------------------------------------------------------------

GDPR = tuple("NAME NAME_GIVEN NAME_FAMILY EMAIL_ADDRESS PHONE_NUMBER LOCATION_ADDRESS LOCATION_CITY IP_ADDRESS DOB SSN PASSPORT_NUMBER DRIVER_LICENSE BANK_ACCOUNT CREDIT_CARD HEALTHCARE_NUMBER".split())


#: All 23 kinds that a service is asked for at most.
SELECTION = (*GDPR, *"AGE CREDIT_CARD_EXPIRATION CVV LOCATION_COORDINATE NUMERICAL_PII URL USERNAME VEHICLE_ID".split())
#: The service's label for each of the catalogue's types and entities.
SERVICE_LABELS: dict[str, str] = {
    kind: label for label, kinds in {
        "NAME": "Person", "ORGANISATION": "Organisation", "DOB": "Birthday", "LOCATION_ADDRESS_STREET": "Address", "EMAIL_ADDRESS": "EmailAddress", "IP_ADDRESS": "IPAddress", "URL": "FilePath URL", "NUMERICAL_PII": "MACAddress", "CVV": "CreditCardCVVCode",
        "CREDIT_CARD": "CreditCardNumber", "CREDIT_CARD_EXPIRATION": "CreditCardExpiryDate", "PHONE_NUMBER": "BelgianPhoneNumber DutchPhoneNumber InternationalPhoneNumber", "VEHICLE_ID": "BelgianLicencePlateNumber DutchLicensePlateNumber",
        "BANK_ACCOUNT": "AustralianBankAccountNumber CanadianBankAccountNumber EuropeanVATNumber IBAN USBankAccountNumber", "DRIVER_LICENSE": "AustralianDriversLicenseNumber DutchBelgianDriversLicenseNumber UKDriversLicenseNumber",
        "PASSPORT_NUMBER": "AustralianPassportNumber BelgianPassportNumber CanadianPassportNumber DutchIdentityDocumentNumber UK_USPassportNumber",
        "SSN": "AustralianTaxFileNumber BelgianIdentityNumber DutchIdentityNumberBSN DutchVreemdelingenDocumentNumber UKNationalInsuranceNumber UKUniqueTaxpayerReferenceNumber USIndividualTaxPayerIdentificationNumber USSocialSecurityNumber",
    }.items() for kind in kinds.split()
}


class PiiClient(Protocol):
    """A service that finds entities: one call a chunk. endpoint: one of several, by partition."""

    def process(self, chunk: str, entity_types: Sequence[str], mode: str) -> list[Entity]: ...


def remote(df: DataFrame, connect: Callable[[int], PiiClient], text: str = "text", id_col: str = "doc_id", entity_types: Sequence[str] = GDPR, mode: str = "MASK", chunk_chars: int = 5000, attempts: int = 5, wait: float = 10.0, keep: Sequence[str] = (), endpoints: int = 1) -> DataFrame:
    """Text masked by a remote service, with failed_chunks: chunks that kept their text because every attempt failed.

    connect gets an endpoint's number and gives a client, once a partition; one
    whose alive() says no is passed over. Attempts are wait seconds apart;
    names in keep stay as they are. Within a document, the same text of an
    entity is always replaced alike: by [LABEL], or in mode SYNTHETIC by what
    the service gives as mask. Chunks come in order.
    """
    schema = df.withColumn("failed_chunks", F.array().cast("array<int>")).schema
    public = frozenset(k.strip() for k in keep)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        first = ctx.partitionId() if ctx else 0
        # the partition's own endpoint, or the next one that answers
        for k in range(max(1, endpoints)):
            client = connect((first + k) % max(1, endpoints))
            if getattr(client, "alive", lambda: True)():
                break
        for b in it:
            texts, failed = b[text].to_pylist(), []
            for k, t in enumerate(texts):
                bad, out, known = [], [], {}
                for n, c in enumerate(split_chunks(t, chunk_chars) if t else []):
                    found = None
                    for turn in range(attempts):
                        if turn and wait:
                            time.sleep(wait)
                        try:
                            found = client.process(c, entity_types, mode)
                            break
                        except (OSError, TimeoutError, ValueError):
                            continue
                    if found is None:
                        bad.append(n)
                        out.append(c)
                        continue
                    es = [e | {"mask": known.setdefault((e["label"], e["text"].lower()), e.get("mask") if mode == "SYNTHETIC" and e.get("mask") else f"[{e['label']}]")} for e in found if e["text"].strip() not in public]
                    out.append(replace_spans(c, es)[0])
                if t:
                    texts[k] = "".join(out)
                failed.append(bad)
            cols = [pa.array(texts, pa.string()) if n == text else b[n] for n in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(failed, pa.list_(pa.int32()))], [*b.schema.names, "failed_chunks"])

    return df.mapInArrow(run, schema)
