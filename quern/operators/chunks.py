"""1-to-N and N-to-1 row operators: splitting texts, generating from the pieces, combining them again."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TextGenerator(Protocol):
    """A model that continues prompts. Loaded once per Python worker by the factory that the step is given."""

    name: str

    def generate(self, prompts: Sequence[str], max_tokens: int, temperature: float) -> Sequence[str]: ...


class Tokenizer(Protocol):
    """Of a translation model; built once per Python worker."""

    def encode(self, text: str) -> Sequence: ...

    def decode(self, tokens: Sequence) -> str: ...


class Echo:
    """The offline stand-in: gives each prompt back."""

    name = "echo"

    def generate(self, prompts: Sequence[str], max_tokens: int, temperature: float) -> Sequence[str]:
        return list(prompts)


def batched(items: Sequence, n: int) -> Iterator[tuple]:
    if n < 1:
        raise ValueError("n must be at least one")
    for i in range(0, len(items), n):
        yield tuple(items[i : i + n])


def split_rows(df: DataFrame, separator: str = "\n", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each part of text: all other columns, row_splitter_id (from id and text), row_splitter_pos."""
    parts = F.split(F.col(text), "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    keyed = df.withColumn("row_splitter_id", F.sha1(F.concat_ws("\u0001", F.col(id_col).cast("string"), F.col(text))))
    others = [c for c in keyed.columns if c != text]
    return keyed.select(*others, F.posexplode(parts).alias("row_splitter_pos", text))


def combine_rows(df: DataFrame, separator: str = "\n", text: str = "text", keep: Sequence[str] = ("doc_id",), lists: Sequence[str] = ()) -> DataFrame:
    """One row a row_splitter_id: parts joined in order, `keep` from the first part, `lists` as arrays in order.

    The only step of the three that shuffles.
    """
    for c in ("row_splitter_id", "row_splitter_pos"):
        if c not in df.columns:
            raise ValueError(f"no column {c}: the rows don't come from a splitter")
    part = F.struct("row_splitter_pos", F.col(text).alias("part__"), *keep, *lists)
    rows = df.groupBy("row_splitter_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    each = lambda name: F.transform("p", lambda x: x[name])
    return rows.select(*(F.get("p", F.lit(0))[c].alias(c) for c in keep), F.array_join(each("part__"), separator).alias(text), *(each(c).alias(c) for c in lists))


def prompt(c: Column, template: str, max_context: int = 16_384) -> Column:
    """The template with {text} replaced by the text, cut to a third of the context's tokens in characters."""
    return F.replace(F.lit(template), F.lit("{text}"), F.substring(c, 1, max_context // 3))


def generate(
    df: DataFrame, template: str, make: Callable[[], TextGenerator] = Echo, text: str = "text", max_tokens: int | None = None, temperature: float = 0.0, batch_size: int = 10, max_context: int = 16_384, debug: bool = False
) -> DataFrame:
    """text replaced by what the model makes of the prompt; rows of which it makes nothing go. meta says how.

    max_tokens defaults, for each batch, to a third of the characters of its longest text. debug raises where a row would go.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least one")
    keyed = df.withColumn("__prompt", prompt(F.col(text), template, max_context))
    schema = df.withColumn("meta", F.struct(*(F.lit(None).cast(t).alias(n) for n, t in _META))).schema

    columns = df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        names = [n for n, _ in _META]
        for b in it:
            for s in range(0, b.num_rows, batch_size):
                part = b.slice(s, batch_size)
                texts, prompts = part[text].to_pylist(), part["__prompt"].to_pylist()
                n = max_tokens or max((len(t or "") for t in texts), default=0) // 3
                out = list(model.generate([p or "" for p in prompts], n, temperature))
                if debug and not all(out):
                    raise ValueError("the model gave nothing for a text")
                meta = [dict(zip(names, (model.name, template, t, n, temperature))) for t in texts]
                cols = [pa.array(out, pa.string()) if c == text else part[c] for c in columns]
                made = pa.RecordBatch.from_arrays([*cols, pa.array(meta, pa.struct([(n, _ARROW[t]) for n, t in _META]))], [*columns, "meta"])
                yield made.filter(pa.array([bool(o) for o in out]))

    return keyed.mapInArrow(run, schema)


_META = (("model_name", "string"), ("prompt_template", "string"), ("input_text", "string"), ("max_tokens", "int"), ("temperature", "double"))
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

#: (prefix, suffix) of a translation model's prompt, by a part of its name.
AFFIXES: dict[str, tuple[str, str]] = {"bible": ("", ">>nld<<"), "opus": ("", ""), "madlad": ("", "<2nl> "), "GemmaX2": ("Translate this from {src} to {dst}:\n{src}:", "\n{dst}:")}


def affixes(model_name: str, src: str = "English", dst: str = "Dutch") -> tuple[str, str]:
    for part, (a, b) in AFFIXES.items():
        if part in model_name:
            return a.replace("{src}", src).replace("{dst}", dst), b.replace("{src}", src).replace("{dst}", dst)
    raise ValueError(f"no prompt for model {model_name}")


#: Kinds of translation engines, by a part of the model's name; others are sequence-to-sequence models.
ENGINES = {"opus": "marian", "GemmaX2": "causal"}
LOADERS: dict[str, Callable[[str], TextGenerator]] = {}


def engine(model_name: str) -> str:
    return next((kind for part, kind in ENGINES.items() if part in model_name), "seq2seq")


def register_loader(kind: str, load: Callable[[str], TextGenerator]) -> None:
    """How models of a kind are loaded: marian, causal, seq2seq, or batched for an engine that serves any of them."""
    LOADERS[kind] = load


def loader(model_name: str, batched_engine: bool = False) -> Callable[[], TextGenerator]:
    """A factory for translate(): loads the model on the worker that runs it."""
    kind = "batched" if batched_engine else engine(model_name)
    if kind not in LOADERS:
        raise ValueError(f"no loader for {kind} models")
    load = LOADERS[kind]
    return lambda: load(model_name)


class Stripped:
    """A causal model's output without the prompt that it repeats first."""

    def __init__(self, model: TextGenerator) -> None:
        self.model, self.name = model, model.name

    def generate(self, prompts: Sequence[str], max_tokens: int, temperature: float) -> list[str]:
        return [o.removeprefix(p).strip() for p, o in zip(prompts, self.model.generate(prompts, max_tokens, temperature))]


def titled(df: DataFrame, title: str = "title", chunk_id: str = "chunk_id") -> DataFrame:
    """Chunks with the title and the chunk's id as one, to name its row by."""
    return df.withColumn("chunk_title", F.concat_ws("", F.col(title), F.col(chunk_id)))


def translation_chunks(df: DataFrame, chunk_size: int = 1024, text: str = "text", id_col: str = "doc_id", mode: str = "characters", stop_at: int | None = None, batched_engine: bool = False, tokenizer: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """A row for each chunk of chunk_size characters: row_splitter_id, row_splitter_pos, chunk_id "[start:end]", text.

    Line breaks become spaces first. stop_at limits the documents. With mode
    tokens, chunks have chunk_size tokens of tokenizer, and chunk ids count
    tokens; an engine that tokenizes batches by itself can't have them.
    """
    if mode not in ("characters", "tokens"):
        raise ValueError("mode must be characters or tokens")
    if mode == "tokens" and (batched_engine or tokenizer is None):
        raise NotImplementedError("a batched engine can't chunk by tokens" if batched_engine else "chunks by tokens need a tokenizer")
    if chunk_size < 1:
        raise ValueError("chunk_size must be at least one")
    if stop_at is not None:
        df = df.limit(stop_at)
    flat = F.replace(F.col(text), F.lit("\n"), F.lit(" "))
    keyed = df.withColumn("row_splitter_id", F.sha1(F.concat_ws("\u0001", F.col(id_col).cast("string"), F.col(text)))).withColumn(text, flat)
    if mode == "tokens":
        return _token_chunks(keyed, chunk_size, text, tokenizer)
    n = F.length(text)
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk_size).cast("int")), lambda i: i * chunk_size)).otherwise(F.array().cast("array<int>"))
    others = [c for c in keyed.columns if c != text]
    rows = keyed.select(*others, F.col(text).alias("__t"), F.posexplode(starts).alias("row_splitter_pos", "__s"))
    end = F.least(F.col("__s") + chunk_size, F.length("__t"))
    return rows.select(*others, "row_splitter_pos", F.concat(F.lit("["), F.col("__s").cast("string"), F.lit(":"), end.cast("string"), F.lit("]")).alias("chunk_id"), F.substring("__t", F.col("__s") + 1, F.lit(chunk_size)).alias(text))


def _token_chunks(keyed: DataFrame, size: int, text: str, make: Callable[[], Tokenizer]) -> DataFrame:
    others = [c for c in keyed.columns if c != text]
    schema = keyed.select(*others, F.lit(0).alias("row_splitter_pos"), F.lit("").alias("chunk_id"), text).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for b in it:
            rows: list[tuple[int, int, str, str]] = []
            for k, t in enumerate(b[text].to_pylist()):
                tokens = coder.encode(t) if t else []
                for i, s in enumerate(range(0, len(tokens), size)):
                    part = tokens[s : s + size]
                    rows.append((k, i, f"[{s}:{s + len(part)}]", coder.decode(part)))
            at, pos, ids, texts = zip(*rows) if rows else ([], [], [], [])
            cols = [b[c].take(pa.array(at, pa.int64())) for c in others]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pos, pa.int32()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], [*others, "row_splitter_pos", "chunk_id", text])

    return keyed.mapInArrow(run, schema)


def translate(df: DataFrame, model_name: str, make: Callable[[], TextGenerator] | None = None, text: str = "text", batch_size: int = 128, src: str = "English", dst: str = "Dutch", dry_run: bool = False) -> DataFrame:
    """Chunks with translated text; empty translations go. A dry run gives the source back and loads no model."""
    if dry_run or make is None:
        return generate(df, "{text}", Echo, text, batch_size=batch_size, max_context=3 * 2**30)
    a, b = affixes(model_name, src, dst)
    return generate(df, f"{a}{{text}}{b}" if "madlad" not in model_name and "bible" not in model_name else f"{b}{{text}}", make, text, batch_size=batch_size, max_context=3 * 2**30)


def combine_translations(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row a document: chunks joined by spaces, chunk ids by commas, source texts (where meta has them) as a list."""
    src = df.withColumn("input_text", F.col("meta")["input_text"]) if "meta" in df.columns else df.withColumn("input_text", F.col(text))
    out = combine_rows(src, " ", text, keep, ("chunk_id", "input_text"))
    return out.withColumn("chunk_id", F.array_join("chunk_id", ","))
