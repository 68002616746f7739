"""Heuristic quality filters. All statistics are native expressions, but for the n-gram scan of GopherRepetition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..functions import text as T
from .step import Filter, over, under

POLICY = ("terms of use", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies")
ODD_SPACE = r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
CITATION = r"\[\d*\]|\[edit\]|\[citation needed\]"


@dataclass(frozen=True, kw_only=True)
class LineLength(Filter):
    """Bounds on the longest line and on the median line length. A bound of None or 0 is off."""

    min_line_length: int | None = 10
    max_line_length: int | None = 10_000
    min_avg_line_length: int | None = 10
    max_avg_line_length: int | None = 5_000
    name = "line_length"

    def prepare(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__n", T.lengths(T.split_lines(F.col(self.text))))

    def stats(self) -> Column:
        n = F.col("__n")
        return F.struct(F.coalesce(F.array_max(n), F.when(n.isNotNull(), 0)).alias("line_length"), F.coalesce(T.median(n), F.when(n.isNotNull(), 0.0)).alias("avg_line_length"))

    def rules(self, s: Column) -> list[tuple[Column | None, str]]:
        return [
            (under(s["line_length"], self.min_line_length), "min_line_length"), (over(s["line_length"], self.max_line_length), "max_line_length"),
            (under(s["avg_line_length"], self.min_avg_line_length), "avg_line_length"), (over(s["avg_line_length"], self.max_avg_line_length), "avg_line_length"),
        ]


@dataclass(frozen=True, kw_only=True)
class FineWebQuality(Filter):
    line_punct_thr: float = 0.12
    line_punct_exclude_zero: bool = False
    short_line_thr: float = 0.67
    short_line_length: int = 30
    char_duplicates_ratio: float = 0.01
    new_line_ratio: float = 0.3
    name = "fineweb"

    def prepare(self, df: DataFrame) -> DataFrame:
        t = F.col(self.text)
        return df.withColumn("__lines", F.split(t, "\n", -1)).withColumn("__full", F.filter("__lines", lambda x: x.rlike(T.VISIBLE))).withColumn("__tok", self.n_tokens(t))

    def stats(self) -> Column:
        t, lines = F.col(self.text), F.col("__lines")
        return F.struct(
            T.ratio(F.size(F.filter(lines, lambda x: x.rlike("[.'\"!?]$"))), F.size(lines)).alias("line_punct_ratio"),
            T.ratio(F.size(F.filter(lines, lambda x: F.length(x) <= self.short_line_length)), F.size(lines)).alias("short_line_ratio"),
            T.ratio(T.repeats(F.col("__full"))[1], F.length(F.replace(t, F.lit("\n"), F.lit("")))).alias("char_dup_ratio"),
            T.ratio(T.count_of(t, "\n"), F.col("__tok")).alias("list_ratio"),
        )

    def rules(self, s: Column) -> list[tuple[Column | None, str]]:
        low = s["line_punct_ratio"] <= self.line_punct_thr
        return [
            (low & (s["line_punct_ratio"] != 0) if self.line_punct_exclude_zero else low, "line_punct_ratio"), (s["short_line_ratio"] >= self.short_line_thr, "short_line_ratio"),
            (s["char_dup_ratio"] >= self.char_duplicates_ratio, "char_dup_ratio"), (s["list_ratio"] > self.new_line_ratio, "list_ratio"),
        ]


@dataclass(frozen=True, kw_only=True)
class GopherQuality(Filter):
    """Word, symbol, line and stop word rules. Languages without a stop word list are read as Dutch."""

    min_doc_words: int | None = 50
    max_doc_words: int | None = 100_000
    min_avg_word_length: float | None = 2
    max_avg_word_length: float | None = 10
    max_symbol_word_ratio: float | None = 0.1
    max_bullet_lines_ratio: float | None = 0.9
    max_ellipsis_lines_ratio: float | None = 0.3
    max_non_alpha_words_ratio: float | None = 0.8
    min_stop_words: int | None = 2
    stop_words: Sequence[str] | Mapping[str, Sequence[str]] | None = None
    name = "gopher_quality"

    def stop_lists(self) -> tuple[dict[str, Sequence[str]], Sequence[str]]:
        """Lists by language, and that of all other languages."""
        if isinstance(self.stop_words, Mapping):
            return dict(self.stop_words), self.stop_words.get(T.FALLBACK, ())
        if self.stop_words is not None:
            return {}, self.stop_words
        lists = {k: T.stop_words(k) for k in T.LANGUAGES}
        return lists, lists[T.FALLBACK]

    def prepare(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__tok", self.tokens(F.col(self.text))).withColumn("__words", F.filter("__tok", lambda x: ~x.rlike(f"^{T.PUNCTUATION}+$"))).withColumn("__lines", T.split_lines(F.col(self.text)))

    def stats(self) -> Column:
        t, tok, w, lines = F.col(self.text), F.col("__tok"), F.col("__words"), F.col("__lines")
        n = F.size(tok)
        return F.struct(
            F.size(w).alias("n_non_symbol_words"),
            T.mean(T.lengths(w)).alias("avg_word_length"),
            T.ratio(T.count_of(t, "#"), n).alias("hash_ratio"),
            T.ratio(T.count_of(t, "...") + T.count_of(t, "…"), n).alias("ellipsis_ratio"),
            T.ratio(F.size(F.filter(lines, lambda x: x.rlike(f"^[{T.WS}]*[•-]"))), F.size(lines)).alias("bullet_lines_ratio"),
            T.ratio(F.size(F.filter(lines, lambda x: x.rlike(f"([.][.][.]|…)[{T.WS}]*$"))), F.size(lines)).alias("ellipsis_lines_ratio"),
            T.ratio(F.size(F.filter(tok, lambda x: x.rlike(r"\p{L}"))) if self.tokenizer != "unicode" else T.n_matches(t, r"[\p{N}_]*\p{L}[\p{L}\p{N}_]*"), n).alias("alpha_words_ratio"),
            self.n_stop().alias("stop_words_count"),
        )

    def n_stop(self) -> Column:
        """Occurrences of stop words among __tok. The language is looked up once a text, a word in a set."""

        def count(ws: Sequence[str]) -> Column:
            if not ws:
                return F.when(F.col("__tok").isNotNull(), 0)
            words = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in ws)
            return F.expr(f"size(filter(__tok, x -> x IN ({words})))")

        lists, rest = self.stop_lists()
        return T.by_language(F.col(self.lang), {k: count(ws) for k, ws in lists.items()}, count(rest))

    def rules(self, s: Column) -> list[tuple[Column | None, str]]:
        return [
            (under(s["n_non_symbol_words"], self.min_doc_words), "gopher_short_doc"), (over(s["n_non_symbol_words"], self.max_doc_words), "gopher_long_doc"),
            (under(s["avg_word_length"], self.min_avg_word_length), "gopher_below_avg_threshold"), (over(s["avg_word_length"], self.max_avg_word_length), "gopher_above_avg_threshold"),
            (over(s["hash_ratio"], self.max_symbol_word_ratio), "gopher_too_many_hashes"), (over(s["ellipsis_ratio"], self.max_symbol_word_ratio), "gopher_too_many_ellipsis"),
            (over(s["bullet_lines_ratio"], self.max_bullet_lines_ratio), "gopher_too_many_bullets"), (over(s["ellipsis_lines_ratio"], self.max_ellipsis_lines_ratio), "gopher_too_many_end_ellipsis"),
            (under(s["alpha_words_ratio"], self.max_non_alpha_words_ratio), "gopher_below_alpha_threshold"), (under(s["stop_words_count"], self.min_stop_words), "gopher_enough_stop_words"),
        ]


def gram_chars(word: np.ndarray, size: np.ndarray, tops: Sequence[int], dups: Sequence[int]) -> list[int]:
    """For each n of tops, the length of the most frequent n-gram (words joined by spaces; of equally frequent ones the first) times its count.

    Then for each n of dups, the characters in n-grams seen before, scanning
    from the left and skipping over each repeat. word: 64-bit hashes of the
    words, size: their lengths; n-grams are compared by hashes of these.
    """
    word = np.asarray(word).view(np.uint64)
    pre = np.zeros(len(word) + 1, np.int64)
    np.cumsum(size, out=pre[1:])
    top: dict[int, int] = {}
    dup: dict[int, int] = {}
    # an n-gram that occurs twice begins with a shorter one that does: only places of these are looked at again
    at = np.arange(len(word))
    for n in sorted({*tops, *dups}):
        at = at[: np.searchsorted(at, len(word) - n, "right")]
        if not len(at):
            top[n], dup[n] = int(pre[n] + n - 1) if n <= len(word) else 0, 0
            continue
        h = np.zeros(len(at), np.uint64)
        whole = at[-1] == len(at) - 1
        for k in range(n):
            h = (h ^ (word[k : k + len(at)] if whole else word[at + k])) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        new = np.ones(len(at), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate((begin, [len(at)])))
        most = int(count.max())
        if n in tops:
            best = int(at[order[begin[count == most]]].min()) if most > 1 else 0
            top[n] = int((pre[best + n] - pre[best] + n - 1) * most)
        if most == 1:
            at, dup[n] = at[:0], 0
            continue
        gram = np.cumsum(new) - 1
        twice = count[gram] > 1
        by_place = np.argsort(order[twice])
        gram, at = gram[twice][by_place], at[order[twice][by_place]]
        if n in dups:
            chars = i = 0
            seen: set[int] = set()
            for k, g in zip(at.tolist(), gram.tolist()):
                if k < i:
                    continue
                if g in seen:
                    chars += int(pre[k + n] - pre[k])
                    i = k + n
                else:
                    seen.add(g)
            dup[n] = chars
    return [*(top[n] for n in tops), *(dup[n] for n in dups)]


@dataclass(frozen=True, kw_only=True)
class GopherRepetition(Filter):
    dup_line_frac: float | None = 0.35
    dup_para_frac: float | None = 0.35
    dup_line_char_frac: float | None = 0.2
    dup_para_char_frac: float | None = 0.2
    top_n_grams: Sequence[tuple[int, float]] = ((2, 0.25), (3, 0.23), (4, 0.21))
    dup_n_grams: Sequence[tuple[int, float]] = ((5, 0.20), (6, 0.19), (7, 0.18), (8, 0.17), (9, 0.16), (10, 0.15))
    name = "gopher_repetition"

    def prepare(self, df: DataFrame) -> DataFrame:
        t = F.col(self.text)
        tops, dups = [n for n, _ in self.top_n_grams], [n for n, _ in self.dup_n_grams]

        @pandas_udf("array<long>")
        def grams(words: pd.Series, sizes: pd.Series) -> pd.Series:
            return pd.Series([None if w is None else gram_chars(w, n, tops, dups) for w, n in zip(words, sizes)])

        hashed, sizes = F.transform("__tok", lambda x: F.xxhash64(x)), F.transform("__tok", lambda x: F.length(x))
        out = df.withColumn("__tok", self.tokens(t)).withColumn("__grams", grams(hashed, sizes))
        return out.withColumn("__paras", F.split(T.strip(t), "\n{2,}", -1)).withColumn("__lines", F.split(t, "\n+", -1))

    def stats(self) -> Column:
        n = F.length(self.text)
        para, para_chars = T.repeats(F.col("__paras"))
        line, line_chars = T.repeats(F.col("__lines"))
        k = len(self.top_n_grams)

        def fracs(at: int, ns: Sequence[tuple[int, float]]) -> Column:
            if not ns:
                return F.create_map().cast("map<int,double>")
            return F.create_map(*(x for i, (g, _) in enumerate(ns) for x in (F.lit(g), F.coalesce(T.ratio(F.get("__grams", F.lit(at + i)), n), F.lit(0.0)))))

        return F.struct(
            T.ratio(para, F.size("__paras")).alias("dup_para_frac"), T.ratio(para_chars, n).alias("dup_para_char_frac"),
            T.ratio(line, F.size("__lines")).alias("dup_line_frac"), T.ratio(line_chars, n).alias("dup_line_char_frac"),
            fracs(0, self.top_n_grams).alias("top_n_grams"), fracs(k, self.dup_n_grams).alias("dup_n_grams"),
        )

    def rules(self, s: Column) -> list[tuple[Column | None, str]]:
        return [
            *((over(s[k], getattr(self, k)), k) for k in ("dup_para_frac", "dup_para_char_frac", "dup_line_frac", "dup_line_char_frac")),
            *((s["top_n_grams"][n] > x, f"top_{n}_gram") for n, x in self.top_n_grams),
            *((s["dup_n_grams"][n] > x, f"duplicated_{n}_n_grams") for n, x in self.dup_n_grams),
        ]


@dataclass(frozen=True, kw_only=True)
class NordicPileQuality(Filter):
    max_digit_fraction: float | None = 0.2
    min_n_char: int | None = 50
    min_mean_med_char: float | None = 9
    min_mean_med_word: float | None = 2.1
    name = "nordicpile"

    def prepare(self, df: DataFrame) -> DataFrame:
        # white space within lines goes before the text is divided, and words shrink to one character each
        t = F.col("__text")
        # few texts have other white space than blanks and newlines; in the rest a line is visible if anything is left of it
        plain = ~t.rlike(ODD_SPACE)
        filled = lambda c: F.filter(T.lengths(F.split(F.replace(c, F.lit(" "), F.lit("")), "\n", -1)), lambda n: n > 0)
        bare = F.filter(T.lengths(T.split_lines(F.regexp_replace(t, f"[{T.WS_INLINE}]+", ""))), lambda n: n > 0)
        out = df.withColumn("__text", T.strip(F.col(self.text))).withColumn("__chars", F.when(plain, filled(t)).otherwise(bare))
        if self.tokenizer == "unicode":
            shrunk = F.regexp_replace(t, r"[\p{L}\p{N}_]+", "a")
            short = F.filter(T.split_lines(shrunk), lambda x: x.rlike(T.VISIBLE))
            return out.withColumn("__words", F.when(plain, filled(shrunk)).otherwise(F.transform(short, lambda x: F.length(F.regexp_replace(x, r"\s+", "")))))
        return out.withColumn("__words", F.transform(F.filter(T.split_lines(t), lambda x: x.rlike(T.VISIBLE)), lambda x: F.size(self.tokens(x))))

    def stats(self) -> Column:
        t = F.col("__text")
        both = lambda a: (T.mean(F.col(a)) + T.median(F.col(a))) / 2
        return F.struct(
            F.length(t).alias("n_text"), T.ratio(F.length(t) - F.length(F.regexp_replace(t, r"\p{Nd}+", "")), F.length(t)).alias("digit_char_ratio"),
            T.total(F.col("__chars")).cast("int").alias("n_char"), both("__chars").alias("mean_med_char"), both("__words").alias("mean_med_word"),
        )

    def rules(self, s: Column) -> list[tuple[Column | None, str]]:
        return [
            (s["n_text"] == 0, "empty_text"), (over(s["digit_char_ratio"], self.max_digit_fraction), "nordicpile_digit_fraction"), (under(s["n_char"], self.min_n_char), "nordicpile_short_doc"),
            (under(s["mean_med_char"], self.min_mean_med_char), "nordicpile_mean_med_char"), (under(s["mean_med_word"], self.min_mean_med_word), "nordicpile_mean_med_word"),
        ]

    def annotate(self, df: DataFrame) -> DataFrame:
        """An empty text is dropped even where nothing else is."""
        out = Filter.annotate(self, df)
        return out if self.do_filter else out.withColumn(self.reason, F.when(F.col(self.name)["n_text"] == 0, "empty_text"))


@dataclass(frozen=True, kw_only=True)
class C4Quality(Filter):
    """Drops lines, then documents with too few sentences left; apply() also replaces the text by the kept lines."""

    split_paragraph: bool = True
    remove_citations: bool = True
    filter_no_terminal_punct: bool = True
    min_num_sentences: int = 5
    min_words_per_line: int = 3
    max_word_length: int = 1000
    filter_lorem_ipsum: bool = True
    filter_javascript: bool = True
    filter_curly_bracket: bool = True
    filter_policy: bool = True
    name = "c4_quality"

    def status(self, line: Column) -> Column:
        """Why a line goes, or kept."""
        low = F.lower(line)
        rules: list[tuple[Column, str]] = []
        if self.max_word_length != -1:
            rules.append(((F.length(line) > self.max_word_length) & line.rlike(f"[^{T.WS}]{{{self.max_word_length + 1}}}"), "too_long_word"))
        if self.filter_no_terminal_punct:
            rules.append((~line.rlike("[.?!\"']$") | line.endswith("..."), "no_terminal_punc"))
        if self.min_words_per_line > 0:
            rules.append((~line.rlike(f"^[{T.WS}]*(?:[^{T.WS}]++[{T.WS}]*){{{self.min_words_per_line}}}"), "too_few_words"))
        if self.filter_javascript:
            rules.append((low.contains("javascript"), "javascript"))
        if self.filter_policy:
            rules.append((low.rlike("|".join(POLICY)), "policy"))
        return F.coalesce(*(F.when(c, why) for c, why in rules), F.lit("kept"))

    def units(self) -> Column:
        t = F.col(self.text)
        if self.split_paragraph:
            return F.transform(T.split_lines(t), T.strip)
        cut = F.regexp_replace(t, r"([.!?]+[\"')\]]*)\s+([\p{Lu}\p{N}])", "$1\u0001$2")
        return F.filter(F.transform(F.split(cut, "\u0001", -1), T.strip), lambda x: F.length(x) > 0)

    def prepare(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__units", F.transform(self.units(), lambda x: F.struct(x.alias("line"), self.status(x).alias("status"))))
        out = out.withColumn("__raw", F.transform(F.filter("__units", lambda x: x["status"] == "kept"), lambda x: x["line"]))
        whole = F.transform("__raw", lambda x: F.coalesce(F.when(F.lower(x).contains("lorem ipsum"), "lorem_ipsum") if self.filter_lorem_ipsum else F.lit(None), F.when(x.contains("{"), "curly_bracket") if self.filter_curly_bracket else F.lit(None)).cast("string"))
        out = out.withColumn("__whole", F.get(F.filter(whole, lambda x: x.isNotNull()), F.lit(0)))
        return out.withColumn("__kept", F.transform("__raw", lambda x: F.regexp_replace(x, CITATION, "")) if self.remove_citations else F.col("__raw"))

    def stats(self) -> Column:
        count = F.transform("__kept", T.n_sentences) if self.split_paragraph else F.transform("__kept", lambda _: F.lit(1))
        return F.struct(F.when(F.col("__whole").isNull(), T.total(count).cast("int")).alias("num_sentences"), F.col("__whole").alias("rejected"), T.strip(F.array_join("__kept", "\n" if self.split_paragraph else " ")).alias("text"))

    def rules(self, s: Column) -> list[tuple[Column | None, str]]:
        return [(s["rejected"] == "lorem_ipsum", "lorem_ipsum"), (s["rejected"] == "curly_bracket", "curly_bracket"), (s["num_sentences"] < self.min_num_sentences, "too_few_sentences")]

    def annotate(self, df: DataFrame) -> DataFrame:
        """Lorem ipsum and curly brackets reject a document even where nothing else does."""
        out = Filter.annotate(self, df)
        return out if self.do_filter else out.withColumn(self.reason, F.col(self.name)["rejected"])

    def apply(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        out = self.annotate(df)
        kept = out.where(F.col(self.reason).isNull())
        if self.do_filter:
            kept = kept.withColumn(self.text, F.col(self.name)["text"])
        return kept.select(*df.columns), out.where(F.col(self.reason).isNotNull()).select(*df.columns, F.col(self.reason).alias("drop_reason"))

    def line_counts(self, df: DataFrame) -> DataFrame:
        """(status, n): lines by their first failing rule, or kept."""
        each = df.select(F.explode(self.units()).alias("line")).select(self.status(F.col("line")).alias("status"))
        return each.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


#: Languages that bad-word lists are commonly published for.
BAD_WORD_LANGUAGES = "ar cs da de en eo es fa fi fil fr fr-CA-u-sd-caqc hi hu it ja kab ko nl no pl pt ru sv th tlh tr zh".split()
ALLOWED = {"ja": {"sm", "グロ", "女の子"}, "zh": {"性"}}


@dataclass(frozen=True, kw_only=True)
class C4BadWords(Filter):
    """Drops documents with a listed word of their language, but for a share of them, chosen by a hash of the id.

    words: lists by language, supplied by the user (sources.bad_words reads a
    folder of them). match_mode "word" asks for word borders where the language
    writes them; "substring" doesn't.
    """

    words: Mapping[str, Sequence[str]] = field(default_factory=dict)
    keep_fraction: float = 0.0
    fail_on_missing_language: bool = True
    seed: int = 0
    default_language: str = "en"
    match_mode: str = "word"
    id_col: str = "doc_id"
    name = "c4_badwords"

    def pattern(self, lang: str) -> str | None:
        ws = sorted({w.strip().lower() for w in self.words[lang]} - {""} - {x.lower() for x in ALLOWED.get(lang, set())})
        if not ws:
            return None
        body = "|".join(self.literal(w) for w in ws)
        return f"({body})" if self.match_mode == "substring" or lang in ("ja", "th", "zh") else rf"([^\p{{L}}\p{{N}}_]|^)({body})([^\p{{L}}\p{{N}}_]|$)"

    @staticmethod
    def literal(w: str) -> str:
        return "".join(f"\\{c}" if c in r"\.[]{}()*+?^$|" else c for c in w)

    def stats(self) -> Column:
        lang = F.coalesce(F.col(self.lang), F.lit(self.default_language))
        known = {k: p for k in self.words if (p := self.pattern(k))}
        low = F.lower(F.col(self.text))
        missing = F.raise_error(F.concat(F.lit("no bad-word list for language "), lang)).cast("boolean") if self.fail_on_missing_language else F.lit(False)
        empty = {k: F.lit(False) for k in self.words if k not in known}
        hit = T.by_language(lang, {k: low.rlike(p) for k, p in known.items()} | empty, missing)
        draw = F.pmod(F.xxhash64(F.col(self.id_col).cast("string"), F.lit(self.seed)), F.lit(1_000_000)) / 1e6
        return F.struct(hit.alias("has_bad_word"), (draw < self.keep_fraction).alias("spared"))

    def rules(self, s: Column) -> list[tuple[Column | None, str]]:
        return [(s["has_bad_word"] & ~s["spared"], "document_removed_with_badwords")]
