"""A query for each operator over the driver's tables, and the same in DuckDB's SQL where SQL can express it.

Ratios are rounded to six digits on both sides.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks, evaluation, filters, formatters, ner, perplexity, pii, toxic
from ..operators.step import Filter
from ..sources import tables
from ..streaming import run as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BAD = {"en": ["idiot", "moron", "scum"], "fr": ["vequ", "la"], "de": ["trash", "und"], "es": ["stupid"]}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return tables.spread(tables.parquet(spark, f"{sf}/{name}.parquet"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def lit(s: str) -> str:
    """A pattern or text as a SQL literal; RE2 writes code points with braces."""
    return "'" + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", s).replace("'", "''") + "'"


def flat(f: Filter, df: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    a = f.held(df, fields)
    kinds = dict(a.select(f"{f.name}.*").dtypes)
    return a.select(key, *((r6(F.col(f.name)[c]) if kinds[c] == "double" else F.col(f.name)[c]).alias(c) for c in fields))


def reasons(f: Filter, df: DataFrame) -> DataFrame:
    return f.annotate(df).select("doc_id", F.col(f.reason).alias("reason"))


# --- SQL building blocks ------------------------------------------------------------------------------------------

_TOK = f"regexp_extract_all(text, {lit(T.TOKEN)})"
_BREAK = f"regexp_split_to_array(text, {lit(T.LINE_BREAK)})"
_LINES = f"CASE WHEN list_last({_BREAK}) = '' THEN {_BREAK}[:-2] ELSE {_BREAK} END"
_NL = "chr(10)"
_STRIP = lambda c: f"regexp_replace({c}, {lit(f'^[{T.WS}]+|[{T.WS}]+$')}, '', 'g')"
_COUNT = lambda c, s: f"((length({c}) - length(replace({c}, {s}, ''))) // length({s}))"
_R = lambda a, b: f"round(CASE WHEN {b} = 0 THEN NULL ELSE ({a})::DOUBLE / {b} END, 6)"
_LEN = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: length(x))), 0)"
_MED = lambda a: f"list_aggregate({a}, 'median')"
_STOP_SQL = "<stop words of lang>"  # sql() puts them in


def sql() -> dict[str, str]:
    """SQL by query. Stop word lists are only read here, as workers that import this module may have no jar to read them from."""
    listed = lambda k: "[" + ", ".join(lit(w) for w in T.stop_words(k)) + "]"
    stop = "CASE lang " + " ".join(f"WHEN '{k}' THEN {listed(k)}" for k in T.LANGUAGES) + f" ELSE {listed(T.FALLBACK)} END"
    return {name: text.replace(_STOP_SQL, stop) for name, text in SQL.items()}


def _case(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{w}'" for c, w in rules) + " ELSE NULL END"


# --- Gopher quality -----------------------------------------------------------------------------------------------

_GQ = f"""WITH t AS (SELECT doc_id, text, {_TOK} AS tok, {_LINES} AS lines, {_STOP_SQL} AS stop FROM documents),
 u AS (SELECT *, list_filter(tok, lambda x: NOT regexp_full_match(x, {lit(T.PUNCTUATION + "+")})) AS w, len(tok) AS n FROM t),
 s AS (SELECT doc_id, len(w) AS n_non_symbol_words, {_R(_LEN('w'), 'len(w)')} AS avg_word_length, {_R(_COUNT('text', "'#'"), 'n')} AS hash_ratio,
  {_R(_COUNT('text', "'...'") + ' + ' + _COUNT('text', "'…'"), 'n')} AS ellipsis_ratio,
  {_R(f"len(list_filter(lines, lambda x: regexp_matches(x, {lit(f'^[{T.WS}]*[•-]')})))", 'len(lines)')} AS bullet_lines_ratio,
  {_R(f"len(list_filter(lines, lambda x: regexp_matches(x, {lit(f'([.][.][.]|…)[{T.WS}]*$')})))", 'len(lines)')} AS ellipsis_lines_ratio,
  {_R("len(list_filter(tok, lambda x: regexp_matches(x, '\\p{L}')))", 'n')} AS alpha_words_ratio,
  len(list_filter(tok, lambda x: list_contains(stop, x))) AS stop_words_count FROM u)"""
_GQ_FIELDS = "n_non_symbol_words avg_word_length hash_ratio ellipsis_ratio bullet_lines_ratio ellipsis_lines_ratio alpha_words_ratio stop_words_count".split()
_GQ_RULES = [
    ("n_non_symbol_words < 50", "gopher_short_doc"), ("n_non_symbol_words > 100000", "gopher_long_doc"), ("avg_word_length < 2", "gopher_below_avg_threshold"), ("avg_word_length > 10", "gopher_above_avg_threshold"),
    ("hash_ratio > 0.1", "gopher_too_many_hashes"), ("ellipsis_ratio > 0.1", "gopher_too_many_ellipsis"), ("bullet_lines_ratio > 0.9", "gopher_too_many_bullets"), ("ellipsis_lines_ratio > 0.3", "gopher_too_many_end_ellipsis"),
    ("alpha_words_ratio < 0.8", "gopher_below_alpha_threshold"), ("stop_words_count < 2", "gopher_enough_stop_words"),
]


@query(f"{_GQ} SELECT doc_id, {', '.join(_GQ_FIELDS)} FROM s")
def gopher_quality_stats(spark: SparkSession, sf: str) -> DataFrame:
    return flat(filters.GopherQuality(), docs(spark, sf), _GQ_FIELDS)


@query(f"{_GQ} SELECT doc_id, {_case(_GQ_RULES)} AS reason FROM s")
def gopher_quality_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reasons(filters.GopherQuality(), docs(spark, sf))


@query(f"{_GQ} SELECT lang, coalesce({_case(_GQ_RULES)}, 'kept') AS reason, count(*) AS n FROM s JOIN documents USING (doc_id) GROUP BY ALL")
def gopher_quality_kept(spark: SparkSession, sf: str) -> DataFrame:
    f = filters.GopherQuality()
    return f.annotate(docs(spark, sf)).groupBy("lang", F.coalesce(f.reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- Gopher repetition --------------------------------------------------------------------------------------------


def _dup(split: str, a: str, b: str) -> str:
    return f"""WITH t AS (SELECT doc_id, length(text) AS n, {split} AS x FROM documents)
        SELECT doc_id, {_R('len(x) - len(list_distinct(x))', 'len(x)')} AS {a}, {_R(f"{_LEN('x')} - {_LEN('list_distinct(x)')}", 'n')} AS {b} FROM t"""


@query(_dup("regexp_split_to_array(text, '\\n+')", "dup_line_frac", "dup_line_char_frac"))
def gopher_rep_line_dups(spark: SparkSession, sf: str) -> DataFrame:
    return flat(filters.GopherRepetition(), docs(spark, sf), ["dup_line_frac", "dup_line_char_frac"])


@query(_dup(f"regexp_split_to_array({_STRIP('text')}, '\\n{{2,}}')", "dup_para_frac", "dup_para_char_frac"))
def gopher_rep_para_dups(spark: SparkSession, sf: str) -> DataFrame:
    return flat(filters.GopherRepetition(), docs(spark, sf), ["dup_para_frac", "dup_para_char_frac"])


@query(
    f"""WITH t AS (SELECT doc_id, length(text) AS size, {_TOK} AS w FROM documents), k AS (SELECT unnest([2, 3, 4]) AS n),
    g AS (SELECT doc_id, size, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, size, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, k)),
    c AS (SELECT doc_id, size, n, gram, count(*) AS c, min(i) AS pos FROM g GROUP BY ALL),
    b AS (SELECT doc_id, n, arg_min(length(gram) * c, (-c, pos)) AS chars FROM c GROUP BY ALL)
    SELECT d.doc_id, k.n, round(CASE WHEN size = 0 THEN 0 ELSE coalesce(chars, 0)::DOUBLE / size END, 6) AS frac FROM t d CROSS JOIN k LEFT JOIN b ON b.doc_id = d.doc_id AND b.n = k.n"""
)
def gopher_rep_top_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    a = filters.GopherRepetition().held(docs(spark, sf), ["top_n_grams"])
    return a.select("doc_id", F.explode(F.col("gopher_repetition")["top_n_grams"]).alias("n", "f")).select("doc_id", "n", r6(F.col("f")).alias("frac"))


#: Positions whose n-gram recurs, in order; a scan from the left skips over each one that it has seen before.
_DUP_GRAMS = f"""dt AS (SELECT doc_id, length(text) AS size, {_TOK} AS w FROM documents), dk AS (SELECT unnest([5, 6, 7, 8, 9, 10]) AS n),
    dg AS (SELECT doc_id, n, i, hash(w[i:i + n - 1]) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dt, dk)),
    dr AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n, g) AS c FROM dg),
    da AS (SELECT doc_id, n, list({{'i': i, 'g': g, 'size': length(array_to_string(w[i:i + n - 1], ''))}} ORDER BY i) AS x FROM dr JOIN dt USING (doc_id) WHERE c > 1 GROUP BY ALL),
    db AS (SELECT doc_id, n, list_reduce(x, lambda a, p: CASE WHEN p.i < a.next THEN a WHEN list_contains(a.seen, p.g) THEN {{'next': p.i + n, 'chars': a.chars + p.size, 'seen': a.seen}}
      ELSE {{'next': a.next, 'chars': a.chars, 'seen': list_append(a.seen, p.g)}} END, {{'next': 0::BIGINT, 'chars': 0::BIGINT, 'seen': []::UBIGINT[]}}).chars AS chars FROM da),
    df AS (SELECT d.doc_id, dk.n, CASE WHEN size = 0 THEN 0 ELSE coalesce(chars, 0)::DOUBLE / size END AS frac FROM dt d CROSS JOIN dk LEFT JOIN db ON db.doc_id = d.doc_id AND db.n = dk.n)"""


@query(f"WITH {_DUP_GRAMS} SELECT doc_id, n, round(frac, 6) AS frac FROM df")
def gopher_rep_dup_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    a = filters.GopherRepetition().held(docs(spark, sf), ["dup_n_grams"])
    return a.select("doc_id", F.explode(F.col("gopher_repetition")["dup_n_grams"]).alias("n", "f")).select("doc_id", "n", r6(F.col("f")).alias("frac"))


_REP_RULES = [
    ("pf > 0.35", "dup_para_frac"), ("pc > 0.2", "dup_para_char_frac"), ("lf > 0.35", "dup_line_frac"), ("lc > 0.2", "dup_line_char_frac"), *((f"t{n} > {x}", f"top_{n}_gram") for n, x in ((2, 0.25), (3, 0.23), (4, 0.21))),
    *((f"d{n} > {x}", f"duplicated_{n}_n_grams") for n, x in ((5, 0.20), (6, 0.19), (7, 0.18), (8, 0.17), (9, 0.16), (10, 0.15))),
]


@query(
    f"""WITH {_DUP_GRAMS}, line AS ({SQL["gopher_rep_line_dups"]}), para AS ({SQL["gopher_rep_para_dups"]}), top AS ({SQL["gopher_rep_top_ngrams"]}),
    s AS (SELECT documents.doc_id, any_value(dup_para_frac) AS pf, any_value(dup_para_char_frac) AS pc, any_value(dup_line_frac) AS lf, any_value(dup_line_char_frac) AS lc,
      {", ".join(f"max(top.frac) FILTER (top.n = {n}) AS t{n}" for n in (2, 3, 4))}, {", ".join(f"max(df.frac) FILTER (df.n = {n}) AS d{n}" for n in range(5, 11))}
      FROM documents LEFT JOIN para USING (doc_id) LEFT JOIN line USING (doc_id) LEFT JOIN top ON top.doc_id = documents.doc_id LEFT JOIN df ON df.doc_id = documents.doc_id GROUP BY ALL)
    SELECT doc_id, {_case(_REP_RULES)} AS reason FROM s"""
)
def gopher_rep_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reasons(filters.GopherRepetition(), docs(spark, sf))


# --- FineWeb, NordicPile, line length -----------------------------------------------------------------------------

_FW = f"""WITH t AS (SELECT doc_id, text, string_split(text, {_NL}) AS lines, len({_TOK}) AS n FROM documents),
 u AS (SELECT *, list_filter(lines, lambda x: length({_STRIP('x')}) > 0) AS f FROM t),
 s AS (SELECT doc_id, {_R("len(list_filter(lines, lambda x: regexp_matches(x, '[.''\"!?]$')))", 'len(lines)')} AS line_punct_ratio, {_R('len(list_filter(lines, lambda x: length(x) <= 30))', 'len(lines)')} AS short_line_ratio,
  {_R(f"{_LEN('f')} - {_LEN('list_distinct(f)')}", f"length(replace(text, {_NL}, ''))")} AS char_dup_ratio, {_R(_COUNT('text', _NL), 'n')} AS list_ratio FROM u)"""
_FW_FIELDS = ["line_punct_ratio", "short_line_ratio", "char_dup_ratio", "list_ratio"]
_FW_RULES = [("line_punct_ratio <= 0.12", "line_punct_ratio"), ("short_line_ratio >= 0.67", "short_line_ratio"), ("char_dup_ratio >= 0.01", "char_dup_ratio"), ("list_ratio > 0.3", "list_ratio")]


@query(f"{_FW} SELECT doc_id, {', '.join(_FW_FIELDS)} FROM s")
def fineweb_stats(spark: SparkSession, sf: str) -> DataFrame:
    return flat(filters.FineWebQuality(), docs(spark, sf), _FW_FIELDS)


@query(f"{_FW} SELECT doc_id, {_case(_FW_RULES)} AS reason FROM s")
def fineweb_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reasons(filters.FineWebQuality(), docs(spark, sf))


_NP = f"""WITH a AS (SELECT doc_id, {_STRIP('text')} AS text FROM documents),
 b AS (SELECT doc_id, text, list_filter({_LINES}, lambda x: length({_STRIP('x')}) > 0) AS f FROM a),
 c AS (SELECT doc_id, text, list_transform(f, lambda x: length(regexp_replace(x, {lit(f'[{T.WS}]+')}, '', 'g'))) AS ch, list_transform(f, lambda x: len(regexp_extract_all(x, {lit(T.TOKEN)}))) AS w FROM b),
 s AS (SELECT doc_id, {_R("length(regexp_replace(text, '[^\\p{Nd}]', '', 'g'))", 'length(text)')} AS digit_char_ratio, length(regexp_replace(text, {lit(f'[{T.WS}]+')}, '', 'g')) AS n_char,
  round((list_avg(ch) + {_MED('ch')}) / 2, 6) AS mean_med_char, round((list_avg(w) + {_MED('w')}) / 2, 6) AS mean_med_word, length(text) AS size FROM c)"""
_NP_FIELDS = ["digit_char_ratio", "n_char", "mean_med_char", "mean_med_word"]
_NP_RULES = [("size = 0", "empty_text"), ("digit_char_ratio > 0.2", "nordicpile_digit_fraction"), ("n_char < 50", "nordicpile_short_doc"), ("mean_med_char < 9", "nordicpile_mean_med_char"), ("mean_med_word < 2.1", "nordicpile_mean_med_word")]


@query(f"{_NP} SELECT doc_id, {', '.join(_NP_FIELDS)} FROM s")
def nordicpile_stats(spark: SparkSession, sf: str) -> DataFrame:
    return flat(filters.NordicPileQuality(), docs(spark, sf), _NP_FIELDS)


@query(f"{_NP} SELECT doc_id, {_case(_NP_RULES)} AS reason FROM s")
def nordicpile_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reasons(filters.NordicPileQuality(), docs(spark, sf))


_LL = f"""WITH t AS (SELECT doc_id, list_transform({_LINES}, lambda x: length(x)) AS n FROM documents),
 s AS (SELECT doc_id, coalesce(list_max(n), 0) AS line_length, coalesce({_MED('n')}, 0)::DOUBLE AS avg_line_length FROM t)"""
_LL_RULES = [("line_length < 10", "min_line_length"), ("line_length > 10000", "max_line_length"), ("avg_line_length < 10", "avg_line_length"), ("avg_line_length > 5000", "avg_line_length")]


@query(f"{_LL} SELECT doc_id, line_length, round(avg_line_length, 6) AS avg_line_length FROM s")
def line_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return flat(filters.LineLength(), docs(spark, sf), ["line_length", "avg_line_length"])


@query(f"{_LL} SELECT doc_id, {_case(_LL_RULES)} AS reason FROM s")
def line_length_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reasons(filters.LineLength(), docs(spark, sf))


# --- C4 -----------------------------------------------------------------------------------------------------------

_WORDS = f"regexp_extract_all(line, {lit(f'[^{T.WS}]+')})"
_C4 = f"""WITH l AS (SELECT doc_id, i, {_STRIP('lines[i]')} AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, {_LINES} AS lines FROM documents))),
 k AS (SELECT *, CASE WHEN len(list_filter({_WORDS}, lambda w: length(w) > 1000)) > 0 THEN 'too_long_word' WHEN NOT regexp_matches(line, '[.?!"'']$') OR line LIKE '%...' THEN 'no_terminal_punc'
   WHEN len({_WORDS}) < 3 THEN 'too_few_words' WHEN contains(lower(line), 'javascript') THEN 'javascript' WHEN regexp_matches(lower(line), '{"|".join(filters.POLICY)}') THEN 'policy' ELSE 'kept' END AS status FROM l)"""
_CITED = f"regexp_replace(line, {lit(filters.CITATION)}, '', 'g')"
_C4_DOC = f"""{_C4}, c AS (SELECT *, {_CITED} AS clean, CASE WHEN contains(lower(line), 'lorem ipsum') THEN 'lorem_ipsum' WHEN contains(line, '{{') THEN 'curly_bracket' END AS whole FROM k WHERE status = 'kept'),
 d AS (SELECT doc_id, arg_min(whole, i) FILTER (whole IS NOT NULL) AS rejected, sum(CASE WHEN length({_STRIP('clean')}) = 0 THEN 0 ELSE len(regexp_extract_all(clean, {lit(T.SENTENCE_END)})) + 1 END)::BIGINT AS n,
   {_STRIP(f"string_agg(clean, {_NL} ORDER BY i)")} AS text FROM c GROUP BY doc_id),
 s AS (SELECT doc_id, rejected, CASE WHEN rejected IS NULL THEN coalesce(n, 0) END AS n, coalesce(d.text, '') AS text FROM documents LEFT JOIN d USING (doc_id))"""


@query(f"{_C4} SELECT status, count(*) AS n FROM k GROUP BY status")
def c4_line_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return filters.C4Quality().line_counts(docs(spark, sf))


@query(f"{_C4_DOC} SELECT doc_id, n AS num_sentences, CASE WHEN rejected IS NOT NULL THEN rejected WHEN n < 5 THEN 'too_few_sentences' END AS reason FROM s")
def c4_quality_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return filters.C4Quality().annotate(docs(spark, sf)).select("doc_id", F.col("c4_quality.num_sentences").alias("num_sentences"), F.col("c4_quality_reason").alias("reason"))


@query(f"{_C4_DOC} SELECT doc_id, text FROM s WHERE rejected IS NULL AND n >= 5")
def c4_quality_kept(spark: SparkSession, sf: str) -> DataFrame:
    return filters.C4Quality().apply(docs(spark, sf))[0].select("doc_id", "text")


@query(f"SELECT doc_id FROM documents WHERE NOT CASE lang {' '.join(f'''WHEN '{k}' THEN regexp_matches(lower(text), {lit(filters.C4BadWords(words=BAD).pattern(k) or '')})''' for k in BAD)} ELSE false END")
def c4_badwords_kept(spark: SparkSession, sf: str) -> DataFrame:
    return filters.C4BadWords(words=BAD, fail_on_missing_language=False).apply(docs(spark, sf))[0].select("doc_id")


# --- formatters ---------------------------------------------------------------------------------------------------


def _punct_sql(c: str) -> str:
    for k, v in formatters.PUNCTUATION.items():
        c = f"replace({c}, {lit(k)}, {lit(v)})"
    return c


@query(f"SELECT doc_id, {_punct_sql('text')} AS text FROM documents")
def fmt_punctuation(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", formatters.punctuation(F.col("text")).alias("text"))


@query(f"SELECT doc_id, translate({_STRIP('text')}, {lit(formatters.SPACES)}, '{' ' * len(formatters.SPACES)}') AS text FROM documents")
def fmt_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", formatters.whitespace(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '([A-Za-z])[%$#&*]{3}', '\\1', 'g'), '\\bthe\\b', 'THE', 'gi') AS text FROM documents")
def fmt_regex(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", formatters.regex(F.col("text"), ["([A-Za-z])[%$#&*]{3}", "\\bthe\\b"], ["\\1", "THE"], [0, 2]).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def fmt_unicode_fix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents are clean but for their normal form; tests have the mojibake."""
    return docs(spark, sf).select("doc_id", formatters.unicode_fix(F.col("text")).alias("text"))


# --- personal data ------------------------------------------------------------------------------------------------

#: Types that RE2 can match, without validator or keywords; for e-mail and file paths borders and spaces differ.
_PLAIN = [s for s in pii.SPECS.values() if not s.validator and not s.keywords and "(?<" not in s.pattern and "(?!" not in s.pattern and s.name not in ("EmailAddress", "FilePath")]
#: Text of several tables, so that more types match.
_TEXTS = (
    "SELECT doc_id AS id, text FROM documents UNION ALL SELECT 100000000 + page_id, url || ' ' || html FROM pages UNION ALL SELECT 200000000 + c_custkey, "
    "'card ' || (4000000000000 + c_custkey * 7919)::VARCHAR || ' exp 0' || (1 + c_custkey % 9)::VARCHAR || '/27 id ' || (100000000 + c_custkey * 37)::VARCHAR || ' ip 10.0.' || (c_custkey % 256)::VARCHAR || '.7 AB' || (100000 + c_custkey)::VARCHAR || ' mac 00:1b:44:11:3a:' || (10 + c_custkey % 90)::VARCHAR || ' tel +31 6' || (10000000 + c_custkey)::VARCHAR || ' plate AB-12-' || (10 + c_custkey % 90)::VARCHAR || ' doc NX4BC5D' || (10 + c_custkey % 90)::VARCHAR || ' be 1-ABC-' || (100 + c_custkey % 900)::VARCHAR || ' bel 04' || (10000000 + c_custkey)::VARCHAR || ' itin 9' || (10 + c_custkey % 90)::VARCHAR || '-70-' || (1000 + c_custkey % 9000)::VARCHAR || ' vat DE' || (100000000 + c_custkey)::VARCHAR FROM customer"
)


#: Numbers with the words that they need, two of three times within the reach of these. Spark and DuckDB read the same expressions.
_N = "lpad(CAST(CAST(s_suppkey AS BIGINT) * 7919 % 10000000000 AS STRING), 10, '1')"
_KEYED = [
    f"concat('{word}', repeat('filler ', CAST(s_suppkey % 3 * 30 AS INT)), {number}, ' end.')" for word, number in (
        ("mijn v-nummer ", _N), ("rijbewijs ", _N), ("australian bank ", f"substr({_N}, 2, 9)"), ("australia ", f"concat('N', substr({_N}, 4, 7))"),
        ("tax file number ", f"concat(substr({_N}, 2, 3), ' ', substr({_N}, 5, 3), ' ', substr({_N}, 8, 3))"), ("tax reference ", _N), ("ssn ", f"concat('1', substr({_N}, 9, 2), '-', substr({_N}, 7, 2), '-', substr({_N}, 7, 4))"),
        ("savings account ", _N), ("passport ", f"substr({_N}, 2, 9)"), ("card 4", f"concat(substr({_N}, 6, 5), {_N})"), ("bsn ", f"substr({_N}, 2, 9)"), ("to ", "CASE s_suppkey % 3 WHEN 0 THEN 'NL91 ABNA 0417 1643 00' WHEN 1 THEN 'DE89370400440532013000' ELSE 'BE68539007547035' END"),
        ("cvv ", f"substr({_N}, 8, 3)"), ("australian driver ", f"substr({_N}, 3, 8)"), ("insurance ", f"concat(CASE s_suppkey % 2 WHEN 0 THEN 'AB ' ELSE 'GB ' END, substr({_N}, 5, 6), ' C')"), ("mail ", "concat('user', CAST(s_suppkey AS STRING), '@example.com')"),
        ("in ", f"concat('C:', chr(92), 'dir', chr(92), 'f', {_N}, '.txt')"), ("bel ", f"concat('06-', substr({_N}, 3, 8))"), ("canadian bank ", f"substr({_N}, 4, 7)"),
    )
]
_TEXTS += f" UNION ALL SELECT 300000000 + (j - 1) * 10000000 + s_suppkey, texts[j] FROM (SELECT s_suppkey, texts, unnest(range(1, len(texts) + 1)) AS j FROM (SELECT s_suppkey, [{', '.join(_KEYED)}] AS texts FROM supplier))"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    c = docs(spark, sf, "customer")
    k = F.col("c_custkey")
    made = F.concat(F.lit("card "), (4000000000000 + k * 7919).cast("string"), F.lit(" exp 0"), (1 + k % 9).cast("string"), F.lit("/27 id "), (100000000 + k * 37).cast("string"), F.lit(" ip 10.0."), (k % 256).cast("string"), F.lit(".7 AB"), (100000 + k).cast("string"), F.lit(" mac 00:1b:44:11:3a:"), (10 + k % 90).cast("string"), F.lit(" tel +31 6"), (10000000 + k).cast("string"), F.lit(" plate AB-12-"), (10 + k % 90).cast("string"), F.lit(" doc NX4BC5D"), (10 + k % 90).cast("string"), F.lit(" be 1-ABC-"), (100 + k % 900).cast("string"), F.lit(" bel 04"), (10000000 + k).cast("string"), F.lit(" itin 9"), (10 + k % 90).cast("string"), F.lit("-70-"), (1000 + k % 9000).cast("string"), F.lit(" vat DE"), (100000000 + k).cast("string"))
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    p = docs(spark, sf, "pages").select((100000000 + F.col("page_id")).alias("id"), F.concat_ws(" ", "url", "html").alias("text"))
    more = docs(spark, sf, "supplier").select("s_suppkey", F.posexplode(F.expr(f"array({', '.join(_KEYED)})")).alias("j", "text"))
    return d.unionByName(p).unionByName(c.select((200000000 + k).alias("id"), made.alias("text"))).unionByName(more.select((300000000 + F.col("j") * 10000000 + F.col("s_suppkey")).cast("long").alias("id"), "text"))


_CHARS = lambda t: f"string_split({t}, '')"
#: The validators, of a match h.
_VALID = {
    "CreditCardNumber": "(SELECT list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END)) % 10 = 0 FROM (SELECT string_split(regexp_replace(h, '[ -]', '', 'g'), '') AS d))",
    "DutchIdentityNumberBSN": "(list_sum(list_transform(range(1, 9), lambda i: substr(h, i, 1)::INT * (10 - i))) - substr(h, 9, 1)::INT) % 11 = 0",
    "IBAN": f"(SELECT regexp_matches(t, {lit(pii._IBAN)}) AND list_reduce(string_split(substr(t, 5) || substr(t, 1, 4), ''), lambda s, c: (s * CASE WHEN c < 'A' THEN 10 ELSE 100 END + CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END) % 97, 0::BIGINT) = 1 FROM (SELECT upper(regexp_replace(h, '\\s', '', 'g')) AS t))",
}
#: RE2 has no look-around: of these, what may stand around a match is judged by the characters there.
_AROUND = {
    "CreditCardCVVCode": (r"\b[0-9]{3,4}\b", "NOT regexp_matches(before, '[-:]$') AND NOT regexp_matches(after, '^[-:]')"),
    "AustralianDriversLicenseNumber": (r"\b(?:[A-Za-z0-9]{2}[0-9]{2}[A-Za-z0-9]{5}|[A-Za-z]{0,2}[0-9]{4,9})\b", "NOT regexp_matches(before, '[-:]$') AND NOT regexp_matches(after, '^[-:]')"),
    "UKNationalInsuranceNumber": (r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b", "substr(h, 1, 2) NOT IN ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ')"),
    "IBAN": (r"[A-Z]{2}\s*[0-9]\s*[0-9]\s*(?:[A-Z]\s*){0,4}(?:[0-9]\s*){4,28}[0-9]", "NOT regexp_matches(after, '^[0-9]')"),
}


def _mask_sql(spec: pii.Spec) -> str | None:
    """Matches are judged one by one: by the words around, the characters beside, the validator."""
    pattern, beside = _AROUND.get(spec.name, (spec.pattern, "true"))
    if "(?<" in pattern or "(?!" in pattern:
        return None
    near = " OR ".join(f"contains(around, {lit(k)})" for k in spec.keywords) or "true"
    r = spec.keyword_range
    return f"""WITH t AS (SELECT id, text, regexp_extract_all(text, {lit(pattern)}) AS hs, regexp_split_to_array(text, {lit(pattern)}) AS gs FROM ({_TEXTS}) WHERE regexp_matches(text, {lit(pattern)})),
        u AS (SELECT id, text, hs, gs, unnest(range(1, len(gs) + 1)) AS i FROM t),
        v AS (SELECT id, i, gs[i] AS before, hs[i] AS h, coalesce(gs[i + 1], '') AS after, text, length(array_to_string(gs[1:i], '')) + length(array_to_string(hs[1:i - 1], '')) AS pos FROM u),
        w AS (SELECT *, lower(substr(text, greatest(pos - {r}, 0) + 1, least(pos, {r}) + length(h) + {r})) AS around FROM v),
        x AS (SELECT id, i, before, h, coalesce(h IS NOT NULL AND ({near}) AND ({beside}) AND ({_VALID.get(spec.name, "true")}), false) AS ok FROM w)
        SELECT id, count(*) FILTER (ok) AS n, md5(string_agg(before || CASE WHEN ok THEN {lit(str(spec.mask))} ELSE coalesce(h, '') END, '' ORDER BY i)) AS masked FROM x GROUP BY id HAVING n > 0"""


def _mask_query(spec: pii.Spec) -> None:
    name = "pii_mask_" + re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", spec.name).lower()

    def run(spark: SparkSession, sf: str) -> DataFrame:
        # the generator keeps the masks from being computed again for each use, and before the texts are spread
        m = texts(spark, sf).select("id", F.explode(F.array(pii.mask_text(F.col("text"), spec))).alias("m"))
        return m.where("m.count > 0").select("id", F.col("m.count").cast("long").alias("n"), F.md5("m.text").alias("masked"))

    run.__name__ = name
    p = lit(spec.pattern)
    plain = f"SELECT id, len(regexp_extract_all(text, {p})) AS n, md5(regexp_replace(text, {p}, {lit(str(spec.mask))}, 'g')) AS masked FROM ({_TEXTS}) WHERE regexp_matches(text, {p})"
    query(plain if spec in _PLAIN else _mask_sql(spec))(run)


for _spec in pii.SPECS.values():
    _mask_query(_spec)


@query(" UNION ALL ".join(f"SELECT '{s.name}' AS type, coalesce(sum(len(regexp_extract_all(text, {lit(s.pattern)}))), 0)::BIGINT AS n FROM t" for s in _PLAIN).join((f"WITH t AS ({_TEXTS}) ", "")))
def pii_counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """The types that SQL can check; pii_counts_all_types has all."""
    return _type_counts(spark, sf, _PLAIN)


@query()
def pii_counts_all_types(spark: SparkSession, sf: str) -> DataFrame:
    """All types in one pass over the texts."""
    return _type_counts(spark, sf, list(pii.SPECS.values()))


def _type_counts(spark: SparkSession, sf: str, specs: list[pii.Spec]) -> DataFrame:
    t = texts(spark, sf).select("text", F.lower("text").alias("low"), F.col("text").rlike(pii.DIGIT).alias("digit"))
    t = t.select(*(pii.count_matches(F.col("text"), s, F.col("low"), F.col("digit")).alias(s.name) for s in specs))
    sums = t.agg(*(F.coalesce(F.sum(F.col(s.name)), F.lit(0)).cast("long").alias(s.name) for s in specs))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(s.name).alias("type"), F.col(s.name).alias("n")) for s in specs))).alias("x")).select("x.*")


def _chain_query(chain: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = pii.run_chain(texts(spark, sf), pii.CHAINS[chain])
        return out.where("pii is not null").select("id", "text", F.aggregate("pii", F.lit(0), lambda s, x: s + F.aggregate(x["entity_type_counts"], F.lit(0), lambda a, b: a + b)).alias("n"))

    run.__name__ = f"pii_chain_{chain}"
    query()(run)


for _chain in ("computer", "banking", "common", "dutch", "belgian", "australian", "canadian", "uk", "us"):
    _chain_query(_chain)


#: What the @ steps of chains are run by here: the stand-in recognizer.
MODELS = {"@person_organisation": ner.step(labels=("person", "organisation")), "@person": ner.step(labels=("person",)), "@organisation": ner.step(labels=("organisation",))}


@query()
def pii_by_language(spark: SparkSession, sf: str) -> DataFrame:
    steps = {"nl": pii.CHAINS["everything_nl"], "en": pii.CHAINS["everything_en"]}
    return pii.counters(pii.by_chain(docs(spark, sf), steps))


def _everything(chain: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = pii.run_chain(docs(spark, sf), pii.CHAINS[chain], models=MODELS)
        return out.where("pii is not null").select("doc_id", "text", F.aggregate("pii", F.lit(0), lambda s, x: s + F.aggregate(x["entity_type_counts"], F.lit(0), lambda a, b: a + b)).alias("n"))

    run.__name__ = f"pii_{chain}"
    query()(run)


_everything("everything_en")
_everything("everything_nl")


_DIGITS = "SELECT o_orderkey AS k, lpad((o_orderkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS d FROM orders"


@query(
    f"SELECT k, list_sum(list_transform(range(1, 10), lambda i: CASE WHEN (9 - i) % 2 = 0 THEN substr(d, i, 1)::INT ELSE CASE WHEN substr(d, i, 1)::INT * 2 > 9 THEN substr(d, i, 1)::INT * 2 - 9 ELSE substr(d, i, 1)::INT * 2 END END)) % 10 = 0 AS luhn, "
    f"(list_sum(list_transform(range(1, 9), lambda i: substr(d, i, 1)::INT * (10 - i))) - substr(d, 9, 1)::INT) % 11 = 0 AS bsn FROM ({_DIGITS})"
)
def validate_luhn_bsn(spark: SparkSession, sf: str) -> DataFrame:
    d = F.lpad(F.pmod(F.col("o_orderkey") * 7919, F.lit(1000000000)).cast("string"), 9, "0")
    return docs(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), pii.luhn(d).alias("luhn"), pii.bsn(d).alias("bsn"))


@query(
    "SELECT c_custkey AS k, (('10112310' || lpad((c_custkey * 7919)::VARCHAR, 10, '0') || '2321' || lpad((c_custkey % 100)::VARCHAR, 2, '0'))::HUGEINT) % 97 = 1 AS iban FROM customer"
)
def validate_iban(spark: SparkSession, sf: str) -> DataFrame:
    """Dutch account numbers of a bank ABNA, whose check digits are right by chance."""
    k = F.col("c_custkey")
    number = F.concat(F.lit("NL"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("ABNA"), F.lpad((k * 7919).cast("string"), 10, "0"))
    return docs(spark, sf, "customer").select(k.alias("k"), pii.iban(number).alias("iban"))


@query()
def name_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.run_chain(docs(spark, sf), [ner.step(group=True)], metadata="did")
    return out.select("doc_id", "text", F.size(F.flatten(F.transform("did", lambda x: x["masks"]))).alias("n_masks"))


@query()
def synthetic_replacements(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["NAME", "DRIVER_LICENSE", "PASSPORT_NUMBER", "LOCATION_COORDINATE", "URL", "UNKNOWN"]
    c = docs(spark, sf, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), "c_name")
    return c.select("c_custkey", "kind", ner.synthetic(F.col("kind"), F.col("c_name"), F.col("c_custkey")).alias("value"))


# --- toxic passages, generation, translation ----------------------------------------------------------------------

_BAD_LINE = {k: "|".join(v) for k, v in BAD.items()}
_HIT = "CASE lang " + " ".join(f"WHEN '{k}' THEN regexp_matches(lower(line), {lit('(^|[^\\p{L}\\p{N}_])(' + v + ')([^\\p{L}\\p{N}_]|$)')})" for k, v in _BAD_LINE.items()) + " ELSE false END"


@query(
    f"""WITH l AS (SELECT doc_id, lang, i, lines[i] AS line FROM (SELECT doc_id, lang, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, {_NL}) AS lines FROM documents))),
    h AS (SELECT doc_id, i, line, {_HIT} AS hit FROM l), s AS (SELECT doc_id, count(*) FILTER (hit) AS n, string_agg(line, ' ' ORDER BY i) FILTER (NOT hit) AS rest FROM h GROUP BY doc_id)
    SELECT doc_id, n AS n_removed, CASE WHEN n > 0 THEN coalesce(rest, '') ELSE text END AS text FROM documents JOIN s USING (doc_id)"""
)
def toxic_lines_removed(spark: SparkSession, sf: str) -> DataFrame:
    return toxic.remove_listed_lines(docs(spark, sf), BAD).select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), "text")


@query()
def toxic_chunks_removed(spark: SparkSession, sf: str) -> DataFrame:
    out = toxic.remove_toxic(docs(spark, sf), lambda: toxic.Lexicon(BAD), max_chunk_length=64)
    return out.select("doc_id", "text", F.size(F.filter("toxic_language", lambda x: x["label"].isNotNull())).alias("n_removed"))


@query(f"SELECT doc_id, i - 1 AS row_splitter_pos, lines[i] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, {_NL}) AS lines FROM documents))")
def row_split(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.split_rows(docs(spark, sf)).select("doc_id", "row_splitter_pos", "text")


@query("SELECT doc_id, text FROM documents")
def row_combine_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.combine_rows(chunks.split_rows(docs(spark, sf))).select("doc_id", "text")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversation_combine(spark: SparkSession, sf: str) -> DataFrame:
    c = docs(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("row_splitter_id"), "conv_id", F.col("turn").alias("row_splitter_pos"), F.concat("role", F.lit(": "), "text").alias("text"))
    return chunks.combine_rows(c, keep=("conv_id",)).select("conv_id", "text")


_CHUNKS = f"""SELECT doc_id, i AS row_splitter_pos, '[' || i * 1024 || ':' || least((i + 1) * 1024, length(text)) || ']' AS chunk_id, substr(replace(text, {_NL}, ' '), i * 1024 + 1, 1024) AS text
    FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1023) // 1024)) AS i FROM documents)"""


@query(_CHUNKS)
def translate_chunks_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.translate(chunks.translation_chunks(docs(spark, sf)), "madlad", dry_run=True).select("doc_id", "row_splitter_pos", "chunk_id", "text")


@query(f"WITH c AS ({_CHUNKS}) SELECT doc_id, string_agg(text, ' ' ORDER BY row_splitter_pos) AS text, string_agg(chunk_id, ',' ORDER BY row_splitter_pos) AS chunk_id, count(*) AS n FROM c GROUP BY doc_id")
def translate_combine(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.combine_translations(chunks.translation_chunks(docs(spark, sf))).select("doc_id", "text", "chunk_id", F.size("input_text").cast("long").alias("n"))


@query("SELECT item_id, 'Summarise: ' || substr(text, 1, 5461) || chr(10) || 'Summary:' AS prompt FROM benchmark")
def llm_prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, "benchmark").select("item_id", chunks.prompt(F.col("text"), "Summarise: {text}\nSummary:").alias("prompt"))


@query("SELECT item_id, 'Say: ' || text AS text, 'echo' AS model_name FROM benchmark")
def llm_generate(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.generate(docs(spark, sf, "benchmark"), "Say: {text}").select("item_id", "text", F.col("meta.model_name").alias("model_name"))


# --- perplexity, evaluation, reports ------------------------------------------------------------------------------

_PPL = f"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), {lit(T.TOKEN)})) AS w FROM documents), p AS (SELECT doc_id, lang, w, count(*) AS n FROM w GROUP BY ALL),
 m AS (SELECT lang, w, sum(n) AS c FROM p GROUP BY ALL), z AS (SELECT lang, sum(c) AS total, count(*) AS v FROM m GROUP BY ALL),
 s AS (SELECT doc_id, lang, exp(-sum(n * ln((c + 1) / (total + v))) / sum(n)) AS perplexity FROM p JOIN m USING (lang, w) JOIN z USING (lang) GROUP BY ALL)"""


@query(f"{_PPL} SELECT doc_id, lang, round(perplexity, 3) AS perplexity FROM s")
def perplexity_scores(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.unigram_perplexity(docs(spark, sf)).select("doc_id", "lang", F.round("perplexity", 3).alias("perplexity"))


@query(f"{_PPL} SELECT lang, count(*) AS n, round(min(perplexity), 3) AS min, round(max(perplexity), 3) AS max, round(avg(perplexity), 3) AS mean, round(stddev_pop(perplexity), 3) AS std_dev FROM s GROUP BY lang")
def perplexity_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = perplexity.summary(perplexity.unigram_perplexity(docs(spark, sf)))
    return s.select("lang", "n", *(F.round(c, 3).alias(c) for c in ("min", "max", "mean", "std_dev")))


@query(f"{_PPL} SELECT round(perplexity, 0) AS bucket, count(*) AS n FROM s GROUP BY 1")
def perplexity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.histogram(perplexity.unigram_perplexity(docs(spark, sf)), digits=0)


_NM = lambda c: f"coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0)::BIGINT"


@query(
    f"""WITH p AS (SELECT d.lang, l.toxic = 1 AS y, regexp_matches(lower(d.text), '\\b(idiot|moron|scum|clown|loser)\\b') AS p FROM documents d JOIN labels l USING (doc_id)),
    c AS (SELECT lang, {_NM('y AND p')} AS tp, {_NM('NOT y AND p')} AS fp, {_NM('NOT y AND NOT p')} AS tn, {_NM('y AND NOT p')} AS fn FROM p GROUP BY lang)
    SELECT lang, tp, fp, tn, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round((tp + fn) / (tp + fp + tn + fn), 6) AS ratio FROM c"""
)
def eval_confusion_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    p = docs(spark, sf).join(docs(spark, sf, "labels"), "doc_id").select("lang", F.col("toxic").alias("label"), F.lower("text").rlike(r"\b(idiot|moron|scum|clown|loser)\b").cast("int").alias("predicted"))
    return evaluation.confusion(p, ["lang"]).select("lang", "tp", "fp", "tn", "fn", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "ratio")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_sources(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.top_k(docs(spark, sf), "source", 5)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, in windows of an hour, to a memory table."""
    path = f"{sf}/events.parquet"
    src = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"events_{abs(hash((sf, id(src))))}"
    with tempfile.TemporaryDirectory() as tmp:
        w = streams.counts_by_window(src, size="1 hour").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
        if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
            w = w.option("checkpointLocation", tmp)
        q = w.start()
        q.awaitTermination()
    return spark.table(name)
