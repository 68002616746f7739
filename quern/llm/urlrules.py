"""URL filters: pattern rules indexed by their rarest literal token.

Rules are written in the wildcard syntax of public block lists: * stands for
any run of characters, ^ for a separator or the end, | at either end anchors
it, || at the start anchors at the scheme's end or a dot in the host, and @@
before a rule makes it an exception. A rule's literal tokens are the runs of
letters and digits that are bounded on both sides by a literal separator, ^
or an anchor: every URL that the rule matches has them as whole tokens.

Each rule is filed under the one of its tokens that the fewest URLs have,
counted over the whole table. A URL's tokens fetch the rules filed under
them; these, and the few rules without a token, are all whose regular
expressions run.

Rules don't grow with the data. Up to MAX_RULE_CHARS of them are broadcast at
once; more are divided into shards, applied one after the other, with the
same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

MAX_RULE_CHARS = 50_000_000
TOKEN = re.compile(r"[a-z0-9]+")

#: A general starting list: advertising, tracking, adult, gambling, shops' sessions, feeds, mobile duplicates, and some sections.
RULES: tuple[tuple[str, str], ...] = (
    ("ads-host", "||ads.*^"), ("ad-path", "/ads/"), ("ad-server", "||adserver.*"), ("banner", "/banner/*.gif"), ("doubleclick", "||doubleclick.net^"),
    ("track-utm", "?utm_*="), ("track-utm-more", "&utm_*="), ("track-ref", "&ref=x^"), ("track-ref-only", "?ref=x^"), ("pixel", "/pixel.gif|"), ("fbclid", "fbclid="),
    ("session", "?sessionid="), ("phpsess", "phpsessid="), ("print-view", "/print/"), ("paging", "?page=*&ref="), ("deep-page", "?page=9^"), ("calendar", "/calendar/*/*/"),
    ("login", "/login^"), ("signup", "/signup^"), ("cart", "/cart^"), ("checkout", "/checkout^"), ("wp-admin", "/wp-admin/"), ("wp-json", "/wp-json/"), ("feed", "/feed/|"), ("rss", "/rss.xml|"),
    ("mobile-host", "||m.*^"), ("blog-net", "||blog.*.example.net^"), ("shop-org", "||shop.*.example.org^"), ("forum-host", "||forum.*^"), ("adult", "||xxx.*^"), ("adult-path", "/xxx/"), ("casino", "||casino*.com^"), ("poker", "/poker/"),
    ("pdf", ".pdf|"), ("archive", ".zip|"), ("exe", ".exe|"), ("image", ".jpg|"), ("insecure-fr", "|http://*/fr/"), ("insecure-es-page", "|http://*/es/*?page="), ("fragment-top", "#top|"), ("spam-tld", "||*.xyz^"), ("ip-host", "|http*://10."),
    ("section-7xx", "/7*/|"), ("slash-end-de", "/de/*/|"), ("keep-docs", "@@||docs.*^"), ("keep-first", "@@?page=1^"), ("keep-help", "@@/help/"), ("keep-en-top", "@@.example.org/en/*#top|"),
)


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    allow: bool
    tokens: tuple[str, ...]


def compile_rule(name: str, rule: str) -> Rule:
    """The rule's regular expression, for the lower-cased URL, without look-around; and its literal tokens."""
    allow = rule.startswith("@@")
    body = (rule[2:] if allow else rule).lower()
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    body = re.sub(r"\*+", "*", body)
    regex = "".join("(.|\\n)*" if c == "*" else "([^a-z0-9_.%-]|$)" if c == "^" else _escape(c) for c in body)
    tokens = []
    for m in TOKEN.finditer(body):
        left = body[m.start() - 1] if m.start() else ("^" if head else "*")
        right = body[m.end()] if m.end() < len(body) else ("^" if tail else "*")
        if left != "*" and right != "*" and left.isascii() and right.isascii():
            tokens.append(m[0])
    return Rule(name, head + regex + tail, allow, tuple(dict.fromkeys(tokens)))


def _escape(c: str) -> str:
    return f"[{c}]" if c in ".?+*|(){}$" else f"\\{c}" if c in "[]\\^" else c


def index(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by their rarest token, ties by the token itself; under "" those without one."""
    out: dict[str, list[Rule]] = {}
    for r in rules:
        key = min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else ""
        out.setdefault(key, []).append(r)
    return out


def token_frequencies(urls: DataFrame, wanted: set[str]) -> dict[str, int]:
    """URLs that have each of the wanted tokens, over all of urls; the result is no larger than wanted."""
    spark = urls.sparkSession
    if not wanted:
        return {}
    few = spark.createDataFrame([(t,) for t in sorted(wanted)], "token string")
    each = urls.where("url is not null").select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    return {r[0]: r[1] for r in each.join(few, "token", "left_semi").groupBy("token").count().collect()}


def apply_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most: int = MAX_RULE_CHARS) -> DataFrame:
    """One row a row of pages: page_id, url, rules (names of all matching ones, sorted, joined by commas), blocked.

    blocked: a rule matches and no exception does. A null or empty URL matches
    nothing and is not blocked; URLs of any length are matched whole. Rules of the same name count as one. Repeated
    rows are each judged; a null page_id stays null; further columns of pages
    are left out; an empty table gives no rows.
    """
    spark = pages.sparkSession
    src = pick(pages, page_id="page_id", url="url").withColumn("page_id", F.col("page_id").cast("long"))
    compiled = [compile_rule(n, r) for n, r in rules]
    counts = token_frequencies(src, {t for r in compiled for t in r.tokens})
    shards: list[list[Rule]] = [[]]
    held = 0
    for r in compiled:
        if held + len(r.regex) > most and shards[-1]:
            shards.append([])
            held = 0
        shards[-1].append(r)
        held += len(r.regex)
    out = src.select("page_id", "url", F.array().cast("array<string>").alias("rules"), F.lit(False).alias("hit"), F.lit(False).alias("spared"))
    for shard in shards:
        shared = spark.sparkContext.broadcast(index(shard, counts))

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by = {t: [(r.name, re.compile(r.regex).search, r.allow) for r in v] for t, v in shared.value.items()}
            always = by.pop("", [])
            for b in it:
                names, hits, spares = [], [], []
                for url, had, hit, spared in zip(*(b[c].to_pylist() for c in ("url", "rules", "hit", "spared"))):
                    found = set(had)
                    if url:
                        low = url.lower()
                        for t in {*TOKEN.findall(low)} & by.keys():
                            for name, search, allow in by[t]:
                                if search(low):
                                    found.add(name)
                                    hit, spared = hit or not allow, spared or allow
                        for name, search, allow in always:
                            if search(low):
                                found.add(name)
                                hit, spared = hit or not allow, spared or allow
                    names.append(sorted(found))
                    hits.append(hit)
                    spares.append(spared)
                yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(names, pa.list_(pa.string())), pa.array(hits, pa.bool_()), pa.array(spares, pa.bool_())], ["page_id", "url", "rules", "hit", "spared"])

        out = out.mapInArrow(run, "page_id long, url string, rules array<string>, hit boolean, spared boolean")
    return out.select("page_id", "url", F.array_join("rules", ",").alias("rules"), (F.col("hit") & ~F.col("spared")).alias("blocked"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "pages"))


def oracle(rules: Sequence[tuple[str, str]] = RULES) -> str:
    """DuckDB SQL that runs every rule on every URL."""
    rows = ", ".join("('{}', '{}', {})".format(r.name, r.regex.replace("'", "''"), str(r.allow).lower()) for r in (compile_rule(n, x) for n, x in rules))
    return f"""
        WITH rule(name, regex, allow) AS (VALUES {rows}),
        p AS (SELECT page_id, url, row_number() OVER () AS n FROM pages),
        m AS (SELECT n, string_agg(name, ',' ORDER BY name) AS rules, bool_or(NOT allow) AND NOT bool_or(allow) AS blocked
              FROM p JOIN rule ON regexp_matches(lower(url), regex) GROUP BY n)
        SELECT page_id, url, coalesce(rules, '') AS rules, coalesce(blocked, false) AS blocked FROM p LEFT JOIN m USING (n)"""
