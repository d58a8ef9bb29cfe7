"""Verdicts on URLs: a host/path rule list, then a weighted vocabulary found with an Aho-Corasick automaton."""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import table

#: (verdict, host, path): fits the host and its subdomains if the url's path starts with path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: One of these rejects a url.
STRICT = ("porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "camgirl", "escort", "casino", "viagra", "warez", "keygen")
#: Several distinct ones of these reject a url.
SOFT = ("adult", "sex", "sexy", "nude", "dating", "poker", "bet", "betting", "gambling", "jackpot", "slots", "pills", "pharmacy", "loan", "payday", "torrent", "crack", "serial", "free", "hot")
SOFT_NEEDED = 2


@functools.cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, w in enumerate([*soft, *strict]):
        a.add_word(w, (w, i >= len(soft)))
    if len(a):
        a.make_automaton()
    return a


def _hits(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Numbers of strict hits and of distinct soft terms, with no ASCII letter or digit beside a hit."""
    if not url or not (strict or soft):
        return 0, 0
    low = "".join(c.lower() if c.isascii() else c for c in url) if not url.isascii() else url.lower()
    n, found = 0, set()
    for end, (w, is_strict) in _automaton(strict, soft).iter(low):
        a, b = end - len(w), end + 1
        if (a >= 0 and low[a].isascii() and low[a].isalnum()) or (b < len(low) and low[b].isascii() and low[b].isalnum()):
            continue
        if is_strict:
            n += 1
        else:
            found.add(w)
    return n, len(found)


def vocabulary_hits(url: Column, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> Column:
    """struct<strict, soft>: hits of strict terms, distinct soft terms; null url: zeros."""

    @F.arrow_udf("struct<strict: int, soft: int>")
    def hits(urls: pa.Array) -> pa.Array:
        got = [_hits(u, strict, soft) for u in urls.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.int32())], ["strict", "soft"])

    return hits(url)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path joined; ties: allow, then text) and its verdict; nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """pages with url_host, url_path, url_rule, url_strict, url_soft and url_verdict; columns of pages with these names are replaced, all others stay.

    A fitting rule decides; else one strict hit or soft_needed distinct soft terms block. Every row is judged by
    itself: no shuffle. Null or empty urls are allowed, with empty host and path; repeated rows stay repeated; an empty table gives no rows.
    """
    host, path = host_path(F.col("url"))
    # the row goes along as a struct, so that no name of its columns can clash
    out = pages.select(F.struct(*pages.columns).alias("row"), F.col(url).alias("url")).withColumns({"url_host": host, "url_path": path})
    name, ruled = rule_of(F.col("url_host"), F.col("url_path"), rules)
    out = out.withColumns({"url_rule": name, "ruled": ruled, "hits": vocabulary_hits(F.col("url"), strict, soft)})
    bad = (F.col("hits.strict") >= 1) | (F.col("hits.soft") >= soft_needed)
    out = out.withColumns({"url_strict": F.col("hits.strict"), "url_soft": F.col("hits.soft"), "url_verdict": F.coalesce(F.col("ruled"), F.when(bad, "block").otherwise("allow"))})
    new = ["url_host", "url_path", "url_rule", "url_strict", "url_soft", "url_verdict"]
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in new), *new)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def _oracle() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda w: f"regexp_matches({low}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (SELECT *, CASE {' '.join(f"WHEN {fits(h, x)} THEN '{h}{x}'" for _, h, x in ordered)} END AS rule,
        CASE {' '.join(f"WHEN {fits(h, x)} THEN '{v}'" for v, h, x in ordered)} END AS ruled FROM p)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN {' OR '.join(map(hit, STRICT))}
  OR ({' + '.join(f"{hit(w)}::INT" for w in SOFT)}) >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict FROM q"""


QUERIES = {"op9_url_filters": op9_url_filters}
ORACLES = {"op9_url_filters": _oracle()}
