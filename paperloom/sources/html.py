"""Links and answers of HTML pages, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decoded, without_tags

_LINK = r'(?is)<a\b[^>]*?href="[^"]*"[^>]*>.*?</a\s*>'


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, rank from 1, url, title: the links of each page in order; of links to one URL the first."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(_LINK), 0)).alias("pos", "link"))
    parts = found.select(key, "pos", decoded(F.trim(F.regexp_extract("link", r'(?i)href="([^"]*)"', 1))).alias("url"), without_tags(F.regexp_extract("link", r"(?s)^<[^>]*>(.*)</", 1)).alias("title"))
    first = parts.groupBy(key, "url").agg(F.min(F.struct("pos", "title")).alias("f"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("f.pos")).cast("long")
    return first.select(key, rank.alias("rank"), "url", F.col("f.title").alias("title"))


def unwrapped(href: Column, host: str, path: str = "/l/", parameter: str = "uddg") -> Column:
    """The URL that a link of a search page leads on to; the empty string for links that stay on it."""
    raw = decoded(F.trim(href))
    whole = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).when(raw.startswith("/"), F.concat(F.lit(f"https://{host}"), raw)).otherwise(raw)
    part = lambda p, *k: F.try_parse_url(whole, F.lit(p), *map(F.lit, k))
    inner = F.when(part("HOST").endswith(host) & (part("PATH") == path), F.coalesce(F.try_url_decode(part("QUERY", parameter)), whole))
    return F.coalesce(inner, F.when(raw.rlike("(?i)^(https?:|//)"), whole), F.lit(""))


def search_results(pages: DataFrame, key: str, html: str, host: str, block: str = "result results_links", advert: str = "result--ad") -> DataFrame:
    """key, rank, url, title, snippet of the result blocks of search pages, without adverts."""
    opening = rf'(?i)<div[^>]*class="{block}'
    blocks = pages.select(key, F.posexplode(F.filter(F.split(html, f"(?={opening})"), lambda b: b.rlike(f"^{opening}"))).alias("pos", "block"))
    blocks = blocks.where(~F.regexp_extract("block", r'(?i)^<div[^>]*class="([^"]*)"', 1).contains(advert))
    anchor = r'(?is)<a[^>]*class="{}"[^>]*?{}>(.*?)</a\s*>'
    link = anchor.format("result__a", r'href="([^"]*)"[^>]*')
    parts = blocks.select(
        key, "pos", unwrapped(F.regexp_extract("block", link, 1), host).alias("url"), without_tags(F.regexp_extract("block", link, 2)).alias("title"),
        without_tags(F.regexp_extract("block", anchor.format("result__snippet", ""), 1)).alias("snippet"),
    ).where(F.col("url") != "")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return parts.select(key, rank.alias("rank"), "url", "title", "snippet")


def answer_kind(html: Column, found: str, blocked: str = "anomaly-modal|challenge-form", nothing: str | None = None) -> Column:
    """blocked, results, no_results or unknown."""
    return F.when(html.rlike(f"(?i){blocked}"), "blocked").when(html.contains(found), "results").when(html.rlike(nothing) if nothing else html.isNotNull(), "no_results").otherwise("unknown")
