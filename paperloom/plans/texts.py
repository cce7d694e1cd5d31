"""Queries of text functions: quality, sentences, numbers, URLs and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import formulas
from ..sources import html
from .tables import SENTENCES_SQL, read, sentences, trimmed_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


PAGE_SQL = r"""
SELECT doc_id, source, length(regexp_replace(text, '\s', '', 'g')) AS chars,
       length(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[\p{Co}\p{Cc}�]', '', 'g')) AS valid_chars,
       len(string_split(text, chr(10))) AS items
FROM documents"""

QUALITY_SQL = f"""
page AS ({PAGE_SQL}),
judged AS (
  SELECT *, CASE WHEN chars < 20 THEN 'needs_ocr' WHEN valid_chars / chars < 0.7 THEN 'garbled'
                 WHEN chars < 200 THEN 'sparse' ELSE 'ok' END AS quality FROM page
)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = read(spark, sf_dir, "documents").select(
        "doc_id", "source", T.inked_chars("text").alias("chars"), T.valid_chars("text").alias("valid_chars"), F.size(F.split("text", "\n", -1)).cast("long").alias("items")
    )
    return stats.withColumn("quality", T.text_quality(F.col("chars"), F.col("valid_chars")))


@query(f"WITH {QUALITY_SQL} SELECT doc_id, chars, valid_chars, items, quality FROM judged")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that aren't white space, valid ones, lines, and the verdict, of every document."""
    return _pages(spark, sf_dir).drop("source")


@query(f"""
WITH {QUALITY_SQL}, n AS (
  SELECT source, count(*) AS n, count(*) FILTER (quality = 'needs_ocr') AS ocr, count(*) FILTER (quality = 'garbled') AS garbled,
         count(*) FILTER (quality = 'ok') AS ok FROM judged GROUP BY source)
SELECT source, n, CASE WHEN ocr / n > 0.5 THEN 'needs_ocr' WHEN garbled / n > 0.5 THEN 'garbled' WHEN ok = 0 THEN 'sparse' ELSE 'ok' END AS quality,
       CASE WHEN ocr / n > 0.5 OR garbled / n > 0.5 THEN true ELSE false END AS halts FROM n""")
def collection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each source, by majority."""
    n = F.count("*")
    share = {q: F.count_if(F.col("quality") == q) / n for q in ("needs_ocr", "garbled", "ok")}
    verdict = F.when(share["needs_ocr"] > 0.5, "needs_ocr").when(share["garbled"] > 0.5, "garbled").when(share["ok"] == 0, "sparse").otherwise("ok")
    return _pages(spark, sf_dir).groupBy("source").agg(n.alias("n"), verdict.alias("quality")).withColumn("halts", F.col("quality").isin("needs_ocr", "garbled"))


_TERMINAL = T.TERMINAL.replace("'", "''")


@query(rf"""
WITH {SENTENCES_SQL}, t AS (SELECT doc_id, pos, {trimmed_sql("text")} AS t FROM sentences)
SELECT doc_id, pos,
       CASE WHEN regexp_matches(t, '{_TERMINAL}') THEN 'sentence' ELSE 'fragment' END AS kind,
       CASE WHEN t = '' THEN 'empty_text' ELSE array_to_string(list_filter([
         CASE WHEN NOT regexp_matches(t, '{_TERMINAL}') THEN 'boundary_no_terminal_punctuation'
              WHEN regexp_matches(t, '\b({"|".join(a.replace(".", "[.]") for a in T.ABBREVIATIONS)})\.\s*$')
              THEN 'boundary_abbreviation_end' END,
         CASE WHEN regexp_matches(t, '^\p{{Ll}}') THEN 'boundary_lowercase_start' END], lambda x: x IS NOT NULL), ',') END AS warnings
FROM t""")
def sentence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and boundary warnings of every line."""
    return sentences(spark, sf_dir).select("doc_id", "pos", T.is_sentence("text").alias("kind"), F.array_join(T.sentence_warnings("text"), ",").alias("warnings"))


@query(f"WITH {SENTENCES_SQL} SELECT doc_id, CAST(sum(CAST(ceil(length(text) / 4) AS BIGINT)) AS BIGINT) AS tokens, max(CAST(ceil(length(text) / 4) AS BIGINT)) AS longest FROM sentences GROUP BY doc_id")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every document, line by line, and of its longest line."""
    n = T.estimated_tokens("text")
    return sentences(spark, sf_dir).groupBy("doc_id").agg(F.sum(n).alias("tokens"), F.max(n).alias("longest"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, sha256(regexp_replace(text, '\s+', '', 'g')) AS squeezed, substr(sha256(text), 1, 16) AS short_id FROM documents""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the forms in which texts are compared, and short ids."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse("text"), 256).alias("collapsed"), F.sha2(T.squeeze("text"), 256).alias("squeezed"), T.short_hash("text").alias("short_id"))


TERMS = ["license", "the", "CC BY-NC 4.0", "all rights reserved", "version", "é"]


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS term, count(*) FILTER (m) AS documents, count(*) FILTER (m AND strpos(text, '{t}') > 0) AS as_written FROM (SELECT text, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){t.lower().replace('.', '[.]')}([^\\p{{L}}\\p{{N}}]|$)') AS m FROM documents)"
        for t in TERMS
    )
    + ")"
)
def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention each term as whole words, and those of them that write it in the same case."""
    docs = read(spark, sf_dir, "documents")
    flags = docs.select(*(F.struct(T.mentions("text", t).alias("m"), F.contains("text", F.lit(t)).alias("w")).alias(f"t{k}") for k, t in enumerate(TERMS)))
    one = flags.agg(*(F.struct(F.count_if(F.col(f"t{k}.m")).alias("documents"), F.count_if(F.col(f"t{k}.m") & F.col(f"t{k}.w")).alias("as_written")).alias(f"t{k}") for k in range(len(TERMS))))
    rows = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{k}.documents").alias("documents"), F.col(f"t{k}.as_written").alias("as_written")) for k, t in enumerate(TERMS)))
    return one.select(F.inline(rows))


_MARKED = "x || ' '"
for _ in range(2):  # groups of thousands share their comma, so a pass marks every other one
    _MARKED = rf"regexp_replace({_MARKED}, ',([0-9]{{3}})([^0-9])', '_\1\2', 'g')"
_UNGROUPED = f"replace({_MARKED}, '_', '')"


@query(rf"""
WITH n AS (
  SELECT doc_id, list_distinct(list_transform(list_transform(list_filter(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*(?:\s?[MBKk](?:[^A-Za-z]|$))?'), lambda x: NOT regexp_matches(x, '[MBKk]')),
         lambda x: regexp_replace(x, '[^0-9.,]', '', 'g')), lambda x: trim({_UNGROUPED}))) AS numbers FROM documents)
SELECT doc_id, CAST(len(numbers) AS BIGINT) AS n, array_to_string(list_sort(numbers), ' ') AS numbers FROM n""")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct numbers of every document, without those that have a unit letter; the character behind a unit belongs to it, as in the SQL."""
    found = T.numbers_in("text", units_take=True)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(F.array_sort(found), " ").alias("numbers"))


@query(r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS key, lower(regexp_extract(url, '//([^/?#]+)', 1)) AS host FROM pages)
SELECT host, count(*) AS pages, count(DISTINCT key) AS urls, min(key) AS first FROM u GROUP BY host""")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and canonical URLs of each host."""
    u = read(spark, sf_dir, "pages").select(T.normalized_url("url").alias("key"))
    host = F.try_parse_url("key", F.lit("HOST"))
    return u.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.countDistinct("key").alias("urls"), F.min("key").alias("first"))


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a[^>]*href="[^"]*"[^>]*>[^<]*</a>'), 1) AS pos FROM pages),
f AS (SELECT page_id, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS url, regexp_extract(a, '>([^<]*)<', 1) AS title FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS nth FROM f)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, url, title FROM r WHERE nth = 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page in order, each URL once."""
    links = html.links(read(spark, sf_dir, "pages"), "page_id", "html")
    return links.select("page_id", "rank", "url", "title")


@query(r"""
WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM t""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without markup and with character references decoded."""
    return read(spark, sf_dir, "pages").select("page_id", T.without_tags(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@query("""
WITH k AS (SELECT substr(sha256(regexp_replace(html, '<[^>]*>', '', 'g')), 1, 16) AS id, page_id, CASE WHEN html LIKE '%<article>%' THEN 'results' WHEN html IS NULL THEN 'unknown' ELSE 'no_results' END AS kind FROM pages)
SELECT kind, count(*) AS pages, count(DISTINCT id) AS texts FROM k GROUP BY kind""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of answer each page is, and how many differ in their text."""
    pages = read(spark, sf_dir, "pages")
    kind = html.answer_kind(F.col("html"), found="<article>")
    text = T.short_hash(F.regexp_replace("html", "<[^>]*>", ""))
    return pages.groupBy(kind.alias("kind")).agg(F.count("*").alias("pages"), F.countDistinct(text).alias("texts"))


@query(f"""
WITH {SENTENCES_SQL} SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS of FROM sentences WHERE strpos(lower(text), 'license') > 0""")
def interactive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a typed query is in, with the number found in each document."""
    hits = sentences(spark, sf_dir).where(T.found_in(" License ", "text"))
    return hits.select("doc_id", "pos", F.count("*").over(Window.partitionBy("doc_id")).alias("of"))


@query(r"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
t AS (SELECT doc_id, pos, unnest(string_split(line, ' ')) AS u, generate_subscripts(string_split(line, ' '), 1) AS i FROM s),
k AS (SELECT *, CASE WHEN regexp_matches(u, '[#*$%&|<>]') THEN 1 ELSE 0 END AS strong FROM t)
SELECT doc_id, count(*) FILTER (strong = 1) AS units, count(DISTINCT pos) FILTER (strong = 1) AS lines FROM k GROUP BY doc_id HAVING count(*) FILTER (strong = 1) > 0""")
def symbol_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with symbols in each document, and the lines that have some."""
    strong = F.filter(F.split("text", " "), lambda u: u.rlike("[#*$%&|<>]"))
    rows = sentences(spark, sf_dir).select("doc_id", F.size(strong).cast("long").alias("n")).where("n > 0")
    return rows.groupBy("doc_id").agg(F.sum("n").alias("units"), F.count("*").alias("lines"))


@query()
def inline_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with formulas, and what is left when these are numbered."""
    rows = sentences(spark, sf_dir).select("doc_id", "pos", formulas.formulas(F.col("text")).alias("formulas"), formulas.replaced(F.col("text")).alias("text"))
    return rows.where(F.size("formulas") > 0)
