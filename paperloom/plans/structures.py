"""Queries of document structure: sections, references, runs, terms, sets."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import equations, keysearch, resolve, structure
from ..sources import tei, tei_documents
from ..sources.shared import fresh_folder
from .tables import SENTENCES_SQL, read, sentences

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(r"""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
SELECT doc_id, CAST(n // 5 AS INTEGER) AS section, CAST(n // 5 + 1 AS VARCHAR) AS section_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS "order",
       sha256(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS text, CAST(n % 7 + 1 AS VARCHAR) || ',1,2,3,4' AS coords, CAST(n % 7 AS INTEGER) AS page FROM a""")
def tei_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as XML, five lines to a section, and read again sentence by sentence."""
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(escaped, "\n", -1)

    def part(x: Column, i: Column) -> Column:
        head = F.when(i % 5 == 0, F.concat(F.lit('<div><head n="'), F.floor(i / 5 + 1).cast("string"), F.lit('.">Part</head>'))).otherwise("")
        sentence = F.concat(F.lit('<p><s coords="'), (i % 7 + 1).cast("string"), F.lit(',1,2,3,4">'), x, F.lit("</s></p>"))
        return F.concat(head, sentence, F.when(i % 5 == 4, "</div>").otherwise(""))

    docs = read(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    body = F.concat(F.array_join(F.transform("lines", part), ""), F.when(F.size("lines") % 5 > 0, "</div>").otherwise(""))
    xml = docs.select("doc_id", F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>'), body, F.lit("</body></text></TEI>")).alias("xml"))
    rows = tei.sentences(xml, "doc_id", "xml")
    return rows.select("doc_id", "section", "section_number", "order", F.sha2("text", 256).alias("text"), "coords", T.pages_of(T.coordinates("coords"))[0].alias("page"))


REVISION = "r1"


def _tei_records(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Documents written as XML of many parts and taken apart again, in one parse that is written down: ten lines to a section, every other section below the one before, and
    among the sentences formulas, notes, figures and tables, and citations of two entries of three. Every fifth document breaks off after its first section, every next one
    has a character that XML forbids.
    """
    line = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(line, "\n", -1)).alias("i", "x"))
    m, i, x = F.col("i") % 10, F.col("i").cast("string"), F.col("x")
    xml = (
        F.when(m < 6, F.concat(F.lit('<p><s coords="'), (F.col("i") % 7).cast("string"), F.lit(',1,2,3,4">'), x, F.lit("</s></p>")))
        .when(m == 6, F.concat(F.lit('<formula coords="1,2,x,4,5">'), x, F.lit("</formula>")))
        .when(m == 7, F.concat(F.lit('<note place="foot" n="'), i, F.lit('"><s coords="2,1,1,1,1">'), x, F.lit("</s></note>")))
        .when(m == 8, F.concat(F.lit('<figure xml:id="f'), i, F.when(F.col("i") % 20 == 8, '" type="table').otherwise(""), F.lit('"><head>Nr</head><figDesc><s coords="3,1,1,1,1">'), x, F.lit("</s></figDesc></figure>")))
        .otherwise(F.concat(F.lit("<p><s>"), x, F.lit('<ref type="bibr" target="#b'), (F.col("i") % 3).cast("string"), F.lit('">[r]</ref></s></p>')))
    )
    k = F.floor(F.col("i") / 10)
    parts = lines.groupBy("doc_id", k.alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", xml.alias("xml")))), lambda p: p["xml"]), "").alias("xml"))
    number = F.concat((F.floor(F.col("k") / 2) + 1).cast("string"), F.when(F.col("k") % 2 == 0, ".").otherwise(".1"))
    title = F.concat(F.lit("Part"), F.when((F.col("k") == 0) & (F.col("doc_id") % 5 == 1), "\x01").otherwise(""), F.lit(" "), F.col("k").cast("string"))
    broken = F.when((F.col("k") == 0) & (F.col("doc_id") % 5 == 0), "<bad<").otherwise("")
    divs = parts.select("doc_id", "k", F.concat(F.lit('<div><head n="'), number, F.lit('">'), title, F.lit("</head>"), "xml", F.lit("</div>"), broken).alias("xml"))
    body = divs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "xml"))), lambda p: p["xml"]), "").alias("body"))
    entry = '<biblStruct xml:id="b{0}"><analytic><title type="main">Title {0}</title><author><persName><forename>A</forename><surname>B{0}</surname></persName></author></analytic><monogr><imprint><date when="200{0}-01"/></imprint></monogr><idno type="DOI">10/{0}</idno></biblStruct>'
    back = "".join(entry.format(n) for n in (0, 1))
    docs = body.select("doc_id", F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>'), "body", F.lit(f'</body><back><div type="references">{back}</div></back></text></TEI>')).alias("xml"))
    folder = fresh_folder(spark)
    tei_documents.records(docs, "doc_id", "xml", kinds).write.parquet(folder)
    return spark.read.parquet(folder)


def _tei_id(prefix: str, *parts: str) -> str:
    return f"'{prefix}' || substr(sha256(concat_ws(':', doc_id, '{REVISION}', {', '.join(parts)})), 1, 16)"


_TEI_SQL = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
a AS (SELECT *, i // 10 AS k, i % 10 AS m, trim(regexp_replace(x, '\s+', ' ', 'g')) AS t FROM l WHERE doc_id % 5 <> 0 OR i < 10),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS position, CASE WHEN m < 6 AND i % 7 > 0 THEN CAST(i % 7 - 1 AS INTEGER) END AS own FROM a WHERE m < 6 OR m = 9)"""


@query(f"""
WITH {_TEI_SQL} SELECT DISTINCT doc_id, {_tei_id("sec_", "'section'", "k")} AS section_id, CASE WHEN k % 2 = 1 THEN {_tei_id("sec_", "'section'", "k - 1")} END AS parent_id, CAST(k AS INTEGER) AS position, 'Part ' || k AS title FROM a""")
def tei_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the one above each, of whole documents and of what can be read of broken ones."""
    return tei_documents.sections(_tei_records(spark, sf_dir, "section"), "doc_id", REVISION)


@query(f"""
WITH {_TEI_SQL} SELECT doc_id, {_tei_id("s_", "position")} AS sentence_id, {_tei_id("sec_", "'section'", "k")} AS section_id, {_tei_id("p_", "'paragraph'", "position")} AS paragraph_id, sha256(x || CASE WHEN m = 9 THEN '[r]' ELSE '' END) AS text,
  coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS page, CASE WHEN m = 9 THEN 'b' || i % 3 ELSE '' END AS targets,
  CASE WHEN m = 9 THEN 'coords_missing' WHEN i % 7 = 0 THEN 'coords_page_invalid:0' ELSE '' END AS warnings FROM s""")
def tei_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with their section, paragraph and page, what they cite, and what is wrong with their places."""
    rows = tei_documents.sentences(_tei_records(spark, sf_dir, "sentence"), "doc_id", REVISION)
    own = F.array_join(F.filter("warnings", lambda w: w.startswith("coords")), ",")
    return rows.select("doc_id", "sentence_id", "section_id", "paragraph_id", F.sha2("text", 256).alias("text"), "page", F.array_join("targets", ",").alias("targets"), own.alias("warnings"))


@query(f"""
WITH {_TEI_SQL},
b AS (SELECT doc_id, i * 2 AS place, CASE m WHEN 6 THEN 'formula' WHEN 7 THEN 'footnote' ELSE if(i % 20 = 8, 'table', 'figure') END AS type, CASE WHEN m = 8 THEN trim('Nr ' || t) ELSE t END AS text,
        CASE m WHEN 7 THEN CAST(i AS VARCHAR) WHEN 8 THEN 'f' || i END AS label, CASE WHEN m = 7 THEN '1' ELSE '' END AS pages, CASE m WHEN 6 THEN 'coords_malformed:1,2,x,4,5' WHEN 8 THEN 'coords_missing' ELSE '' END AS problems FROM a WHERE m BETWEEN 6 AND 8
  UNION ALL SELECT doc_id, i * 2 + 1, 'caption', t, 'f' || i, '2', '' FROM a WHERE m = 8
  UNION ALL SELECT doc_id, 1000000000000 + n, 'bibliography', 'Title ' || n || 'AB' || n || '10/' || n, 'b' || n, '', 'coords_missing' FROM (SELECT DISTINCT doc_id FROM a WHERE doc_id % 5 <> 0), (SELECT unnest([0, 1]) AS n)),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS position FROM b)
SELECT doc_id, {_tei_id("x_", "'excluded'", "position")} AS block_id, position, type, sha256(text) AS text, label, pages, problems FROM p""")
def tei_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas, notes, figures, tables, captions and entries of the bibliography, in the order of reading."""
    rows = tei_documents.blocks(_tei_records(spark, sf_dir, "block"), "doc_id", REVISION)
    return rows.select("doc_id", "block_id", "position", "type", F.sha2("text", 256).alias("text"), "label", F.array_join("pages", ",").alias("pages"), F.array_join("problems", ",").alias("problems"))


@query(f"""
WITH {_TEI_SQL}, r AS (SELECT doc_id, n FROM (SELECT DISTINCT doc_id FROM a WHERE doc_id % 5 <> 0), (SELECT unnest([0, 1]) AS n)),
c AS (SELECT doc_id, i % 3 AS n, string_agg({_tei_id("s_", "position")}, ',' ORDER BY position) AS cited_by FROM s WHERE m = 9 GROUP BY doc_id, i % 3)
SELECT doc_id, {_tei_id("b_", "'bib'", "n")} AS reference_id, 'Title ' || n AS title, 'A B' || n AS authors, CAST(2000 + n AS INTEGER) AS year, '10/' || n AS doi, coalesce(cited_by, '') AS cited_by FROM r LEFT JOIN c USING (doc_id, n)""")
def tei_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the bibliography with the sentences that cite them."""
    rows = tei_documents.references(_tei_records(spark, sf_dir, "reference", "sentence"), "doc_id", REVISION)
    return rows.select("doc_id", "reference_id", "title", F.array_join("authors", ",").alias("authors"), "year", "doi", F.array_join("cited_by", ",").alias("cited_by"))


@query(f"""
WITH {_TEI_SQL}, d AS (SELECT DISTINCT doc_id FROM a)
SELECT doc_id, 'abstract_missing' AS code FROM d UNION ALL SELECT doc_id, 'malformed_xml' FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'forbidden_characters' FROM d WHERE doc_id % 5 = 1
UNION ALL SELECT DISTINCT doc_id, 'citation_target_missing:b' || i % 3 FROM a WHERE m = 9 AND (i % 3 = 2 OR doc_id % 5 = 0)""")
def tei_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each document, broken ones among them."""
    rows = tei_documents.warnings(_tei_records(spark, sf_dir, "warning", "reference", "sentence"), "doc_id", REVISION)
    return rows.select("doc_id", F.when(F.col("code") == "citation_target_missing", F.concat_ws(":", "code", "detail")).otherwise(F.col("code")).alias("code"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber AS "order", CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_linenumber AS VARCHAR) ELSE CAST(l_linenumber - l_linenumber % 3 + 1 AS VARCHAR) || '.' || l_suppkey END AS number FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)),
c AS (SELECT *, CASE WHEN strpos(number, '.') > 0 THEN regexp_replace(number, '\\.[^.]*$', '') END AS up FROM s)
SELECT c.l_orderkey, c."order", c.number, max(p."order") AS parent_order FROM c LEFT JOIN s p ON c.l_orderkey = p.l_orderkey AND c.up = p.number AND p."order" < c."order" GROUP BY c.l_orderkey, c."order", c.number""".replace("\\\\", "\\"))
def section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section above each numbered one: lines of orders as sections."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    n = F.col("l_linenumber")
    number = F.when(n % 3 == 1, n.cast("string")).otherwise(F.concat((n - n % 3 + 1).cast("string"), F.lit("."), F.col("s").cast("string")))
    return structure.parents(lines.select("l_orderkey", n.alias("order"), number.alias("number")), "l_orderkey", "number", "order")


@query("""
SELECT d.source, count(*) AS referred, count(l.doc_id) AS known, count(*) - count(l.doc_id) AS dangling FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY d.source""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from documents to labels that are known, and that point nowhere."""
    known, dangling = structure.resolved_references(read(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", read(spark, sf_dir, "labels"), "doc_id")
    both = known.withColumn("k", F.lit(1)).unionByName(dangling.withColumn("k", F.lit(0)))
    return both.groupBy("source").agg(F.count("*").alias("referred"), F.sum("k").alias("known"), F.sum(1 - F.col("k")).alias("dangling"))


@query(rf"""
WITH {SENTENCES_SQL}, m AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM sentences WHERE regexp_matches(text, '[#*$%&|<>0-9]')),
i AS (SELECT doc_id, pos - n AS g, min(pos) AS first, max(pos) AS last, count(*) AS size FROM m GROUP BY doc_id, pos - n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS run, first, last, size FROM i""")
def symbol_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of lines with symbols or digits."""
    return structure.runs(sentences(spark, sf_dir).select("doc_id", "pos", "text"), ["doc_id"], "pos", F.col("text").rlike("[#*$%&|<>0-9]"))


@query(rf"""
WITH {SENTENCES_SQL}, f AS (SELECT source, regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}])license([^\p{{L}}\p{{N}}]|$)') AS o, regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}])licensed([^\p{{L}}\p{{N}}]|$)') AS a, strpos(text, 'GNU') > 0 AS p, regexp_matches(lower(text), '(^|[^a-z0-9])apache([^a-z0-9]|$)') AS k FROM sentences)
SELECT source, count(*) FILTER (o) AS occurrences, count(*) FILTER (NOT o AND a) AS alias_only, count(*) FILTER (o AND p) AS with_preferred, count(*) FILTER (o AND NOT p AND k) AS with_original, count(*) FILTER (o AND NOT p AND NOT k) AS violations FROM f GROUP BY source""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source keeps to a term: in the preferred form, in another allowed one, or not."""
    lines = sentences(spark, sf_dir)
    return structure.term_stats(lines, ["source"], T.mentions("text", "license"), T.mentions("text", "licensed"), F.contains("text", F.lit("GNU")), T.keeps_original("text", "apache"))


@query("""
WITH t AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS i FROM orders WHERE o_orderstatus <> 'P'), p AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS i FROM orders WHERE o_totalprice > 150000),
o AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS i FROM orders WHERE o_orderstatus = 'P'),
b AS (SELECT coalesce(t.g, p.g) AS g, coalesce(t.i, p.i) AS i, t.g IS NOT NULL AS tt, p.g IS NOT NULL AS pp FROM t FULL JOIN p ON t.g = p.g AND t.i = p.i),
n AS (SELECT b.g, count(*) FILTER (tt AND o.g IS NULL) AS truth, count(*) FILTER (tt AND NOT pp AND o.g IS NULL) AS missing, count(*) FILTER (pp AND NOT tt AND o.g IS NULL) AS extra, count(*) FILTER (pp) AS found FROM b LEFT JOIN o ON b.g = o.g AND b.i = o.i GROUP BY b.g)
SELECT g AS o_custkey, truth, missing, extra, CASE WHEN found = 0 THEN 'no_spans' WHEN missing > 0 AND extra > 0 THEN 'both' WHEN missing > 0 THEN 'missing' WHEN extra > 0 THEN 'extra' ELSE 'equal' END AS verdict FROM n""")
def span_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against true sets, some members optional: order priorities of each customer."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return structure.compared(orders.where("o_orderstatus <> 'P'"), orders.where("o_orderstatus = 'P'"), orders.where("o_totalprice > 150000"), "o_custkey", "o_orderpriority")


@query("""
SELECT doc_id, coalesce(l.quality, CASE WHEN length(d.text) < 200 THEN 0 ELSE 1 END) AS quality, l.quality IS NOT NULL AS saved FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT doc_id, quality, true FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New guesses, overruled by saved labels."""
    guesses = read(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") < 200, 0).otherwise(1).alias("quality"), F.lit(False).alias("saved"))
    return structure.merged([guesses, read(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("saved"))], ["doc_id"])


@query("""
WITH e AS (SELECT p_type AS key, CAST(min(p_size) AS INTEGER) AS v FROM part GROUP BY p_type), a AS (SELECT p_type AS key, CAST(min(p_size) FILTER (p_retailprice > 1000) AS INTEGER) AS v FROM part GROUP BY p_type)
SELECT e.key AS p_type, e.v AS expected, a.v AS actual FROM e FULL JOIN a ON e.key = a.key WHERE e.v IS DISTINCT FROM a.v""")
def config_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings whose value is not the expected one: the least size of each type, and that among dearer parts."""
    part = read(spark, sf_dir, "part")
    least = lambda c: part.groupBy("p_type").agg(F.min(c).alias("v"))
    return structure.drift(least(F.col("p_size")), least(F.when(F.col("p_retailprice") > 1000, F.col("p_size"))), "p_type", "v")


@query("""
WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS asked FROM events WHERE event_type = 'view' GROUP BY ALL), a AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS answered_at FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT r.user_id, r.day, asked, answered_at FROM r LEFT JOIN a ON r.user_id = a.user_id AND r.day = a.day""")
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view of each user and day, and the first click of the same."""
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("id", F.struct("user_id", "day"))
    asked = events.where("event_type = 'view'").groupBy("id").agg(F.min("ts").alias("asked"))
    return structure.answered(asked, events.where("event_type = 'click'"), "id", "ts").select("id.user_id", "id.day", "asked", "answered_at")


@query("""
WITH k AS (SELECT doc_id, source FROM documents WHERE length(text) > 1000), s AS (SELECT doc_id, source FROM documents WHERE lang = 'en')
SELECT doc_id, source FROM k WHERE doc_id NOT IN (SELECT doc_id FROM s) UNION ALL SELECT doc_id, source FROM s WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def toggled_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept documents after all English ones are toggled."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return structure.toggled(docs.where("length(text) > 1000").select("doc_id", "source"), docs.where("lang = 'en'").select("doc_id", "source"), ["doc_id"])


@query(r"""
SELECT regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS key, bool_or(NOT regexp_matches(url, '[?]')) AS viewed, count(*) AS seen, min(page_id) AS first,
       count(*) FILTER (regexp_matches(url, '/(search|results)([?#]|$)')) AS rejected FROM pages GROUP BY 1""")
def research_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages merged by canonical URL: viewed if any of them was, and how many can't be sources."""
    pages = read(spark, sf_dir, "pages")
    return pages.groupBy(T.normalized_url("url").alias("key")).agg(F.bool_or(~F.col("url").contains("?")).alias("viewed"), F.count("*").alias("seen"), F.min("page_id").alias("first"), F.count_if(T.rejected_url("url").isNotNull()).alias("rejected"))


@query(r"""
WITH t AS (SELECT item_id, 'Item {{id}}: {{text}} [{{unknown}}]' AS t, text FROM benchmark)
SELECT item_id, sha256('Item ' || item_id || ': ' || text || ' [{{unknown}}]') AS prompt, 'unknown' AS undeclared, CAST(ceil(length('Item ' || item_id || ': ' || text || ' [{{unknown}}]') / 4) AS BIGINT) AS tokens FROM t""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template filled for each benchmark item, and the variables that nobody declared."""
    template = F.lit("Item {{id}}: {{text}} [{{unknown}}]")
    values = F.create_map(F.lit("id"), F.col("item_id").cast("string"), F.lit("text"), F.col("text"))
    filled = T.rendered(template, values)
    missing = F.array_join(F.array_except(T.template_variables(template), F.map_keys(values)), ",")
    return read(spark, sf_dir, "benchmark").select("item_id", F.sha2(filled, 256).alias("prompt"), missing.alias("undeclared"), T.estimated_tokens(filled).alias("tokens"))


@query("""
WITH l AS (SELECT doc_id, quality, toxic FROM labels)
SELECT source, count(*) AS total, count(quality) AS reviewed, count(*) FILTER (quality = 1) AS understood, count(*) FILTER (quality = 1) / nullif(count(quality), 0) AS ratio, count(*) FILTER (toxic = 1) AS problems,
       count(*) = count(quality) AND count(*) FILTER (quality = 1) / nullif(count(quality), 0) >= 0.8 AS passed FROM documents LEFT JOIN l USING (doc_id) GROUP BY source""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is reviewed, and whether it passes."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    good, seen = F.count_if(F.col("quality") == 1), F.count("quality")
    n = rows.groupBy("source").agg(F.count("*").alias("total"), seen.alias("reviewed"), good.alias("understood"), F.try_divide(good, seen).alias("ratio"), F.count_if(F.col("toxic") == 1).alias("problems"))
    return n.withColumn("passed", (F.col("total") == F.col("reviewed")) & (F.col("ratio") >= 0.8))


@query("""
WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS behind FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' AND behind = 'assistant' THEN 'answered' WHEN role = 'user' AND behind IS NULL THEN 'pending' WHEN role = 'assistant' AND before = 'user' THEN 'answer' ELSE 'other' END AS step FROM t""")
def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn is to those around it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    role, before, behind = F.col("role"), F.lag("role").over(w), F.lead("role").over(w)
    step = F.when((role == "user") & (behind == "assistant"), "answered").when((role == "user") & behind.isNull(), "pending").when((role == "assistant") & (before == "user"), "answer").otherwise("other")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", step.alias("step"))


@query("""
WITH n AS (SELECT lower(p_name) AS name, p_partkey, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS nth FROM part)
SELECT name, p_partkey FROM n WHERE nth = 1""")
def term_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in lower case and the first part of each."""
    return resolve.first_by(read(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), "p_partkey"), ["name"], ["p_partkey"])


def _word_units(text: pa.Array, pos: pa.Array) -> pa.Array:
    """The words of each line as units; what a checksum tells is told once for each different word of a batch."""
    split = pc.split_pattern(text, " ")
    word, owner = split.flatten(), pc.list_parent_indices(split)
    full = pc.not_equal(word, "")
    word, owner = word.filter(full).dictionary_encode(), owner.filter(full).to_numpy()
    words, code = word.dictionary.to_pylist(), word.indices
    sums = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
    small = sums % 7 == 0
    told = {
        "text": [f"{w} " if h % 3 == 0 else w for w, h in zip(words, sums.tolist(), strict=True)], "height": np.where(small, 6.5, 10.0), "baseline": np.where(small & (sums % 2 == 0), 97.0, 100.0),
        "font": ["ABCDEF+CMMI10" if h % 13 == 0 else "Times-Italic" if h % 17 == 0 else "Times" for h in sums.tolist()],
    }
    counts = np.bincount(owner, minlength=len(text))
    ends = np.concatenate([[0], np.cumsum(counts)])
    nth = np.arange(len(owner)) - ends[owner]
    of = {k: pa.array(v, pa.string() if isinstance(v, list) else pa.float64()).take(code) for k, v in told.items()}
    units = {"text": of["text"], "page": pa.array(pos.to_numpy()[owner].astype(np.int64) // 10), "index": pa.array(nth + nth // 9), "eol": pa.array(np.zeros(len(owner), bool)), "height": of["height"], "baseline": of["baseline"], "font": of["font"]}
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(list(units.values()), list(units)))


def _unit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with their words as text items: some of them small, set lower, or in a font of mathematics or italics, as a checksum tells."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))

    @F.arrow_udf(equations.UNITS)
    def units(text: pa.Array, pos: pa.Array) -> pa.Array:
        return _word_units(text, pos)

    return lines.select("doc_id", "pos", "text", units("text", "pos").alias("units"))


@query()
def line_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas among the words of every line, numbered in its text, and the candidates that aren't taken."""
    return equations.detected(_unit_lines(spark, sf_dir)).drop("units", "text")


@query()
def equation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many formulas and skipped candidates there are."""
    return equations.statistics(line_equations(spark, sf_dir).withColumn("all", F.lit("all")), ["all"])


@query()
def key_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents sought in their text items by letters and digits. Some items are notes that break a line up, some lines aren't there as they are written."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("position", "text")).withColumn("position", F.col("position").cast("long"))
    pieces = F.regexp_extract_all("text", F.lit("[^\n]{1,60}"), F.lit(0))
    note = F.concat(F.lit("note "), F.col("position").cast("string"), F.lit(" put in"))
    broken = F.when((F.col("position") % 7 == 3) & (F.size(pieces) > 1), F.concat(F.slice(pieces, 1, 1), F.array(note), F.slice(pieces, F.lit(2), F.size(pieces)))).otherwise(pieces)
    items = lines.select("doc_id", F.floor(F.col("position") / 10).alias("page"), "position", F.posexplode(broken).alias("k", "text"))
    items = items.select("doc_id", "page", (F.col("position") % 10 * 100_000 + F.col("k")).alias("index"), "text")
    sentences = lines.withColumn("text", F.when(F.col("position") % 11 == 5, F.reverse("text")).otherwise(F.col("text")))
    return keysearch.located(sentences, items, "doc_id")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, unnest(list_filter(string_split(x, ' '), lambda v: v <> '')) AS word, generate_subscripts(list_filter(string_split(x, ' '), lambda v: v <> ''), 1) - 1 AS k FROM l),
u AS (SELECT doc_id, pos, k, substring(word, 2, greatest(length(word) - 1, 0)) AS text, CASE length(word) % 3 WHEN 0 THEN 'CMMI10' WHEN 1 THEN 'Times' END AS font FROM w WHERE k % 5 <> 4)
SELECT doc_id, pos, sha256(string_agg(text || ':' || coalesce(font, '-'), ' ' ORDER BY k)) AS units, count(*) AS n FROM u GROUP BY doc_id, pos""")
def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lines as items, spans of all but their first characters with the items' fonts, gathered by line; some spans name no item, some fonts aren't known."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "x"))
    words = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.posexplode(F.filter(F.split("x", " "), lambda w: w != "")).alias("k", "text"))
    items = words.where("k % 5 <> 4").select(
        "doc_id", F.col("pos").alias("page"), F.col("k").cast("long").alias("index"), "text", F.lit(False).alias("eol"), F.lit(10.0).alias("height"), F.lit(100.0).alias("baseline"), F.concat(F.lit("f"), (F.length("text") % 3).cast("string")).alias("font_name")
    )
    fonts = words.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.struct(F.lit("f0").alias("font_name"), F.lit("CMMI10").alias("font")), F.struct(F.lit("f1").alias("font_name"), F.lit("Times").alias("font")))).alias("f")).select("doc_id", "f.*")
    spans = words.select("doc_id", "pos", F.col("pos").alias("page"), F.col("k").cast("long").alias("index"), F.lit(1).alias("start"), F.length("text").alias("end"))
    found = equations.gathered(equations.span_units(spans, items, fonts, "doc_id"), ["doc_id", "pos"], ["page", "index"])
    text = F.array_join(F.transform("units", lambda u: F.concat(u["text"], F.lit(":"), F.coalesce(u["font"], F.lit("-")))), " ")
    return found.select("doc_id", "pos", F.sha2(text, 256).alias("units"), F.size("units").cast("long").alias("n"))
