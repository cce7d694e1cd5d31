"""Queries of statistics, integrity checks and state rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..functions.rules import violations
from ..operators import alignment, resolve, structure
from ..sources import html
from . import relations
from .tables import SENTENCES_SQL, SPANS_SQL, read, sentences, spans

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(f"""
WITH c AS ({relations.ORACLE_SQL["spatial_candidates"].strip()}), o AS (SELECT o_orderpriority AS p, coalesce(candidates, 0) AS n FROM orders LEFT JOIN c USING (o_orderkey)),
r AS (SELECT p, n, row_number() OVER (PARTITION BY p ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY p) AS k FROM o)
SELECT p AS o_orderpriority, max(k) AS sentences, count(*) FILTER (n = 0) AS none, min(n) AS least, max(n) FILTER (i = k // 2) AS median, max(n) AS most, CAST(sum(n) AS BIGINT) AS candidates FROM r GROUP BY p""")
def candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many text items were found near the sentences of each priority."""
    found = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(relations.spatial_candidates(spark, sf_dir), "o_orderkey", "left")
    n = found.select("o_orderpriority", F.coalesce("candidates", F.lit(0)).alias("n_found"))
    order = resolve.upper_median(n, ["o_orderpriority"], "n_found").withColumnRenamed("n", "sentences")
    sums = n.groupBy("o_orderpriority").agg(F.count_if(F.col("n_found") == 0).alias("none"), F.sum("n_found").alias("candidates"))
    return order.join(sums, "o_orderpriority")


@query()
def alignment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the passages fitted: by status how many, why not, how far off in the middle and at most, and how many items they cover."""
    rows = relations.passage_alignment(spark, sf_dir).select("status", "reason", "exact", (F.col("distance") / F.greatest("length", F.lit(1))).alias("ratio"), F.size("spans").alias("spans"))
    reasons = [F.count_if(F.col("reason") == r).alias(r) for r in (alignment.EMPTY, alignment.NO_CANDIDATES, alignment.OVER, alignment.AMBIGUOUS)]
    out = rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), *reasons)
    for value in ("ratio", "spans"):
        middle = resolve.upper_median(rows, ["status"], value).select("status", F.col("median").alias(f"{value}_median"), F.col("most").alias(f"{value}_max"))
        out = out.join(middle, "status", "left")
    return out


@query(rf"""
WITH {SENTENCES_SQL}, k AS (SELECT doc_id, pos, CASE WHEN trim(text, ' ') = '' THEN 'blank' WHEN regexp_matches(text, '^.* \| ') THEN 'table' WHEN regexp_matches(text, '^\s*([-*•]|[0-9]+[.)])\s') THEN 'list' ELSE 'paragraph' END AS kind FROM sentences),
b AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM kind OR kind = 'paragraph' THEN 1 ELSE 0 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM b)
SELECT doc_id, CAST(block AS BIGINT) AS block, kind, count(*) AS lines, min(pos) AS first FROM g GROUP BY doc_id, block, kind""")
def rich_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, lists and tables of each document; lines of a list or a table belong together."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = F.col("text")
    kind = F.when(F.trim(t) == "", "blank").when(t.rlike(r"^.* \| "), "table").when(t.rlike(r"^\s*([-*•]|[0-9]+[.)])\s"), "list").otherwise("paragraph")
    rows = sentences(spark, sf_dir).select("doc_id", "pos", kind.alias("kind"))
    new = rows.withColumn("new", (~F.lag("kind").over(w).eqNullSafe(F.col("kind")) | (F.col("kind") == "paragraph")).cast("int"))
    blocks = new.withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return blocks.groupBy("doc_id", "block", "kind").agg(F.count("*").alias("lines"), F.min("pos").alias("first"))


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity, last_value(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS body, l_extendedprice FROM lineitem)
SELECT count(*) AS n, count(body) AS judged, count(*) FILTER (l_extendedprice < 0.85 * body) AS scripts, l_linenumber FROM w GROUP BY l_linenumber""")
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that are clearly smaller than the nearest one of body size before them: lines of orders as units."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    body = F.last(F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice")), ignorenulls=True).over(w)
    rows = read(spark, sf_dir, "lineitem").withColumn("body", body)
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("body").alias("judged"), F.count_if(F.col("l_extendedprice") < 0.85 * F.col("body")).alias("scripts"))


@query(f"""
WITH {SENTENCES_SQL}, {SPANS_SQL}, p AS (SELECT doc_id, max(pos) AS last FROM spans GROUP BY doc_id), m AS (SELECT s.doc_id, CAST(min(s.pos) AS BIGINT) AS first, CAST(max(s.pos) AS BIGINT) AS last FROM spans s WHERE s."start" < 300 AND s."end" > 100 GROUP BY s.doc_id)
SELECT m.doc_id, m.first, m.last, CASE WHEN m.first > 0 THEN m.first - 1 END AS before, CASE WHEN m.last < p.last THEN m.last + 1 END AS behind FROM m JOIN p USING (doc_id)""")
def sentence_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines before and behind a selection in each document."""
    rows = spans(spark, sf_dir)
    chosen = rows.where((F.col("start") < 300) & (F.col("end") > 100)).groupBy("doc_id").agg(F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last"))
    ends = rows.groupBy("doc_id").agg(F.max("pos").alias("end_pos"))
    before, behind = F.when(F.col("first") > 0, F.col("first") - 1), F.when(F.col("last") < F.col("end_pos"), F.col("last") + 1)
    return chosen.join(ends, "doc_id").select("doc_id", "first", "last", before.alias("before"), behind.alias("behind"))


@query("""
SELECT d.doc_id, CASE WHEN n_chars IS NULL THEN 'no_hash' WHEN n_chars <> length(text) THEN 'hash_mismatch' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS state FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each listed document has the size that its list says, and a result."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("known")).distinct()
    state = F.when(F.col("n_chars").isNull(), "no_hash").when(F.col("n_chars") != F.length("text"), "hash_mismatch").when(F.col("known").isNull(), "missing").otherwise("ok")
    return docs.select("doc_id", "n_chars", "text").join(labels, F.col("doc_id") == F.col("known"), "left").select("doc_id", state.alias("state"))


@query("""
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, ts, event_id, row_number() OVER w AS n, count(*) FILTER (event_type <> 'error') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id))
SELECT user_id, day, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failed, CAST(sum(CASE n WHEN 2 THEN 5 WHEN 3 THEN 15 WHEN 4 THEN 45 ELSE 0 END) AS BIGINT) AS waited, bool_or(event_type <> 'error') AS ok FROM a WHERE done = 0 AND n <= 4 GROUP BY user_id, day""")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts up to the first that didn't fail, four at most, and the seconds waited between them."""
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    bad = F.col("event_type") == "error"
    first = rows.withColumn("n", F.row_number().over(w)).where("n <= 4")
    tried = first.withColumn("done", F.coalesce(F.sum((~bad).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("done = 0")
    delay = F.when(F.col("n") == 2, 5).when(F.col("n") == 3, 15).when(F.col("n") == 4, 45).otherwise(0)
    return tried.groupBy("user_id", "day").agg(F.count("*").alias("attempts"), F.count_if(bad).alias("failed"), F.sum(delay).alias("waited"), F.bool_or(~bad).alias("ok"))


TRANSITIONS = {"view": "reading", "click": "reading", "purchase": "finished", "signup": "started", "error": "stopped"}


@query("""
WITH s AS (SELECT user_id, arg_max(event_type, ROW(ts, event_id)) AS last, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id)
SELECT user_id, CASE last WHEN 'view' THEN 'reading' WHEN 'click' THEN 'reading' WHEN 'purchase' THEN 'finished' WHEN 'signup' THEN 'started' ELSE 'stopped' END AS state, last = 'error' AND errors < 10 AS retry, last = 'purchase' AS notify FROM s""")
def paper_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that each user's last event leads to, by a table of transitions; whether to try again, and to tell."""
    table = F.create_map(*(F.lit(x) for kv in TRANSITIONS.items() for x in kv))
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return rows.select("user_id", F.try_element_at(table, F.col("last")).alias("state"), ((F.col("last") == "error") & (F.col("errors") < 10)).alias("retry"), (F.col("last") == "purchase").alias("notify"))


@query("""
SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, sha256(arg_max(text, turn)) AS last, CASE WHEN arg_max(role, turn) = 'assistant' THEN 'completed' ELSE 'interrupted' END AS outcome FROM conversations GROUP BY conv_id""")
def turn_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation came to: its last message, and how much was said."""
    rows = read(spark, sf_dir, "conversations")
    outcome = F.when(F.max_by("role", "turn") == "assistant", "completed").otherwise("interrupted")
    return rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.sha2(F.max_by("text", "turn"), 256).alias("last"), outcome.alias("outcome"))


@query(r"""
WITH n AS (SELECT p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY lower(trim(p_name)), p_brand ORDER BY p_partkey) AS nth FROM part),
j AS (SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 'empty_term' WHEN nth > 1 THEN 'duplicate_term' WHEN regexp_matches(p_name, '\bs[0-9]+\b') THEN 'leaked_alias' END AS problem FROM n)
SELECT * FROM j WHERE problem IS NOT NULL""")
def glossary_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are empty, come twice within a brand, or hold an alias of the prompt."""
    key = F.lower(F.trim("p_name"))
    nth = F.row_number().over(Window.partitionBy(key, "p_brand").orderBy("p_partkey"))
    problem = F.when(F.trim("p_name") == "", "empty_term").when(nth > 1, "duplicate_term").when(F.col("p_name").rlike(r"\bs[0-9]+\b"), "leaked_alias")
    return read(spark, sf_dir, "part").select("p_partkey", problem.alias("problem")).where("problem is not null")


@query("""
WITH f AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id, sha256('{"conv_id":' || conv_id || ',"turns":[' || string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) || ']}') AS input_hash, count(*) AS targets FROM f GROUP BY conv_id""")
def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of what goes into each unit of work, that says when it can be used again."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return rows.select("conv_id", F.sha2(F.to_json(F.struct("conv_id", "turns")), 256).alias("input_hash"), F.size("turns").cast("long").alias("targets"))


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>[^<]*</a>', 1)) AS url, generate_subscripts(regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>[^<]*</a>', 1), 1) AS pos FROM pages)
SELECT url, substr(sha256(url), 1, 16) AS id, min(page_id) AS first_seen, count(DISTINCT page_id) AS pages FROM l GROUP BY url""")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each URL that pages link to, with where it was first seen."""
    links = html.links(read(spark, sf_dir, "pages"), "page_id", "html")
    return links.groupBy("url").agg(F.min("page_id").alias("first_seen"), F.countDistinct("page_id").alias("pages")).withColumn("id", T.short_hash("url"))


@query()
def self_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page that lead to the page itself, by address or by title."""
    pages = read(spark, sf_dir, "pages")
    own = pages.select("page_id", F.col("url").alias("own_url"), T.without_tags(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("own_title"))
    links = html.links(pages, "page_id", "html").join(own, "page_id")
    found = U.is_self_source(F.col("url"), F.col("title"), T.paper_number("own_url"), F.col("own_url"), F.col("own_title"))
    return links.select("page_id", "rank", found.alias("self"))


@query("""
WITH t AS (SELECT doc_id, 'k' || (doc_id % 5) AS tag, CASE WHEN length(text) > 800 THEN 'mapped' WHEN length(text) > 300 THEN 'uncertain' ELSE 'unmapped' END AS status, CASE WHEN n_chars = length(text) THEN 'equal' ELSE 'missing' END AS verdict FROM documents)
SELECT tag, count(*) FILTER (verdict = 'equal' AND status <> 'unmapped') AS correct, count(*) FILTER (NOT (verdict = 'equal' AND status <> 'unmapped') AND status <> 'mapped') AS flagged, count(*) FILTER (NOT (verdict = 'equal' AND status <> 'unmapped') AND status = 'mapped') AS silent FROM t GROUP BY tag""")
def outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right, marked and silently wrong results by tag."""
    n = F.length("text")
    status = F.when(n > 800, "mapped").when(n > 300, "uncertain").otherwise("unmapped")
    verdict = F.when(F.col("n_chars") == n, "equal").otherwise("missing")
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("k"), (F.col("doc_id") % 5).cast("string")).alias("tag"), structure.outcome(status, verdict).alias("o"))
    return rows.groupBy("tag").agg(*(F.count_if(F.col("o") == o).alias(o) for o in ("correct", "flagged", "silent")))


@query("""
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT coalesce(o_totalprice > 0, false) THEN 'price' END, CASE WHEN NOT coalesce(o_orderstatus IN ('O', 'F'), false) THEN 'status' END,
       CASE WHEN NOT coalesce(regexp_matches(o_orderpriority, '^[1-5]-'), false) THEN 'priority' END, CASE WHEN NOT coalesce(o_orderdate < TIMESTAMP '1998-01-01', false) THEN 'date' END], lambda x: x IS NOT NULL), ',') AS broken FROM orders""")
def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that each order breaks."""
    rules = {"price": F.col("o_totalprice") > 0, "status": F.col("o_orderstatus").isin("O", "F"), "priority": F.col("o_orderpriority").rlike("^[1-5]-"), "date": F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")}
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(violations(rules), ",").alias("broken"))


@query(f"""
WITH plan AS ({relations.ORACLE_SQL["chunk_plan"].strip()}), {SENTENCES_SQL.strip()},
n AS (SELECT p.doc_id, p.chunk, s.pos, s.text, CASE WHEN s.pos < p.first THEN 'before' WHEN s.pos > p.last THEN 'behind' ELSE 'target' END AS part FROM plan p JOIN sentences s ON p.doc_id = s.doc_id AND s.pos BETWEEN p.first - 2 AND p.last + 2)
SELECT doc_id, 'chunk_' || lpad(CAST(chunk + 1 AS VARCHAR), 4, '0') AS id, sha256(string_agg(text, chr(10) ORDER BY pos) FILTER (part = 'target')) AS targets, count(*) FILTER (part = 'before') AS before, count(*) FILTER (part = 'behind') AS behind FROM n GROUP BY doc_id, chunk""")
def chunk_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chunk is asked with: a digest of its own lines, and how many neighbours it is shown on either side."""
    plan = relations.chunk_plan(spark, sf_dir)
    wide = plan.select("doc_id", "chunk", "first", "last", F.explode(F.sequence(F.greatest(F.col("first") - 2, F.lit(0)), F.col("last") + 2)).alias("pos"))
    shown = wide.join(sentences(spark, sf_dir).select("doc_id", "pos", "text"), ["doc_id", "pos"])
    before, behind = F.col("pos") < F.col("first"), F.col("pos") > F.col("last")
    own = F.array_sort(F.collect_list(F.when(~before & ~behind, F.struct("pos", "text"))))
    grouped = shown.groupBy("doc_id", "chunk").agg(own.alias("own"), F.count_if(before).alias("before"), F.count_if(behind).alias("behind"))
    name = F.concat(F.lit("chunk_"), F.lpad((F.col("chunk") + 1).cast("string"), 4, "0"))
    return grouped.select("doc_id", name.alias("id"), F.sha2(F.array_join(F.transform("own", lambda x: x["text"]), "\n"), 256).alias("targets"), "before", "behind")


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value, ts, event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM events)
SELECT user_id, day, count(*) AS events, count(*) FILTER (spent <= 4000) AS within, min(ts) FILTER (spent > 4000) AS passed_at FROM d GROUP BY user_id, day""")
def spending_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's values pass a limit on a day."""
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("spent", F.sum(F.round(F.col("value") * 100).cast("long")).over(w))
    return rows.groupBy("user_id", "day").agg(F.count("*").alias("events"), F.count_if(F.col("spent") <= 4000).alias("within"), F.min(F.when(F.col("spent") > 4000, F.col("ts"))).alias("passed_at"))


@query("""
WITH c AS (SELECT c_mktsegment AS segment, c_custkey, c_nationkey FROM customer), o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY o_custkey)
SELECT segment, n_name AS nation, count(*) AS papers, count(o_custkey) AS with_results, max(last) AS updated FROM c JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON c_custkey = o_custkey GROUP BY segment, n_name""")
def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of each shelf, those that have results, and the newest of them: customers as papers, orders as results."""
    results = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    papers = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    both = papers.join(results, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")).agg(F.count("*").alias("papers"), F.count("o_custkey").alias("with_results"), F.max("last").alias("updated"))
