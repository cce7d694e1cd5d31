"""Queries whose rows depend on all rows before them: ledgers and runs of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attempts, ledger, progress, recover, resources
from ..streaming import events as streams
from ..streaming import ledger as streamed_ledger
from ..streaming import progress as streamed_progress
from .tables import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


#: Limits of a week and of a user's whole time: searches, fetches, calls of tools.
WEEK, ALWAYS = [1, 1, 2], [3, 3, 6]


def operations(events: DataFrame) -> DataFrame:
    """Events as operations on the ledger of their user: views and clicks reserve the week's search or fetch, signups call tools, purchases and errors move a reservation on."""
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    t, even = F.col("event_type"), F.col("event_id") % 2 == 0
    kind = F.when(t == "view", "search").when(t == "click", "fetch").otherwise(F.when(even, "search").otherwise("fetch"))
    op = (
        F.when(t.isin("view", "click"), "reserve").when(t == "signup", "tool").when(t == "purchase", F.when(F.col("value") < 10, "sent").otherwise("succeeded"))
        .otherwise(F.when(F.col("event_id") % 4 == 0, "open").otherwise("failed"))
    )
    limits = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    scopes = F.array(F.struct(week.alias("id"), limits(WEEK).alias("limits")), F.struct(F.lit("always").alias("id"), limits(ALWAYS).alias("limits")))
    return events.where("user_id is not null").select(
        F.col("user_id").alias("ledger"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), op.alias("op"), kind.alias("kind"), F.concat_ws(":", week, kind).alias("request"), scopes.alias("scopes")
    )


def _room(kind: int) -> str:
    return f"if(same_week, week[{kind}], 0) < {WEEK[kind - 1]} AND always[{kind}] < {ALWAYS[kind - 1]}"


#: One step of the recursion for each operation of a ledger.
LEDGER_SQL = f"""
WITH RECURSIVE e AS (
  SELECT user_id AS ledger, event_id AS seq, event_type AS t, value, strftime(date_trunc('week', ts), '%Y-%m-%d') AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END END AS k FROM events WHERE user_id IS NOT NULL),
o AS (
  SELECT *, w || ':' || ['search', 'fetch'][k] AS request,
         CASE WHEN t IN ('view', 'click') THEN 'reserve' WHEN t = 'signup' THEN 'tool' WHEN t = 'purchase' THEN if(value < 10, 'sent', 'succeeded') WHEN seq % 4 = 0 THEN 'open' ELSE 'failed' END AS op FROM e),
r AS (
  SELECT DISTINCT ledger, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS w, [0, 0, 0] AS week, [0, 0, 0] AS always, CAST([] AS VARCHAR[]) AS reserved, CAST([] AS VARCHAR[]) AS sent,
         CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS scope, CAST(NULL AS VARCHAR) AS state, CAST([] AS VARCHAR[]) AS recovered FROM o
  UNION ALL
  SELECT ledger, n, w,
         list_transform(if(same_week, week, [0, 0, 0]), lambda x, i: x + if(granted AND i = kk, 1, 0)), list_transform(always, lambda x, i: x + if(granted AND i = kk, 1, 0)),
         CASE WHEN op = 'open' THEN [] WHEN op = 'reserve' AND granted THEN list_append(reserved, request) WHEN op IN ('sent', 'succeeded', 'failed') THEN list_filter(reserved, lambda x: x <> request) ELSE reserved END,
         CASE WHEN op = 'open' THEN [] WHEN op = 'sent' AND (is_reserved OR is_sent) THEN list_distinct(list_append(sent, request)) WHEN op IN ('succeeded', 'failed') THEN list_filter(sent, lambda x: x <> request) ELSE sent END,
         CASE WHEN op IN ('reserve', 'tool') THEN CASE WHEN granted THEN '{ledger.GRANTED}' WHEN op = 'tool' THEN '{ledger.TOOLS_EXHAUSTED}' ELSE '{ledger.EXHAUSTED}' END
              WHEN op = 'open' THEN 'recovered' WHEN NOT is_reserved AND NOT is_sent THEN '{ledger.NOT_OPEN}' WHEN op = 'sent' THEN if(is_reserved, 'sent', 'unchanged') ELSE 'closed' END,
         CASE WHEN op NOT IN ('reserve', 'tool') THEN NULL WHEN granted OR week_full THEN w ELSE 'always' END,
         CASE WHEN op = 'reserve' AND granted THEN '{ledger.RESERVED}' WHEN op = 'open' THEN '{ledger.UNKNOWN}' WHEN op IN ('sent', 'succeeded', 'failed') AND (is_reserved OR is_sent) THEN op END,
         CASE WHEN op = 'open' THEN list_concat(reserved, sent) ELSE [] END
  FROM (SELECT *, CASE kk WHEN 1 THEN {_room(1)} WHEN 2 THEN {_room(2)} ELSE {_room(3)} END AND op IN ('reserve', 'tool') AS granted, if(same_week, week[kk], 0) >= {WEEK}[kk] AS week_full
        FROM (SELECT o.*, r.week, r.always, r.reserved, r.sent, coalesce(r.w = o.w, false) AS same_week, if(o.op = 'tool', 3, o.k) AS kk, list_contains(r.reserved, o.request) AS is_reserved, list_contains(r.sent, o.request) AS is_sent
              FROM r JOIN o ON o.ledger = r.ledger AND o.n = r.n + 1)))
SELECT r.ledger, seq, request, code, scope, state FROM r JOIN o ON r.ledger = o.ledger AND r.n = o.n WHERE op <> 'open'
UNION ALL
SELECT ledger, seq, unnest(recovered) AS request, code, scope, state FROM (SELECT r.*, o.seq FROM r JOIN o ON r.ledger = o.ledger AND r.n = o.n WHERE op = 'open')"""


@query(LEDGER_SQL)
def scoped_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's budget of the week and of all time, together, make of every operation."""
    return ledger.folded(operations(read(spark, sf_dir, "events")))


@query(LEDGER_SQL)
def stream_scoped_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stream of events, with the ledgers as keyed state."""
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    with streams.state_in_rocksdb(spark):
        return streams.drained(spark, streamed_ledger.folded(operations(stream)), ["ledger", "seq", "request"], "append")


@query(f"""
WITH decisions AS ({LEDGER_SQL}),
s AS (SELECT d.*, event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS w FROM decisions d JOIN events ON seq = event_id WHERE code = '{ledger.GRANTED}')
SELECT ledger, scope, count(*) FILTER (event_type = 'view') AS search, count(*) FILTER (event_type = 'click') AS fetch, count(*) FILTER (event_type = 'signup') AS tool
FROM (SELECT ledger, w AS scope, event_type FROM s UNION ALL SELECT ledger, 'always', event_type FROM s) GROUP BY ALL""")
def scope_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each scope has granted, by kind."""
    return ledger.usage(operations(read(spark, sf_dir, "events")))


OUTCOMES = [attempts.OK, attempts.INVALID, attempts.SHAPE, "timeout", "invalid_json", attempts.INVALID, "quota", attempts.INVALID]
_STOPS = ", ".join(f"'{x}'" for x in attempts.STOPS)
_MENDED = ", ".join(f"'{x}'" for x in [attempts.SHAPE, attempts.INVALID, *attempts.REPAIRS])


@query(f"""
WITH RECURSIVE c AS (
  SELECT o_orderkey, list_sort(list(DISTINCT CAST(l_linenumber AS BIGINT))) AS targets, any_value(o_orderstatus) AS st, any_value(o_orderpriority) AS pr FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
k AS (
  SELECT *, st = 'F' AND o_orderkey % 4 = 0 AS reusable, CASE WHEN st = 'O' AND o_orderkey % 3 = 0 THEN list_filter(targets, lambda x: x % 2 = 0) ELSE [] END AS kept,
         CASE WHEN pr = '1-URGENT' THEN list_filter(targets, lambda x: x <= o_orderkey % 4) ELSE [] END AS salvaged, pr = '1-URGENT' AS written FROM c),
i AS (SELECT *, list_filter(targets, lambda x: list_contains(kept, x) OR list_contains(salvaged, x)) AS known FROM k),
a AS (SELECT o_orderkey, n, {OUTCOMES}[CAST((o_custkey + 3 * n) % 8 + 1 AS INTEGER)] AS outcome FROM orders, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE n <= o_orderkey % 6),
r AS (
  SELECT o_orderkey, 0 AS n, CASE WHEN reusable OR len(known) = len(targets) THEN 'save' WHEN len(known) > 0 OR written THEN 'resume' ELSE 'initial' END AS ask,
         CASE WHEN len(known) > 0 OR written THEN list_filter(targets, lambda x: NOT list_contains(known, x)) ELSE targets END AS asked, CAST(NULL AS BIGINT[]) AS second,
         CASE WHEN reusable THEN [] ELSE list_filter(targets, lambda x: NOT list_contains(known, x)) END AS rest, 0 AS repairs,
         CASE WHEN reusable THEN 'reuse' ELSE CASE WHEN len(list_filter(salvaged, lambda x: NOT list_contains(kept, x))) > 0 THEN 'salvage>' ELSE '' END || CASE WHEN len(known) = len(targets) THEN 'save' WHEN len(known) > 0 OR written THEN 'resume' ELSE 'initial' END END AS path,
         0 AS requests, CAST(NULL AS VARCHAR) AS outcome FROM i
  UNION ALL
  SELECT o_orderkey, n, new_ask, CASE WHEN new_ask = 'repair' THEN now WHEN whole THEN now[1:half] ELSE second END, CASE WHEN new_ask = 'split' AND whole AND len(now) > 1 THEN now[half + 1:] END, now, repairs + if(new_ask = 'repair', 1, 0), path || '>' || new_ask, requests + 1, o
  FROM (SELECT *, CAST(ceil(len(now) / 2.0) AS INTEGER) AS half, CASE WHEN len(now) = 0 OR o IN ({_STOPS}) THEN 'save' WHEN whole AND o IN ({_MENDED}) AND repairs < 1 THEN 'repair' WHEN whole OR second IS NOT NULL THEN 'split' ELSE 'save' END AS new_ask
        FROM (SELECT r.o_orderkey, r.second, r.repairs, r.path, r.requests, a.n, a.outcome AS o, r.ask <> 'split' AS whole,
                     list_filter(r.rest, lambda x: NOT (list_contains(r.asked, x) AND (a.outcome = 'ok' OR a.outcome <> 'quota' AND (x + a.n) % 3 = 0))) AS now FROM r JOIN a ON r.o_orderkey = a.o_orderkey AND a.n = r.n + 1 WHERE r.ask <> 'save'))),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC) = 1)
SELECT l.o_orderkey, path, CAST(requests AS INTEGER) AS requests, CAST(CASE WHEN reusable THEN 0 ELSE len(known) END AS INTEGER) AS recovered, CAST(len(rest) AS INTEGER) AS "left",
       CASE WHEN reusable THEN 'reused' WHEN ask <> 'save' THEN 'open' WHEN len(rest) > 0 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN ask <> 'save' THEN ask END AS next,
       CASE WHEN ask <> 'save' THEN array_to_string(asked, ',') END AS targets, CASE WHEN ask = 'save' AND len(rest) > 0 THEN CASE WHEN outcome IN ('ok', 'validation_failed') THEN 'chunk_validation' WHEN outcome = 'output_shape' THEN 'chunk_output_shape' ELSE 'llm_' || outcome END END AS code
FROM l JOIN i ON l.o_orderkey = i.o_orderkey""")
def chunk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks, their lines as targets: how far the attempts have brought each, and what it asks for next."""
    orders, line = read(spark, sf_dir, "orders"), F.col("l_linenumber").cast("long")
    targets = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(line)).alias("targets"))
    key, urgent = F.col("o_orderkey"), F.col("o_orderpriority") == "1-URGENT"
    empty = F.array().cast("array<bigint>")
    chunks = orders.join(targets, "o_orderkey").select(
        "o_orderkey", "targets", ((F.col("o_orderstatus") == "F") & (key % 4 == 0)).alias("reusable"),
        F.when((F.col("o_orderstatus") == "O") & (key % 3 == 0), F.filter("targets", lambda x: x % 2 == 0)).otherwise(empty).alias("kept"),
        F.when(urgent, F.filter("targets", lambda x: x <= key % 4)).otherwise(empty).alias("salvaged"), urgent.alias("written"),
    )
    numbered = orders.select("o_orderkey", "o_custkey", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("number")).where("number <= o_orderkey % 6")
    outcome = F.element_at(F.array(*map(F.lit, OUTCOMES)), ((F.col("o_custkey") + 3 * F.col("number")) % 8 + 1).cast("int"))
    lines = F.array(*(F.lit(n).cast("long") for n in range(1, 8)))
    accepted = F.when(F.col("outcome") == attempts.OK, lines).when(F.col("outcome") == "quota", empty).otherwise(F.filter(lines, lambda x: (x + F.col("number")) % 3 == 0))
    log = numbered.withColumn("outcome", outcome).select("o_orderkey", "number", "outcome", accepted.alias("accepted"))
    return attempts.runs(chunks, log, "o_orderkey").withColumn("targets", F.array_join("targets", ","))


_FILES_SQL = """
l AS (SELECT source, doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 7 <> 0),
f AS (SELECT source, doc_id, sha256(text) AS found, 2 AS made, source <> 'src3' AND doc_id % 17 <> 0 AS sound FROM documents WHERE doc_id % 5 <> 0
  UNION ALL SELECT source, doc_id, sha256(text || 'old'), 1, true FROM documents WHERE doc_id % 6 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY made DESC, found DESC) AS nth FROM f),
o AS (
  SELECT coalesce(l.source, n.source) AS source, coalesce(l.doc_id, n.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN CASE WHEN sound THEN 'adopted' ELSE 'discarded' END
         WHEN n.doc_id IS NULL THEN 'missing' WHEN hash IS NULL THEN 'no_hash' WHEN hash <> found THEN 'hash_mismatch' ELSE 'kept' END AS outcome, coalesce(found, hash) AS hash
  FROM l FULL JOIN (SELECT * FROM n WHERE nth = 1) n ON l.source = n.source AND l.doc_id = n.doc_id
  UNION ALL SELECT source, doc_id, 'superseded', found FROM n WHERE nth > 1)"""


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: most of them listed, some with another hash or none, some lost, some with an older copy."""
    docs, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    digest = lambda more: F.sha2(F.concat("text", F.lit(more)), 256)
    listed = docs.where(k % 7 != 0).select("source", "doc_id", F.when(k % 13 == 0, None).when(k % 11 == 0, digest("x")).otherwise(digest("")).alias("hash"))
    files = docs.where(k % 5 != 0).select("source", "doc_id", digest("").alias("hash"), F.lit(2).alias("written_at"), ((F.col("source") != "src3") & (k % 17 != 0)).alias("whole"))
    older = docs.where(k % 6 == 0).select("source", "doc_id", digest("old").alias("hash"), F.lit(1).alias("written_at"), F.lit(True).alias("whole"))
    return recover.reconciled(listed, files.unionByName(older), ["source", "doc_id"], F.col("whole"))


@query(f"WITH {_FILES_SQL} SELECT source, doc_id, outcome, hash FROM o")
def recovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every listed file and every file that is there."""
    return _recovered(spark, sf_dir).drop("written_at")


@query(f"""
WITH {_FILES_SQL}, s AS (SELECT DISTINCT source, CASE WHEN source LIKE '%1' THEN 'researching' ELSE 'translating' END AS state FROM documents),
c AS (SELECT source, {", ".join(f"count(*) FILTER (outcome = '{x}') AS {x}" for x in ("kept", "missing", "hash_mismatch", "no_hash", "adopted", "discarded", "superseded"))} FROM o GROUP BY source)
SELECT s.source, state, kept, missing, hash_mismatch, no_hash, adopted, discarded, superseded, replace(state, 'researching', 'context_pending') AS state_after,
       state = 'researching' OR missing + hash_mismatch + no_hash + adopted + discarded + superseded > 0 AS changed FROM s JOIN c ON s.source = c.source""")
def recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each source came to what, and the state that it goes on from."""
    state = F.when(F.col("source").endswith("1"), "researching").otherwise("translating").alias("state")
    return recover.report(_recovered(spark, sf_dir), ["source"], read(spark, sf_dir, "documents").select("source", state).distinct())


@query("""
WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT q.event_id, q.user_id, arg_max(r.event_id, ROW(r.ts, r.event_id)) AS result_id FROM q LEFT JOIN r ON q.user_id = r.user_id AND r.ts <= q.ts AND r.ts > q.ts - INTERVAL 1 DAY GROUP BY q.event_id, q.user_id""")
def fresh_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each signup the last purchase of the same user within a day before."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    requests, results = rows.where("event_type = 'signup'").drop("event_type"), rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("result_id"))
    return resources.latest_within(requests, results, ["user_id"], "ts", 86400).select("event_id", "user_id", F.col("result.result_id").alias("result_id"))


@query(f"""
WITH u AS (SELECT page_id, CASE page_id % 10 WHEN 4 THEN 'https://www.youtube.com/watch?v=' || page_id % 50 WHEN 5 THEN 'https://www.youtube.com/shorts' WHEN 6 THEN 'http://localhost/x' WHEN 7 THEN 'https://a.example.org/search?q=1' ELSE url END AS url, regexp_extract(url, '/(fr|en|de|es)/', 1) AS lang FROM pages),
c AS (SELECT lang, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS url, page_id FROM u WHERE page_id % 3 <> 2 AND page_id % 10 NOT IN (5, 6, 7)),
o AS (SELECT lang, url, min(page_id) AS page_id FROM c GROUP BY lang, url)
SELECT lang, url, page_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY page_id) AS INTEGER) AS place FROM o QUALIFY place <= {resources.MOST}""")
def preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six verified pages and videos to prepare with in each language."""
    k = F.col("page_id")
    own = F.element_at(F.array(*map(F.lit, ["https://www.youtube.com/watch?v=", "https://www.youtube.com/shorts", "http://localhost/x", "https://a.example.org/search?q=1"])), F.greatest(k % 10 - 3, F.lit(1)).cast("int"))
    url = F.when((k % 10).between(4, 7), F.concat(own, F.when(k % 10 == 4, (k % 50).cast("string")).otherwise(""))).otherwise(F.col("url"))
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "/(fr|en|de|es)/", 1).alias("lang"), T.normalized_url(url).alias("address"), "page_id").withColumnRenamed("address", "url")
    return resources.chosen(pages, ["lang"], "url", ["page_id"], F.col("page_id") % 3 != 2)


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL")
def stream_first_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user asks for on a day, once, from the stream."""
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").where("user_id is not null")
    asked = stream.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.to_date("ts").alias("day"))
    keys = ["user_id", "event_type", "day"]
    return streams.drained(spark, streams.first_requests(asked, "ts", keys, "40 days"), keys, "append")


PROGRESS_SQL = f"""
WITH e AS (SELECT user_id AS unit, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'phase' WHEN 'click' THEN 'chunk_started' WHEN 'purchase' THEN 'chunk_finished' WHEN 'error' THEN 'chunk_failed' ELSE 'note' END AS kind,
  event_id % 5 AS chunk, CASE WHEN event_type IN ('view', 'signup') THEN 'step ' || event_id % 7 END AS text FROM events WHERE user_id IS NOT NULL),
l AS (SELECT unit, chunk, arg_max(kind, ROW(ts, seq)) AS kind FROM e WHERE kind LIKE 'chunk%' GROUP BY unit, chunk),
c AS (SELECT unit, count(*) FILTER (kind = 'chunk_started') AS running, count(*) FILTER (kind = 'chunk_finished') AS done, count(*) FILTER (kind = 'chunk_failed') AS failed FROM l GROUP BY unit),
h AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts DESC, seq DESC) AS nth FROM e)
SELECT h.unit, (SELECT arg_max(text, ROW(ts, seq)) FROM e WHERE e.unit = h.unit AND kind = 'phase') AS phase, coalesce(any_value(running), 0) AS running, coalesce(any_value(done), 0) AS done, coalesce(any_value(failed), 0) AS failed, max(nth) AS events,
  string_agg(kind || coalesce(': ' || text, ''), ', ' ORDER BY nth) FILTER (nth <= {progress.HISTORY}) AS history FROM h LEFT JOIN c ON h.unit = c.unit GROUP BY h.unit"""


def _work(events: DataFrame) -> DataFrame:
    """Events as steps of work on their user: views set a phase, clicks start a chunk, purchases finish one, errors fail one."""
    t, k = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "view", progress.PHASE).when(t == "click", "chunk_started").when(t == "purchase", "chunk_finished").when(t == "error", "chunk_failed").otherwise(progress.NOTE)
    text = F.when(t.isin("view", "signup"), F.concat(F.lit("step "), (k % 7).cast("string")))
    return events.where("user_id is not null").select(F.col("user_id").alias("unit"), F.col("ts").cast("timestamp").alias("at"), k.alias("seq"), kind.alias("kind"), (k % 5).alias("chunk"), text.alias("text"))


@query(PROGRESS_SQL)
def work_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the work on each user has come, with the last twenty entries of its history."""
    return progress.tracked(_work(read(spark, sf_dir, "events"))).withColumn("history", F.array_join("history", ", "))


@query(PROGRESS_SQL)
def stream_work_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stream of events, with what is known of each user as keyed state."""
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    with streams.state_in_rocksdb(spark):
        return streams.drained(spark, streamed_progress.tracked(_work(stream)), ["unit"], "update").withColumn("history", F.array_join("history", ", "))
