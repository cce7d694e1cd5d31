"""Queries of event logs, generated results and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode
from ..operators import checks, events, normalize, resolve
from ..sources import documents
from ..streaming import events as streams
from .tables import read, trimmed_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS granted_as FROM events WHERE event_type = 'click')
SELECT user_id, CAST(ts AS DATE) AS day, event_id, granted_as FROM r WHERE granted_as <= 2""")
def granted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clicks that a budget of two for each user and day covers."""
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'").withColumn("day", F.to_date("ts"))
    return events.granted(clicks, ["user_id", "day"], ["ts", "event_id"], 2).select("user_id", "day", "event_id", "granted_as")


@query("SELECT user_id, event_type, least(count(*), 12) AS used, greatest(count(*) - 12, 0) AS refused, count(*) >= 12 AS exhausted FROM events GROUP BY user_id, event_type")
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is used and refused of a budget of twelve for each user and type."""
    return events.budgets(read(spark, sf_dir, "events"), ["user_id", "event_type"], 12)


@query("""
WITH i AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM events),
l AS (SELECT user_id, max(item) AS item FROM i GROUP BY user_id)
SELECT i.user_id, i.item, string_agg(event_type, '>' ORDER BY ts, event_id) AS text FROM i JOIN l ON i.user_id = l.user_id AND i.item = l.item GROUP BY i.user_id, i.item""")
def recorded_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user has done since the last signup."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = read(spark, sf_dir, "events").withColumn("item", F.count_if(F.col("event_type") == "signup").over(w))
    return events.recorded(rows, ["user_id"], "item", ["ts", "event_id"], "event_type", ">")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total,
       CAST(floor(100 * count(*) FILTER (event_type = 'purchase') / count(*)) AS BIGINT) AS percent, arg_max(event_type, ROW(ts, event_id)) <> 'error' AS running FROM events GROUP BY user_id""")
def process_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's events lead to."""
    t = F.col("event_type")
    return events.progress(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], t == "purchase", t == "error", t == "error")


@query("""
WITH n AS (SELECT min(ts) + INTERVAL 12 HOUR AS now FROM events)
SELECT user_id, coalesce(max(ts) FILTER (value >= 20 AND ts > now), min(ts) FILTER (ts > now)) + INTERVAL 60 SECOND AS resume FROM events, n GROUP BY user_id""")
def quota_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's last full window ends, or else the next one."""
    rows = read(spark, sf_dir, "events")
    now = rows.agg((F.min("ts") + F.expr("INTERVAL 12 HOURS")).alias("now"))
    return events.resume_at(rows.crossJoin(F.broadcast(now)), ["user_id"], "value", "ts", F.col("now"), 20.0)  # one row


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase FROM events""")
def carried_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last purchase before each event."""
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return events.carried(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], value, "purchase").select("event_id", "user_id", "purchase")


@query("""
WITH l AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(before) AS pairs, count(*) FILTER (value < before) AS inversions FROM l GROUP BY user_id""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a value is less than the one before it."""
    return events.out_of_order(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


LATEST_SQL = "SELECT user_id, arg_max(event_type, ROW(ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, ROW(ts, event_id)) AS event_id FROM events GROUP BY user_id"


@query(LATEST_SQL)
def latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    return resolve.last_by(read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query(LATEST_SQL)
def stream_latest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, from the stream."""
    stream = _stream(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    return streams.drained(spark, streams.latest(stream, ["user_id"], ["ts", "event_id"]), ["user_id"], "update")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS \"from\", count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type and hour, from the stream."""
    stream = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = streams.windowed(stream, "ts", ["event_type"], "1 hour", "1 day")
    return streams.drained(spark, counted, ["event_type", "from"], "update").withColumn("from", F.col("from").cast("timestamp_ntz"))


@query("""
SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS units, count(*) FILTER (l_discount > 0) AS discounted, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS BIGINT) AS returned, l_suppkey FROM lineitem GROUP BY l_suppkey""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in which the unknown counts as nothing, and stays unknown where all is."""
    units = F.col("l_quantity")
    sums = [F.count("*").alias("n"), F.sum(units).cast("long").alias("units"), F.count_if(F.col("l_discount") > 0).alias("discounted"), F.sum(F.when(F.col("l_returnflag") == "R", units)).cast("long").alias("returned")]
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*sums)


@query("""
SELECT event_id, CASE WHEN props IS NULL THEN 'not_found' WHEN json_valid(props) THEN CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'schema_mismatch' ELSE 'ok' END ELSE 'invalid_json' END AS state,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, sha256('{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}') AS canonical FROM events""")
def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event's properties can be read, what they hold, and the digest of their canonical form."""
    raw = F.col("props")
    return read(spark, sf_dir, "events").select("event_id", documents.read_state(raw, "k int").alias("state"), F.from_json(raw, "k int")["k"].alias("k"), F.sha2(documents.canonical(raw), 256).alias("canonical"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, source, result: each turn and the next, with the turns around as neighbours."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations")
    near = F.array_compact(F.array(F.lag("text").over(w), F.lead("text", 2).over(w)))
    return rows.select("conv_id", "turn", F.col("text").alias("source"), F.lead("text").over(w).alias("result"), near.alias("near")).where("result is not null")


@query(r"""
WITH a AS (SELECT conv_id, turn, text AS source, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS result FROM conversations),
n AS (SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(source, '[0-9]+(?:[.,][0-9]+)*')), lambda x: NOT list_contains(regexp_extract_all(result, '[0-9]+(?:[.,][0-9]+)*'), x))) AS missing, result, source FROM a WHERE result IS NOT NULL)
SELECT conv_id, turn, CAST(CASE WHEN SOURCE_TRIMMED <> '' AND RESULT_TRIMMED = '' THEN 1 ELSE 0 END AS BIGINT) AS fatal, CAST(missing AS BIGINT) AS warnings, NOT (SOURCE_TRIMMED <> '' AND RESULT_TRIMMED = '') AS ok FROM n""".replace("SOURCE_TRIMMED", trimmed_sql("source")).replace("RESULT_TRIMMED", trimmed_sql("result")))
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's answer against the turn: placeholders, citations, URLs, numbers, neighbours."""
    key = ["conv_id", "turn"]
    rows = _answers(spark, sf_dir).withColumn("markers", F.regexp_extract_all("source", F.lit(r"\[\d+\]"), 0))
    issues = checks.all_issues(
        checks.not_empty(rows, key, "source", "result"), checks.placeholders_kept(rows, key, "source", "result"), checks.citations_kept(rows, key, "markers", "result"),
        checks.urls_known(rows, key, "source", "result"), checks.numbers_kept(rows, key, "source", "result"), checks.neighbours_kept_out(rows, key, "source", "result", "near"),
    )
    return checks.verdicts(rows, key, issues)


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '\s+', ' ', 'g')) AS normalized, CAST(length(text) AS INTEGER) AS raw_end FROM documents WHERE text IS NOT NULL""")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts, and where their whole stretch comes from."""
    both = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", normalize.normalized_with_map(F.col("text")).alias("n"))
    whole = normalize.raw_range(F.col("n.segments"), F.lit(0), F.length("n.text"))
    return both.select("doc_id", F.sha2("n.text", 256).alias("normalized"), whole["end"].alias("raw_end"))


@query("""
SELECT l_shipmode_year AS year, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, CAST(floor(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*)) AS BIGINT) AS percent
FROM (SELECT year(l_shipdate) AS l_shipmode_year, l_returnflag FROM lineitem) GROUP BY l_shipmode_year""")
def yearly_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and returned lines of each year."""
    n, r = F.count("*"), F.count_if(F.col("l_returnflag") == "R")
    return read(spark, sf_dir, "lineitem").groupBy(T.year_of("l_shipdate").cast("long").alias("year")).agg(n.alias("lines"), r.alias("returned"), F.floor(100 * r / n).alias("percent"))


@query("""
WITH i AS (SELECT conv_id, turn, '{"turn":' || turn || ',"role":"' || role || '"}' AS item FROM conversations),
l AS (SELECT conv_id, sum(length(item) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS past FROM i),
n AS (SELECT conv_id, count(*) AS items, max(past) AS whole FROM l GROUP BY conv_id)
SELECT l.conv_id, max(items) AS items, count(*) FILTER (12 + past <= (12 + whole + 2) * 3 // 5) AS saved FROM l JOIN n ON l.conv_id = n.conv_id GROUP BY l.conv_id""")
def salvaged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON that breaks off after three fifths: the turns that can be saved."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    items = F.transform(turns, lambda t: F.to_json(F.struct(t["turn"].alias("turn"), t["role"].alias("role"))))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(items.alias("items"))
    whole = F.concat(F.lit('{"results":['), F.array_join("items", ","), F.lit("]}"))
    cut = rows.select("conv_id", "items", F.substring(whole, F.lit(1), F.floor(F.length(whole) * 3 / 5).cast("int")).alias("raw"))
    return cut.select("conv_id", F.size("items").cast("long").alias("items"), F.size(documents.salvaged(F.col("raw"), "results")).cast("long").alias("saved"))


@query(r"SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS INTEGER) AS key_characters FROM documents")
def key_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of every document that count when spans are compared."""
    return read(spark, sf_dir, "documents").select("doc_id", unicode.key_characters(F.col("text")).alias("key_characters"))


@query(r"""
WITH c AS (SELECT conv_id, turn, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM conversations WHERE text <> ''),
e AS (SELECT *, CASE WHEN c IN ('"', '\', chr(8), chr(9), chr(10), chr(12), chr(13)) THEN 2 WHEN ascii(c) < 32 THEN 6 ELSE 1 END AS size FROM c),
u AS (SELECT conv_id, turn, sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER w0 AS total FROM e WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i), w0 AS (PARTITION BY conv_id, turn)),
n AS (SELECT conv_id, turn, count(*) FILTER (upto <= (total + 18) // 2 - 16) AS shown FROM u GROUP BY conv_id, turn)
SELECT t.conv_id, t.turn, CAST(coalesce(shown, 0) AS INTEGER) AS shown, CASE WHEN text IS NOT NULL THEN true END AS as_written FROM conversations t LEFT JOIN n ON t.conv_id = n.conv_id AND t.turn = n.turn""")
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each turn can be shown while half of its JSON has come in."""
    whole = F.to_json(F.struct(F.col("text").alias("explanation")))
    half = F.substring(whole, F.lit(1), (F.length(whole) / 2).cast("int"))
    shown = unicode.streamed_field(half, "explanation")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(shown).alias("shown"), F.startswith("text", shown).alias("as_written"))
