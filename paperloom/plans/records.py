"""Queries of records that a run leaves behind: events as files, order lines as cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from .tables import read

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query("""
WITH f AS (SELECT 'u' || user_id AS unit, 'tr_' || event_id AS job, CAST(event_id % 4 AS INTEGER) AS attempt, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS started_at, 'h' || event_id % 3 AS input_hash, CASE WHEN event_id % 5 <> 0 THEN 'text ' || event_id ELSE '' END AS text
  FROM events WHERE event_type IN ('view', 'click') AND event_id % 9 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 10 <> 9 AND user_id IS NOT NULL)
SELECT unit, CAST(row_number() OVER (PARTITION BY unit ORDER BY attempt, started_at, job) AS INTEGER) AS place, job, attempt, started_at, input_hash, 'a,b' AS targets, text FROM f""")
def inflight_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests under way of one stage: some records are cut off, of another job, or of other types, and some aren't records."""
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").where("user_id is not null")
    job = F.concat(F.lit("tr_"), k.cast("string"))
    stage = F.when(F.col("event_type").isin("view", "click"), "translate").otherwise("context")
    attempt = F.when(k % 11 == 0, F.concat(F.lit('"'), (k % 4).cast("string"), F.lit('x"'))).otherwise((k % 4).cast("string"))
    fields = [F.lit('{"version":1,"jobId":"'), F.when(k % 7 == 0, "tr_other").otherwise(job), F.lit('","stage":"'), stage, F.lit('","unitId":"u'), F.col("user_id").cast("string"), F.lit('","attempt":'), attempt]
    fields += [F.lit(',"startedAt":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","inputHash":"h'), (k % 3).cast("string"), F.lit('","targetIds":["a","b"]'), F.when(k % 9 == 0, "").otherwise("}")]
    metas = rows.select(F.concat(job, F.when(k % 10 == 9, ".meta.bak").otherwise(records.SUFFIX)).alias("name"), F.concat(*fields).alias("content"))
    texts = rows.where(k % 5 != 0).select(F.concat(job, F.lit(".txt")).alias("name"), F.concat(F.lit("text "), k.cast("string")).alias("content"))
    return records.inflight(metas.unionByName(texts), "translate").withColumn("targets", F.array_join("targets", ","))


@query("""
WITH e AS (SELECT event_id, ['started', 'state', 'plan', 'chunk_started', 'chunk_finished', 'finished', 'other'][CAST(event_id % 7 + 1 AS INTEGER)] AS kind, CAST(event_id % 4 AS INTEGER) AS total, CAST(event_id % 3 AS INTEGER) AS done, CAST(event_id % 2 AS INTEGER) AS failed FROM events)
SELECT event_id, CASE kind WHEN 'chunk_started' THEN 'chunkStarted' WHEN 'chunk_finished' THEN 'chunkFinished' ELSE kind END AS shown, CASE WHEN kind = 'plan' THEN total WHEN kind IN ('chunk_started', 'chunk_finished', 'finished') THEN total END AS shown_total,
  CASE WHEN kind IN ('chunk_finished', 'finished') THEN done END AS shown_completed, CASE WHEN kind IN ('chunk_finished', 'finished') THEN failed END AS shown_failed FROM e WHERE kind NOT IN ('started', 'other')""")
def shown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run as they are shown, with their counts."""
    k = F.col("event_id")
    kinds = F.array(*map(F.lit, ["started", "state", "plan", "chunk_started", "chunk_finished", "finished", "other"]))
    rows = read(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (k % 7 + 1).cast("int")).alias("kind"))
    counts = [(k % n).cast("int") for n in (4, 3, 2)]
    out = records.shown(rows, "kind", F.array_repeat(F.lit("c"), counts[0]), counts[1], counts[2], counts[0])
    return out.drop("kind")


@query("SELECT sha256(url) AS name FROM pages WHERE page_id % 3 = 0")
def paper_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that are named as papers are: digests, some of them cut off or in capitals."""
    k, digest = F.col("page_id") % 3, F.sha2("url", 256)
    names = read(spark, sf_dir, "pages").select(F.when(k == 0, digest).when(k == 1, F.upper(F.concat(F.lit("a"), F.substring(digest, 2, 63)))).otherwise(F.substring(digest, 1, 63)).alias("name"))
    return records.paper_folders(names, "name")


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS researched, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY l_linestatus")
def research_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cards were researched, and from how many sources: order lines as cards."""
    return records.research_counts(read(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_returnflag") == "R", "l_suppkey")
