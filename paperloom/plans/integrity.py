"""Queries that hold what was generated against what was asked for: lines of documents as sentences, every eight or ten of them as a chunk or section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from .tables import SENTENCES_SQL, read, trimmed_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""
WITH {SENTENCES_SQL},
s AS (SELECT doc_id, pos, CAST(pos AS VARCHAR) AS id, text, pos // 8 AS chunk, pos % 29 <> 1 AS body FROM sentences),
r AS (SELECT doc_id, chunk, pos AS rank, id, CASE WHEN pos % 23 = 4 THEN ' ' ELSE 'ko ' || id END AS text FROM s WHERE pos % 13 <> 7
  UNION ALL SELECT doc_id, chunk + 1, pos, id, 'again' FROM s WHERE pos % 17 = 3 UNION ALL SELECT doc_id, chunk, pos + 1000000, 'x' || id, 'other' FROM s WHERE pos % 19 = 5),
h AS (SELECT doc_id, chunk, list(id ORDER BY rank) AS ids, sha256(string_agg(id || chr(31) || text, chr(30) ORDER BY rank)) AS hash FROM r GROUP BY doc_id, chunk),
c AS (SELECT doc_id, chunk, list(id ORDER BY pos) AS targets, CASE WHEN (doc_id + chunk) % 9 = 0 THEN 'failed' ELSE 'complete' END AS status FROM s GROUP BY doc_id, chunk),
w AS (SELECT c.*, coalesce(h.ids, []) AS ids, (doc_id + chunk) % 7 = 3 AS changed FROM c LEFT JOIN h USING (doc_id, chunk) WHERE status = 'complete'),
m AS (SELECT r.*, s.text AS original, s.id IS NOT NULL AS known, row_number() OVER (PARTITION BY r.doc_id, r.id ORDER BY r.chunk, r.rank) AS nth FROM r JOIN w ON r.doc_id = w.doc_id AND r.chunk = w.chunk LEFT JOIN s ON r.doc_id = s.doc_id AND r.id = s.id)
SELECT doc_id, 'chunk_not_complete' AS code, chunk, CAST(NULL AS VARCHAR) AS id FROM c WHERE status <> 'complete'
UNION ALL SELECT doc_id, 'result_ids_differ_from_targets', chunk, NULL FROM w WHERE ids <> targets UNION ALL SELECT doc_id, 'result_hash_mismatch', chunk, NULL FROM w WHERE changed
UNION ALL SELECT doc_id, 'unknown_sentence', chunk, id FROM m WHERE NOT known UNION ALL SELECT doc_id, 'sentence_in_two_chunks', chunk, id FROM m WHERE known AND nth > 1
UNION ALL SELECT doc_id, 'empty_translation', chunk, id FROM m WHERE known AND nth = 1 AND {trimmed_sql("original")} <> '' AND trim(text) = ''
UNION ALL SELECT doc_id, 'sentence_without_result', NULL, id FROM s WHERE body AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = s.doc_id AND m.id = s.id)""")
def result_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of generated results: some are lost, blank, given twice, of no sentence, or changed after they were hashed, and some chunks aren't complete."""
    pos, key = F.col("pos"), F.col("pos").cast("string")
    s = _lines(spark, sf_dir).select("doc_id", "pos", key.alias("id"), "text", F.floor(pos / 8).alias("chunk"), (pos % 29 != 1).alias("body"))
    results = s.where(pos % 13 != 7).select("doc_id", "chunk", pos.alias("rank"), "id", F.when(pos % 23 == 4, " ").otherwise(F.concat(F.lit("ko "), "id")).alias("text"))
    results = results.unionByName(s.where(pos % 17 == 3).select("doc_id", (F.col("chunk") + 1).alias("chunk"), pos.alias("rank"), "id", F.lit("again").alias("text")))
    results = results.unionByName(s.where(pos % 19 == 5).select("doc_id", "chunk", (pos + 1_000_000).alias("rank"), F.concat(F.lit("x"), "id").alias("id"), F.lit("other").alias("text")))
    stored = results.groupBy("doc_id", "chunk").agg(integrity.results_hash(F.collect_list(F.struct("rank", "id", "text"))).alias("hash"))
    k = F.col("doc_id") + F.col("chunk")
    targets = s.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("t")).select("doc_id", "chunk", F.col("t.id").alias("targets"))
    chunks = targets.join(stored, ["doc_id", "chunk"], "left").select(
        "doc_id", "chunk", F.col("chunk").alias("position"), F.when(k % 9 == 0, "failed").otherwise("complete").alias("status"), "targets",
        F.when(k % 7 == 3, "other").otherwise(F.coalesce("hash", integrity.results_hash(F.array().cast("array<struct<rank:bigint,id:string,text:string>>")))).alias("hash"),
    )
    return integrity.result_problems(chunks, results, s.select("doc_id", "id", "text", "body"), ["doc_id"])


_DIGESTS_SQL = f"""
{SENTENCES_SQL}, s AS (SELECT doc_id, pos // 10 AS section, CAST(pos AS VARCHAR) AS id FROM sentences), o AS (SELECT DISTINCT doc_id, section FROM s),
d AS (SELECT doc_id, 1 AS rank, section, CASE WHEN (doc_id + section) % 9 = 4 THEN ' ' ELSE 'Digest ' || section END AS summary, [section * 10, section * 10 + 3, section * 10 + 12, section * 10] AS e FROM o WHERE (doc_id + section) % 6 <> 2
  UNION ALL SELECT doc_id, 2, section, 'Second', [section * 10] FROM o WHERE (doc_id + section) % 8 = 5 UNION ALL SELECT doc_id, 3, section + 1000, 'Other', [0] FROM o WHERE (doc_id + section) % 10 = 7),
l AS (SELECT d.*, o.section IS NOT NULL AS own, row_number() OVER (PARTITION BY d.doc_id, d.section ORDER BY rank) AS nth FROM d LEFT JOIN o ON d.doc_id = o.doc_id AND d.section = o.section),
f AS (SELECT * FROM l WHERE own AND nth = 1), x AS (SELECT doc_id, section, CAST(unnest(e) AS VARCHAR) AS id, generate_subscripts(e, 1) AS at_ FROM f),
k AS (SELECT x.*, s.id IS NOT NULL AS there FROM x LEFT JOIN s ON x.doc_id = s.doc_id AND x.section = s.section AND x.id = s.id)"""


def _part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _lines(spark, sf_dir).select("doc_id", F.floor(F.col("pos") / 10).alias("section"), F.col("pos").cast("string").alias("id"))
    sections, n = s.select("doc_id", "section").distinct(), F.col("section")
    k = F.col("doc_id") + n
    ids = lambda *of: F.array(*(x.cast("string") for x in of)).alias("evidence")
    digests = sections.where(k % 6 != 2).select("doc_id", F.lit(1).alias("rank"), "section", F.when(k % 9 == 4, " ").otherwise(F.concat(F.lit("Digest "), n.cast("string"))).alias("summary"), ids(n * 10, n * 10 + 3, n * 10 + 12, n * 10))
    digests = digests.unionByName(sections.where(k % 8 == 5).select("doc_id", F.lit(2).alias("rank"), "section", F.lit("Second").alias("summary"), ids(n * 10)))
    digests = digests.unionByName(sections.where(k % 10 == 7).select("doc_id", F.lit(3).alias("rank"), (n + 1000).alias("section"), F.lit("Other").alias("summary"), ids(F.lit(0))))
    return integrity.part_digests(digests, sections, s, ["doc_id"])


@query(f"""
WITH {_DIGESTS_SQL}, g AS (SELECT doc_id, section, id, min(at_) AS at_ FROM k WHERE there GROUP BY ALL)
SELECT f.doc_id, f.section, trim(f.summary) AS summary, coalesce((SELECT string_agg(id, ',' ORDER BY at_) FROM g WHERE g.doc_id = f.doc_id AND g.section = f.section), '') AS evidence FROM f WHERE trim(f.summary) <> ''""")
def part_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of sections that hold, with the evidence that is in them."""
    return _part(spark, sf_dir)[0].withColumn("evidence", F.array_join("evidence", ","))


@query(f"""
WITH {_DIGESTS_SQL}
SELECT doc_id, 'unknown_section' AS code, section, CAST(NULL AS VARCHAR) AS detail FROM l WHERE NOT own UNION ALL SELECT doc_id, 'second_digest', section, NULL FROM l WHERE own AND nth > 1
UNION ALL SELECT doc_id, 'unknown_evidence', section, id FROM k WHERE NOT there
UNION ALL SELECT doc_id, 'section_not_covered', section, NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = o.doc_id AND f.section = o.section AND trim(summary) <> '')""")
def digest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the digests of each document's sections."""
    return _part(spark, sf_dir)[1]
