"""The given tables, and relations derived from them that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, pos from 0, text: the lines of the documents."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return lines.withColumn("pos", F.col("pos").cast("long"))


SENTENCES_SQL = """
sentences AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
)"""


def trimmed_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, start and end: where each line stands in its document."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = sentences(spark, sf_dir).withColumn("n", F.length("text"))
    start = F.coalesce(F.sum(F.col("n") + 1).over(w), F.lit(0))
    return lines.select("doc_id", "pos", start.alias("start"), (start + F.col("n")).alias("end"))


SPANS_SQL = """
spans AS (
  SELECT doc_id, pos, CAST(coalesce(sum(length(text) + 1) OVER w, 0) AS BIGINT) AS "start",
         CAST(coalesce(sum(length(text) + 1) OVER w, 0) + length(text) AS BIGINT) AS "end"
  FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
