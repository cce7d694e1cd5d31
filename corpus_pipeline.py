"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, written as Parquet and read again, and all but the
last return the columns of documents.

Defined results: documents with a null or empty text fail the first stage's base rules; null ids,
languages and sources stay what they are; of repeated rows one is left after the third stage; an empty
table gives an empty result; further columns stay, whatever their names, but for the last stage, which
returns places. Near copies that line dedup has cut may be unlike what they were copied from, and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, jaccard, lines, packing, quality
from paperloom.llm.frames import read, spare, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's and source's thresholds reject go, null and empty texts among them."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which fewer words are left than the first stage asks for; n_chars follows."""
    gone = spare(docs, "n_deleted")
    cut = F.col(gone) > 0
    rest = lines.deduplicated(docs, counts=(spare(docs, "n_lines"), gone)).where(~cut | (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= quality.LEAST_WORDS))
    return rest.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by similar texts, the document with the least id stays, of repeated rows one; null ids come last."""
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its place in a sequence of one of the permitted lengths."""
    keep = ["doc_id", "lang", "source"]
    return packing.packed(packing.counted(docs, keep), keep, F.col("n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Spans of repeated lines, connected groups and bins are more than a statement can follow; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
