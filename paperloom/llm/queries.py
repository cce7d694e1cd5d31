"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import crossentropy, decontaminate, fingerprints, jaccard, languages, lines, packing, pages, periods, privacy, quality, tokens, toxicity
from .frames import read
from .oracles import ORACLE_SQL  # noqa: F401


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.report(read(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(read(spark, sf_dir, "documents"))


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_crossentropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossentropy.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.report(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(read(spark, sf_dir, "documents"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.report(read(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(read(spark, sf_dir, "documents"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lines": op1_lines,
    "op2_pages": op2_pages,
    "op3_decontaminate": op3_decontaminate,
    "op4_jaccard": op4_jaccard,
    "op5_privacy": op5_privacy,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_crossentropy": op8_crossentropy,
    "op9_languages": op9_languages,
    "op10_packing": op10_packing,
    "op11_tokens": op11_tokens,
    "op12_fingerprints": op12_fingerprints,
    "op13_periods": op13_periods,
}
