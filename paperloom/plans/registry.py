"""Every registered query of the document operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import integrity, logs, papers, records, relations, reports, stateful, structures, texts

FLAGSHIP = "page_quality"
MODULES = [texts, relations, structures, logs, reports, papers, stateful, integrity, records]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
