"""Rules that a generated text keeps against its source. Each gives key, code, severity and detail of what it breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _issues(df: DataFrame, key: list[str], code: str, details: Column, severity: str = "fatal") -> DataFrame:
    """A row for each entry of the array `details`."""
    return df.select(*key, F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.explode(details).alias("detail"))


def counted(tokens: Column) -> Column:
    """array<struct<token, n>> of an array of tokens."""
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), F.size(F.filter(tokens, lambda x: x == t)).alias("n")))


def placeholders_kept(df: DataFrame, key: list[str], source: str, result: str) -> DataFrame:
    """As many of each placeholder as in the source."""
    want, have = T.placeholders(source), T.placeholders(result)
    n = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    words = lambda t: F.concat(t, F.lit(" "), n(want, t).cast("string"), F.lit(" "), n(have, t).cast("string"))
    every = F.array_union(want, have)
    lost = F.transform(F.filter(every, lambda t: n(have, t) < n(want, t)), words)
    added = F.transform(F.filter(every, lambda t: n(have, t) > n(want, t)), words)
    return _issues(df, key, "placeholder_lost", lost).unionByName(_issues(df, key, "placeholder_added", added))


def citations_kept(df: DataFrame, key: list[str], markers: str, result: str) -> DataFrame:
    """Each marker of the source, white space aside."""
    lost = F.filter(F.array_distinct(F.col(markers)), lambda m: ~F.contains(T.squeeze(result), T.squeeze(m)))
    return _issues(df, key, "citation_lost", lost)


def urls_known(df: DataFrame, key: list[str], source: str, result: str) -> DataFrame:
    return _issues(df, key, "invented_url", F.array_except(T.urls_in(result), T.urls_in(source)))


def neighbours_kept_out(df: DataFrame, key: list[str], source: str, result: str, neighbours: str, markers: str | None = None, least: int = 24) -> DataFrame:
    """No neighbour as a whole, if it is long enough, and no bracketed marker that only neighbours have."""
    found = F.filter(F.col(neighbours), lambda t: (F.length(T.squeeze(t)) >= least) & F.contains(F.lower(T.squeeze(result)), F.lower(T.squeeze(t))))
    out = _issues(df, key, "neighbor_content", F.transform(F.array_distinct(found), lambda t: F.substring(t, 1, 40)))
    if markers:
        foreign = lambda m: T.squeeze(m).rlike(r"^\[.*\]$") & ~F.contains(T.squeeze(source), T.squeeze(m)) & F.contains(T.squeeze(result), T.squeeze(m))
        out = out.unionByName(_issues(df, key, "neighbor_content", F.filter(F.array_distinct(F.col(markers)), foreign)))
    return out


def numbers_kept(df: DataFrame, key: list[str], source: str, result: str) -> DataFrame:
    own = F.transform(F.regexp_extract_all(result, F.lit(r"\d+(?:[.,]\d+)*"), 0), lambda n: F.regexp_replace(n, r",(?=\d{3}(?!\d))", ""))
    return _issues(df, key, "number_missing", F.array_except(T.numbers_in(source), own), "warning")


def not_empty(df: DataFrame, key: list[str], source: str, result: str) -> DataFrame:
    empty = (T.trimmed(source) != "") & (T.trimmed(F.coalesce(F.col(result), F.lit(""))) == "")
    return _issues(df, key, "empty_translation", F.when(empty, F.array(F.lit(""))))


def all_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def verdicts(df: DataFrame, key: list[str], issues: DataFrame) -> DataFrame:
    """key, fatal and warnings of every row; ok without a fatal issue."""
    n = issues.groupBy(*key).agg(F.count_if(F.col("severity") == "fatal").alias("fatal"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("fatal", "warnings")]
    return df.select(*key).join(n, key, "left").select(*key, *counts).withColumn("ok", F.col("fatal") == 0)
