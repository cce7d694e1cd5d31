"""Which of several versions, claims or positions counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_url


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with the same keys the first; they combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*(F.col(c) for c in order))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("first")).select(*keys, *(F.col(f"first.{c}").alias(c) for c in rest))


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with the same keys the last: late ones that are older are ignored."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*(F.col(c) for c in order))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("last")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def newest_complete(results: DataFrame, keys: list[str], generation: str, complete: Column, current: Column) -> DataFrame:
    """keys, generation, previous: of each key the current generation if complete, else the newest complete one before it."""
    good = results.where(complete & (F.col(generation) <= current))
    return good.groupBy(*keys).agg(F.max(generation).alias(generation)).withColumn("previous", F.col(generation) < current)


def resolved_chunks(plan: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status and generation of every planned chunk: its own generation's if complete, else the newest earlier one of the same revision that is; null if there is none.

    plan: keys, targets, current, revision; saved: keys, generation, revision, status, targets. Only results for the very targets that are planned count. status: complete or failed
    as in the current generation, else pending.
    """
    wanted = plan.select(*keys, *(F.col(c).alias(f"plan_{c}") for c in ("targets", "current", "revision")))
    same = (F.col("targets") == F.col("plan_targets")) & (F.col("revision") == F.col("plan_revision")) & (F.col("generation") <= F.col("plan_current"))
    joined = wanted.join(saved, keys, "left").withColumn("same", F.coalesce(same, F.lit(False)))
    own, complete = F.col("same") & (F.col("generation") == F.col("plan_current")), F.col("status") == "complete"
    found = joined.groupBy(*keys).agg(F.bool_or(own & complete).alias("done"), F.bool_or(own & (F.col("status") == "failed")).alias("failed"), F.max(F.when(F.col("same") & complete, F.col("generation"))).alias("generation"))
    status = F.when(F.col("done"), "complete").when(F.col("failed"), "failed").otherwise("pending")
    return found.select(*keys, status.alias("status"), "generation", (~F.col("done") & F.col("generation").isNotNull()).alias("previous"))


def standings(claims: DataFrame, url: str, trace: DataFrame, trace_url: str, viewed: str) -> DataFrame:
    """The claims with standing: viewed, listed or absent in the trace, by canonical URL."""
    seen = trace.groupBy(normalized_url(trace_url).alias("trace_key")).agg(F.bool_or(viewed).alias("trace_viewed")).where("trace_key is not null")
    joined = claims.withColumn("claim_key", normalized_url(url)).join(seen, F.col("claim_key") == F.col("trace_key"), "left")
    standing = F.when(F.col("trace_viewed"), "viewed").when(F.col("trace_key").isNotNull(), "listed").otherwise("absent")
    return joined.select(*claims.columns, standing.alias("standing"))


def differences(targets: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """key, problem: targets without result, results that come twice, and results that nobody asked for."""
    t = targets.select(key).distinct().withColumn("wanted", F.lit(True))
    r = results.groupBy(key).agg(F.count("*").alias("n"))
    joined = t.join(r, key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return joined.select(key, problem.alias("problem")).where("problem is not null")


def selected_spans(ranges: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Ranges (key, from, to) with the spans (key, pos, start, end) that they overlap, half open."""
    return ranges.join(spans, key).where((F.col("from") < F.col("end")) & (F.col("to") > F.col("start"))).select(*ranges.columns, "pos")


def caret_span(carets: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Carets (key, offset) with the span that holds each, the latest start first; else the one that ends there."""
    near = carets.join(spans, key).where((F.col("start") <= F.col("offset")) & ((F.col("offset") < F.col("end")) | (F.col("offset") == F.col("end")) & (F.col("start") < F.col("end"))))
    inside = F.col("offset") < F.col("end")
    rank = F.struct(~inside, -F.col("start"), F.col("pos"))
    return near.groupBy(*carets.columns).agg(F.min_by("pos", rank).alias("pos"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, least, median, most: the median is the value number floor(n / 2), from 0. Only counts of different values are put in order."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("rows_with_value"))
    upto = F.sum("rows_with_value").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("rows_with_value").over(Window.partitionBy(*keys))
    ranked = counted.select(*keys, value, upto.alias("upto"), n.alias("n"))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value))).alias("median"), F.max(value).alias("most"))


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The value with the largest weight in sum; of equal ones the largest."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct("w", value)).alias("mode"))


def quotas(df: DataFrame, stratum: str, size: int) -> DataFrame:
    """stratum, quota: parts of a sample in proportion to the strata's rows; what rounding leaves goes to the largest remainders."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    exact = counts.crossJoin(F.broadcast(total)).withColumn("exact", F.least(F.lit(size), F.col("total")) * F.col("n") / F.col("total"))  # one row
    whole = exact.withColumn("quota", F.floor("exact")).withColumn("rest", F.col("exact") - F.col("quota"))
    everyone = Window.partitionBy(F.lit(0))  # a row for each stratum
    nth = F.row_number().over(everyone.orderBy(F.desc("rest"), stratum))
    left = F.least(F.lit(size), F.col("total")) - F.sum("quota").over(everyone)
    return whole.select(stratum, (F.col("quota") + F.when(nth <= left, 1).otherwise(0)).cast("int").alias("quota"))


def _ranked(df: DataFrame, key: str, seed: str) -> DataFrame:
    return df.withColumn("rank", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))


def stratified_sample(df: DataFrame, stratum: str, key: str, size: int, seed: str) -> DataFrame:
    """Rows drawn by sha256(seed:key), by largest-remainder quotas of each stratum."""
    # only the ranks in question are numbered: as many as the largest quota, for each stratum
    number = F.row_number().over(Window.partitionBy(stratum).orderBy("rank"))
    return _ranked(df, key, seed).withColumn("number", number).where(F.col("number") <= size).join(quotas(df, stratum, size), stratum).where(F.col("number") <= F.col("quota")).drop("number", "quota")


def carded_sample(df: DataFrame, stratum: str, key: str, carded: str, size: int, seed: str) -> DataFrame:
    """As stratified_sample, but two thirds of each quota, rounded up, are rows with a card as far as there are any, the others rows without as far as there are any."""
    have = df.groupBy(stratum).agg(F.count_if(carded).alias("with"), F.count_if(~F.coalesce(F.col(carded), F.lit(False))).alias("without"))
    quota = F.col("quota")
    plain = F.least(quota - F.least(F.ceil(quota * 2 / 3), F.col("with")), F.col("without"))
    parts = quotas(df, stratum, size).join(have, stratum).select(stratum, plain.alias("plain"), F.least(quota - plain, F.col("with")).alias("cards"))
    own = F.coalesce(F.col(carded), F.lit(False))
    number = F.row_number().over(Window.partitionBy(stratum, own).orderBy("rank"))
    ranked = _ranked(df, key, seed).withColumn("number", number).where(F.col("number") <= size)
    return ranked.join(parts, stratum).where(F.col("number") <= F.when(own, F.col("cards")).otherwise(F.col("plain"))).drop("number", "plain", "cards")


def numbered(df: DataFrame, key: str, order: str, name: str, width: int = 4096) -> DataFrame:
    """With a number from 1 in each key's order of unique whole numbers. A key is cut into ranges of that width, each numbered in a task of its own behind those before it, so that a hot key needs no large one."""
    cut = df.withColumn("_range", F.floor(F.col(order) / width))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(key, "_range").agg(F.count("*").alias("n")).select(F.col(key).alias("_key"), F.col("_range").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order))
    joined = cut.withColumn("_own", own).join(offsets, F.col(key).eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_of")))
    return joined.select(*df.columns, (F.col("_own") + F.col("_offset")).cast("long").alias(name))
