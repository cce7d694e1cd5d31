"""Folding of event logs: progress, budgets, recorded output, waiting times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def granted(requests: DataFrame, scope: list[str], order: list[str], limit: int) -> DataFrame:
    """The requests that each scope's budget still covers: its first `limit`. Spark cuts each task's rows down before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return requests.withColumn("granted_as", n).where(F.col("granted_as") <= limit).withColumn("granted_as", F.col("granted_as").cast("long"))


def budgets(requests: DataFrame, scope: list[str], limit: int) -> DataFrame:
    """scope, used, refused, exhausted."""
    n = requests.groupBy(*scope).agg(F.count("*").alias("n"))
    return n.select(*scope, F.least("n", F.lit(limit)).alias("used"), F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"), (F.col("n") >= limit).alias("exhausted"))


def recorded(deltas: DataFrame, unit: list[str], item: str, order: list[str], delta: str, separator: str = "") -> DataFrame:
    """unit, item, text: of each unit the deltas of its last item, in order; a new item cuts off what was before."""
    last = deltas.groupBy(*unit).agg(F.max(item).alias("last_item"))
    own = deltas.join(last, unit).where(F.col(item) == F.col("last_item"))
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(delta).alias("recorded_delta"))))
    return own.groupBy(*unit, "last_item").agg(F.array_join(F.transform(listed, lambda x: x["recorded_delta"]), separator).alias("text")).withColumnRenamed("last_item", item)


def progress(events: DataFrame, unit: list[str], order: list[str], done: Column, failed: Column, stopped: Column) -> DataFrame:
    """unit, completed, failed, total, percent, running: the state that the events lead to."""
    last = F.max_by(stopped, F.struct(*order))
    n, d = F.count("*"), F.count_if(done)
    return events.groupBy(*unit).agg(d.alias("completed"), F.count_if(failed).alias("failed"), n.alias("total"), F.floor(100 * d / n).alias("percent"), (~last).alias("running"))


def resume_at(windows: DataFrame, unit: list[str], used: str, resets: str, now: Column, full: float = 100.0, margin: str = "INTERVAL 60 SECONDS") -> DataFrame:
    """unit, resume: when the last full window ends; without a full one, when the first ends; null without any to come."""
    to_come = F.when(F.col(resets) > now, F.col(resets))
    last_full = F.max(F.when(F.col(used) >= full, to_come))
    return windows.groupBy(*unit).agg((F.coalesce(last_full, F.min(to_come)) + F.expr(margin)).alias("resume"))


def carried(df: DataFrame, unit: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """With the last value seen so far in the unit."""
    w = Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def out_of_order(df: DataFrame, unit: list[str], order: list[str], value: str) -> DataFrame:
    """unit, pairs, inversions: how often a value is less than the one before."""
    w = Window.partitionBy(*unit).orderBy(*order)
    before = F.lag(value).over(w)
    marked = df.select(*unit, before.isNotNull().alias("pair"), (F.col(value) < before).alias("inverted"))
    return marked.groupBy(*unit).agg(F.count_if("pair").alias("pairs"), F.count_if("inverted").alias("inversions"))
