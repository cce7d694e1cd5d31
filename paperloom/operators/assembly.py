"""Text items put together to one text, and spans of it taken apart again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed(items: DataFrame, keys: list[str]) -> DataFrame:
    """The items with raw_start and raw_end, where each stands in the assembled text of its group, and separator, what stands before it.

    items: keys, page, index (the order within a page), text, eol. A line break stands behind an item that ends its line, and between pages; a space
    where indexes are left out.
    """
    order = Window.partitionBy(*keys).orderBy("page", "index")
    before = {c: F.lag(c).over(order) for c in ("page", "index", "eol")}
    separator = F.when(before["page"].isNull(), "").when(before["eol"] | (before["page"] != F.col("page")), "\n").when(F.col("index") != before["index"] + 1, " ").otherwise("")
    own = items.withColumn("separator", separator)
    end = F.sum(F.length("separator") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("raw_end", end.cast("long")).withColumn("raw_start", F.col("raw_end") - F.length("text"))


def assembled(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys and raw, the assembled text of each group."""
    parts = F.sort_array(F.collect_list(F.struct("page", "index", F.concat("separator", "text").alias("part"))))
    return placed(items, keys).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("raw"))


def item_spans(ranges: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (keys, from, to) of assembled texts as spans of their items: page, index, start and end within the item. items: placed()."""
    low, high = F.greatest("from", "raw_start"), F.least("to", "raw_end")
    cut = ranges.join(items.select(*keys, "page", "index", "raw_start", "raw_end"), keys).where(high > low)
    return cut.select(*ranges.columns, "page", "index", (low - F.col("raw_start")).alias("start"), (high - F.col("raw_start")).alias("end"))
