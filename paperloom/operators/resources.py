"""Resources to prepare with: a recent result is taken again, else the first few verified ones of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hosts of the own machine or network, of videos, and places of searches.
LOCAL = r"(^|\.)localhost$|^(127\.|10\.|192\.168\.|\[)"
VIDEOS, SHORT = r"^(www\.)?youtube\.com$", "youtu.be"
SEARCHES = ["/results", "/search"]
#: Resources of a unit, at most, and seconds that a result stays fresh.
MOST, FRESH = 6, 30 * 86400


def latest_within(requests: DataFrame, results: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Requests with `result`, the columns of the last result of the same keys that is at most so old; null without one.

    Both sides are cut into stretches of that length, so a request meets the results of its own stretch and the one before: a hot key is spread over as
    many places of the shuffle as it has stretches.
    """
    stretch = F.floor(F.unix_micros(F.col(at)) / (seconds * 1_000_000))
    own = requests.withColumn("_stretch", stretch)
    found = results.select(*keys, F.struct(F.col(at), *(c for c in results.columns if c not in (*keys, at))).alias("result"), F.explode(F.array(stretch, stretch + 1)).alias("_stretch"))
    latest = own.select(*keys, "_stretch", at).distinct().join(found, [*keys, "_stretch"]).where((F.col(f"result.{at}") <= F.col(at)) & (F.unix_micros(F.col(at)) - F.unix_micros(F.col(f"result.{at}")) < seconds * 1_000_000))
    best = latest.groupBy(*keys, "_stretch", at).agg(F.max("result").alias("result"))
    return own.join(best, [*keys, "_stretch", at], "left").drop("_stretch")


def allowed(url: Column) -> Column:
    """Whether a normalised address is one of a page or video on the open web, and not of a search."""
    part = lambda what: F.try_parse_url(url, F.lit(what))
    host, path = F.lower(part("HOST")), F.coalesce(part("PATH"), F.lit(""))
    video = host.rlike(VIDEOS) & ~((path == "/watch") & F.coalesce(part("QUERY"), F.lit("")).rlike(r"(^|&)v(=|&|$)"))
    return F.coalesce(host.isNotNull() & part("USERINFO").isNull() & ~host.rlike(LOCAL) & ~video & ~path.isin(SEARCHES), F.lit(False))


def chosen(candidates: DataFrame, keys: list[str], url: str, order: list[str], verified: Column, most: int = MOST) -> DataFrame:
    """The first few candidates of each group that are verified and allowed, each address once, with `place` from 1. Tasks cut groups down before the shuffle."""
    good = candidates.where(verified & allowed(F.col(url)))
    once = good.groupBy(*keys, url).agg(F.min_by(F.struct(*(c for c in good.columns if c not in (*keys, url))), F.struct(*order)).alias("row")).select(*keys, url, "row.*")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return once.withColumn("place", place).where(F.col("place") <= most)
