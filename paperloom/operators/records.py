"""Records of requests that were under way, and events as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a record's file is named, its version, the form of a paper's folder, and events by the names that they are shown under.
SUFFIX, VERSION, FOLDER = ".meta.json", 1, "^[0-9a-f]{64}$"
SHOWN = {"state": "state", "context": "context", "research": "research", "plan": "plan", "chunk_started": "chunkStarted", "chunk_finished": "chunkFinished", "finished": "finished"}

_META = "version int, jobId string, stage string, unitId string, attempt int, startedAt string, inputHash string, targetIds array<string>"


def inflight(files: DataFrame, stage: str, unit: str | None = None) -> DataFrame:
    """unit, place, job, attempt, started_at, input_hash, targets, text of the requests of a stage, in order within each unit.

    files: name, content. A record counts if its name is that of its job and every field has its type; others are passed over. The output that belongs to it
    is the text file of the same name, the empty string where there is none.
    """
    meta = files.where(F.endswith("name", F.lit(SUFFIX))).select(F.expr(f"left(name, length(name) - {len(SUFFIX)})").alias("job"), F.from_json("content", _META).alias("m"))
    whole = (F.col("m.version") == VERSION) & (F.col("m.jobId") == F.col("job")) & F.col("m.unitId").isNotNull() & F.col("m.attempt").isNotNull() & F.col("m.inputHash").isNotNull() & F.forall("m.targetIds", lambda x: x.isNotNull())
    mine = (F.col("m.stage") == stage) & (F.lit(True) if unit is None else F.col("m.unitId") == unit)
    found = meta.where(F.coalesce(whole & mine, F.lit(False)))
    texts = files.where(F.endswith("name", F.lit(".txt"))).select(F.expr("left(name, length(name) - 4)").alias("job"), F.col("content").alias("text"))
    place = F.row_number().over(Window.partitionBy("m.unitId").orderBy("m.attempt", "m.startedAt", "job"))
    rows = found.join(texts, "job", "left").withColumn("place", place)
    return rows.select(
        F.col("m.unitId").alias("unit"), "place", "job", F.col("m.attempt").alias("attempt"), F.col("m.startedAt").alias("started_at"), F.col("m.inputHash").alias("input_hash"), F.col("m.targetIds").alias("targets"), F.coalesce("text", F.lit("")).alias("text")
    )


def shown(events: DataFrame, kind: str, chunks: Column, completed: Column, failed: Column, total: Column) -> DataFrame:
    """The events with `shown`, the name that each is shown under, and the counts that go with it; jobs' ids don't, and events without such a name are left out. chunks: ids of a plan, of which the number is shown."""
    name = F.create_map(*(F.lit(x) for pair in SHOWN.items() for x in pair))[F.col(kind)]
    counted = F.col(kind).isin("chunk_finished", "finished")
    return events.withColumns({
        "shown": name, "shown_total": F.when(F.col(kind) == "plan", F.size(chunks)).when(counted | (F.col(kind) == "chunk_started"), total), "shown_completed": F.when(counted, completed), "shown_failed": F.when(counted, failed),
    }).where(F.col("shown").isNotNull())


def paper_folders(names: DataFrame, name: str) -> DataFrame:
    """The names that are those of papers' folders."""
    return names.where(F.col(name).rlike(FOLDER))


def research_counts(cards: DataFrame, unit: list[str], researched: Column, source: str) -> DataFrame:
    """unit, researched, sources: how many cards were researched, and from how many different sources."""
    return cards.groupBy(*unit).agg(F.count_if(researched).alias("researched"), F.count_distinct(source).alias("sources"))
