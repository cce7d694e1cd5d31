"""How far the work on each unit has come: its phase, the states of its chunks, and the last entries of its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries of the history that are kept.
HISTORY = 20
# Kinds of events, and the states that they bring chunks to.
PHASE, NOTE = "phase", "note"
STATES = {"chunk_started": "running", "chunk_finished": "done", "chunk_failed": "failed"}

EVENTS = "unit long, at timestamp, seq long, kind string, chunk long, text string"
PROGRESS = "unit long, phase string, running long, done long, failed long, events long, history array<string>"


def entry(kind: str, text: str | None) -> str:
    return f"{kind}: {text}" if text else kind


def tracked(events: DataFrame) -> DataFrame:
    """unit, phase - the last one that was set -, chunks by the state that the last event brought each to, the number of events, and the last entries of the history, newest first.

    The history is cut down in each task before the shuffle; of chunks only the last event is kept.
    """
    order = F.struct("at", "seq")
    phase = events.groupBy("unit").agg(F.max_by(F.when(F.col("kind") == PHASE, F.col("text")), F.when(F.col("kind") == PHASE, order)).alias("phase"), F.count("*").alias("events"))
    states = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    last = events.where(F.col("kind").isin(list(STATES)) & F.col("chunk").isNotNull()).groupBy("unit", "chunk").agg(F.max_by(states[F.col("kind")], order).alias("state"))
    counts = last.groupBy("unit").agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES.values()))
    nth = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("at"), F.desc("seq")))
    text = F.concat("kind", F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit(": "), "text")).otherwise(F.lit("")))
    recent = events.select("unit", "at", "seq", text.alias("entry")).withColumn("nth", nth).where(F.col("nth") <= HISTORY)
    history = recent.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("nth", "entry"))).alias("h")).select("unit", F.col("h.entry").alias("history"))
    rows = phase.join(counts, "unit", "left").join(history, "unit")
    return rows.select("unit", "phase", *(F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in STATES.values()), "events", "history")
