"""The run of a chunk of targets through its attempts: reuse, salvage, first request, repair, split, save.

A transition table says what an outcome asks for next; a fold over the attempts in their order follows it, and what is left to ask for where the attempts end
is the next request. A run has at most a request, its repairs and two halves, so no more attempts than that are collected for a chunk, however many the log has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of failed requests after which the run stops, or asks for a repair; after others it is split.
STOPS = ["unavailable", "needs_login", "quota", "cancelled", "interrupted", "transport", "duplicate_job", "unsupported_policy", "invalid_schema"]
REPAIRS = ["invalid_json", "schema_mismatch"]
# Outcomes of an answered request.
OK, SHAPE, INVALID = "ok", "output_shape", "validation_failed"

_STATE = "struct<ask: string, asked: array<bigint>, second: array<bigint>, left: array<bigint>, repairs: int, path: string, requests: int, outcome: string>"


def asks_for(outcome: Column) -> Column:
    """done, repair, stop or split: what comes after an outcome, the kind of failure where the request failed."""
    return F.when(outcome == OK, "done").when(outcome.isin(SHAPE, INVALID, *REPAIRS), "repair").when(outcome.isin(STOPS), "stop").otherwise("split")


def _state(ask: Column, asked: Column, second: Column, left: Column, repairs: Column, path: Column, requests: Column, outcome: Column) -> Column:
    return F.struct(ask.alias("ask"), asked.alias("asked"), second.alias("second"), left.alias("left"), repairs.alias("repairs"), path.alias("path"), requests.alias("requests"), outcome.alias("outcome")).cast(_STATE)


def _after(s: Column, attempt: Column, max_repairs: int) -> Column:
    """The state after an attempt at what was asked for."""
    left = F.array_except(s["left"], F.array_intersect(s["asked"], attempt["accepted"]))

    def following(x: Column) -> Column:
        rest, then, whole = x["left"], asks_for(attempt["outcome"]), s["ask"] != "split"
        half = F.ceil(F.size(rest) / 2).cast("int")
        mended = whole & (then == "repair") & (s["repairs"] < max_repairs)
        ask = (
            F.when((F.size(rest) == 0) | (then == "stop"), "save").when(mended, "repair").when(whole, "split").when(s["second"].isNotNull(), "split").otherwise("save")
        )
        asked = F.when(mended, rest).when(whole, F.slice(rest, F.lit(1), half)).otherwise(s["second"])
        second = F.when(whole & ~mended & (F.size(rest) > 1), F.slice(rest, half + 1, F.size(rest)))
        return _state(ask, asked, second, rest, s["repairs"] + F.when(mended, 1).otherwise(0), F.concat(s["path"], F.lit(">"), ask), s["requests"] + 1, attempt["outcome"])

    return F.element_at(F.transform(F.array(F.struct(left.alias("left"))), following), 1)


def runs(chunks: DataFrame, attempts: DataFrame, key: str, max_repairs: int = 1) -> DataFrame:
    """key, path, requests, recovered, left, status, next, targets, code of every chunk.

    chunks: key, targets (array<long>), reusable (a complete result for the same input is there), kept (targets of an unfinished one for the same input),
    salvaged (targets written in full in the output of a request that broke off) and written (whether there is any such output). attempts: key, number,
    outcome, accepted. status is reused, complete, failed or open; next and targets are the request that an open run waits for, code why one failed.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy("number"))
    some = attempts.withColumn("nth", nth).where(F.col("nth") <= max_repairs + 3)
    listed = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "outcome", "accepted"))).alias("attempts"))
    both = chunks.join(listed, key, "left").withColumn("attempts", F.coalesce("attempts", F.array()))
    known = F.array_intersect("targets", F.array_union("kept", "salvaged"))
    left, none = F.array_except("targets", known), F.lit(None).cast("array<bigint>")
    resumed = (F.size(known) > 0) | F.col("written")
    first = F.when(F.col("reusable") | (F.size(left) == 0), "save").when(resumed, "resume").otherwise("initial")
    asked = F.when(resumed, left).otherwise(F.col("targets"))
    salvage = F.when(F.size(F.array_except(F.array_intersect("targets", "salvaged"), "kept")) > 0, F.lit("salvage>")).otherwise(F.lit(""))
    path = F.when(F.col("reusable"), "reuse").otherwise(F.concat(salvage, first))
    start = _state(first, asked, none, F.when(F.col("reusable"), F.array().cast("array<bigint>")).otherwise(left), F.lit(0), path, F.lit(0), F.lit(None).cast("string"))
    end = F.aggregate("attempts", start, lambda s, a: F.when(s["ask"] == "save", s).otherwise(_after(s, a, max_repairs)))
    r = both.select(key, end.alias("s"), "reusable", F.when(F.col("reusable"), 0).otherwise(F.size(known)).alias("recovered"))
    open_, failed = F.col("s.ask") != "save", F.size("s.left") > 0
    outcome = F.col("s.outcome")
    code = F.when(outcome.isin(OK, INVALID), "chunk_validation").when(outcome == SHAPE, "chunk_output_shape").otherwise(F.concat(F.lit("llm_"), outcome))
    return r.select(
        key, "s.path", "s.requests", "recovered", F.size("s.left").alias("left"),
        F.when(F.col("reusable"), "reused").when(open_, "open").when(failed, "failed").otherwise("complete").alias("status"),
        F.when(open_, F.col("s.ask")).alias("next"), F.when(open_, F.col("s.asked")).alias("targets"), F.when(~open_ & failed, code).alias("code"),
    )
