"""Event streams: the latest state of each key, and counts in windows that wait for late events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import last_by
from ..sources.shared import fresh_folder


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key; an older one that comes later changes nothing. For a stream, in update or complete mode."""
    return last_by(events, keys, order)


def windowed(events: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """keys, from, n: events in windows of `width`; ones later than `late` are left out of a stream."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("w.start").alias("from"), "n")


def drained(spark: SparkSession, result: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """What a streaming frame has given for each key once it has taken in all there is. Each batch is written to the shared folder; the last counts."""
    folder = fresh_folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/number={number}")

    stream = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    stream.awaitTermination()
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in result.schema)}, batch int, number int"
    rows = spark.read.schema(schema).parquet(f"{folder}/out").drop("number")
    return last_by(rows, keys, ["batch"]).drop("batch")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB, as keyed state of any form needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def first_requests(requests: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """keys of each request once, however often it is repeated; repetitions are known as far back as `late`, whose state is dropped then. For a stream, in append mode."""
    return requests.withWatermark(at, late).select(at, *keys).dropDuplicatesWithinWatermark(keys).select(*keys)


def answered(requests: DataFrame, answers: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Requests with `answer`, the columns of the last answer to the same keys, null where there is none yet; and whether it is cached. For a stream of requests beside a table of answers."""
    last = last_by(answers, keys, order)
    return requests.join(last.select(*keys, F.struct(*(c for c in last.columns if c not in keys)).alias("answer")), keys, "left").withColumn("cached", F.col("answer").isNotNull())
