"""Small helpers on data frames that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/paperloom-checkpoints"
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage is cut, the size is known to the optimizer."""
    path = f"{shared_folder(df.sparkSession)}/paperloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """A column name based on `name` that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_column: str = "doc_id", text_column: str = "text") -> list:
    """Columns that tell rows apart even if ids repeat or are null: the id, and a hash of the text."""
    return [F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("text_hash")]


#: Bytes that a side of a join may have to be broadcast.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored frame, to be broadcast if its rows, of at most `row_bytes` each, are few enough; else Spark shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """node, root - the least node connected with it - of undirected edges a, b of longs.

    Large-star and small-star steps take turns until nothing changes: every step links neighbours
    to the least of them, and halves the distances at least. Each is written down, and reread.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written down, so that the join has shuffles of its own, in which Spark can split a hub's rows
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        linked = large.join(least, "a")
        edges = stored(linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
