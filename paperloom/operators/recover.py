"""What a list of files and the files that are there say about each other, and what becomes of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What becomes of a listed file, and of one that isn't listed.
KEPT, MISSING, MISMATCH, NO_HASH = "kept", "missing", "hash_mismatch", "no_hash"
ADOPTED, DISCARDED, SUPERSEDED = "adopted", "discarded", "superseded"
# A unit that is taken up again goes back from one of these states to the other.
STATES = {"researching": "context_pending"}


def reconciled(listed: DataFrame, files: DataFrame, keys: list[str], sound: Column) -> DataFrame:
    """keys, outcome, hash, written_at: a row for each listed file and for each one found.

    listed: keys, hash; files: keys, hash, written_at and what `sound` is about. Of several files of one place the newest counts, of equal ones that of the
    greatest hash; the others are superseded. A listed file is kept if the hashes agree; one that is lost, or changed, or listed without a hash, is dropped
    from the list. A file that isn't listed is adopted if it is sound, with its hash, and discarded if not.
    """
    own = files.select(*keys, F.col("hash").alias("found"), "written_at", F.coalesce(sound, F.lit(False)).alias("sound"))
    newest = own.groupBy(*keys).agg(F.max_by(F.struct("found", "written_at", "sound"), F.struct("written_at", "found")).alias("f"), F.count("*").alias("copies"))
    both = listed.select(*keys, "hash", F.lit(True).alias("listed")).join(newest, keys, "full_outer")
    is_listed, there = F.coalesce("listed", F.lit(False)), F.col("f").isNotNull()
    outcome = (
        F.when(is_listed & ~there, MISSING).when(is_listed & F.col("hash").isNull(), NO_HASH).when(is_listed & (F.col("hash") != F.col("f.found")), MISMATCH).when(is_listed, KEPT)
        .when(F.col("f.sound"), ADOPTED).otherwise(DISCARDED)
    )
    rows = both.select(*keys, outcome.alias("outcome"), F.coalesce("f.found", "hash").alias("hash"), F.col("f.written_at").alias("written_at"))
    many = newest.where("copies > 1").select(*keys, "f.found", "f.written_at")
    old = own.join(many.select(*keys, F.col("found").alias("new_hash"), F.col("written_at").alias("new_at")), keys).where((F.col("found") != F.col("new_hash")) | (F.col("written_at") != F.col("new_at")))
    return rows.unionByName(old.select(*keys, F.lit(SUPERSEDED).alias("outcome"), F.col("found").alias("hash"), "written_at"))


def report(outcomes: DataFrame, unit: list[str], states: DataFrame) -> DataFrame:
    """unit, a count for each outcome, state, state_after, changed. states: unit, state; units without files count too."""
    kinds = (KEPT, MISSING, MISMATCH, NO_HASH, ADOPTED, DISCARDED, SUPERSEDED)
    counts = outcomes.groupBy(*unit).agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))
    after = F.coalesce(F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))[F.col("state")], F.col("state"))
    rows = states.join(counts, unit, "left").na.fill(0, list(kinds)).withColumn("state_after", after)
    return rows.withColumn("changed", (F.col("state_after") != F.col("state")) | (sum((F.col(k) for k in kinds if k != KEPT), F.lit(0)) > 0))


def as_listed(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hash: the list as it is afterwards."""
    return outcomes.where(F.col("outcome").isin(KEPT, ADOPTED)).select(*keys, "hash")
