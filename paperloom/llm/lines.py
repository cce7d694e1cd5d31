"""Line dedup by winnowing over line hashes.

A run of lines is repeated if the same lines, MIN_WORDS words or more, follow each other at an
earlier place of the corpus, places being ordered by document and line. Over each text slides a
window of as few lines as hold MIN_WORDS words, from each first and to each last line; the window's
least line hash is its fingerprint. As it depends on the window alone, a repeated run has the same
fingerprints wherever it stands, so none can be missed.

Only documents that hold a fingerprint found at two places or more go on. There all windows around a
matched fingerprint, before and behind, are compared as a whole, by a hash of their lines. Each that
stands at an earlier place too is deleted. Matches aren't extended line by line from one pair of
positions to the next: what a match could be extended by, either way, are windows that overlap it and
are equal too, so a longer run is the union of its windows, merged into one interval. Earlier places
are minima over equal windows; no pairs of positions are formed, and frequent ones combine before the
shuffle.

Lines are compared without white space at their ends; lines without words are passed over, and go
with the line before them. Defined results: null and empty texts stay; rows with the same id and text
are at one place and are treated alike; equal ids with other texts are told apart by a hash of the
text; null ids come first; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import BROADCAST_BYTES, row_key, spare, stored
from .text import INK, Hasher, Texts, Words, mixed, powers, sliced

MIN_WORDS = 50


class Lines:
    """Lines with words of some texts: hash (unsigned), words, and number in the text; first: such lines before each text; total: all lines of each text."""

    def __init__(self, texts: Texts):
        newline = texts.data == 10
        before = np.concatenate(([0], np.cumsum(newline)))
        self.total = np.diff(before[texts.offsets]) + 1
        all_first = np.concatenate(([0], np.cumsum(self.total)))
        start = np.sort(np.concatenate((texts.offsets[:-1], np.flatnonzero(newline) + 1)))
        words = Words(texts, INK)
        # lines begin in order, so the words between two beginnings are of one line
        low = np.searchsorted(words.start, start)
        high = np.append(low[1:], len(words))
        own = np.flatnonzero(high > low)
        self.words = (high - low)[own]
        self.hash = Hasher(texts.data)(words.start[low[own]], words.end[high[own] - 1])
        self.first = np.searchsorted(own, all_first)
        self.number = own - np.repeat(all_first[:-1], np.diff(self.first))


def windows(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, last line and fingerprint of the windows of `least` words or more that end as early, or begin as late, as they can."""
    upto = np.concatenate(([0], np.cumsum(words)))
    own = np.arange(len(words))
    text_start, text_end = (np.repeat(x, np.diff(first)) for x in (first[:-1], first[1:]))
    ahead = np.searchsorted(upto, upto[:-1] + least)  # past the last line
    back = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    forward, backward = ahead <= text_end, (upto[1:] >= least) & (back >= text_start)
    both = np.unique(np.concatenate((np.stack((own, ahead), 1)[forward], np.stack((back, own + 1), 1)[backward])), axis=0)
    if not len(both):
        return both[:, 0], both[:, 1], np.zeros(0, np.uint64)
    fingerprint = np.minimum.reduceat(np.append(hashes, np.uint64(0)), both.ravel())[::2]
    return both[:, 0], both[:, 1] - 1, fingerprint


def _numbers(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))


def line_table(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least: int = MIN_WORDS) -> DataFrame:
    """id, text_hash, hashes, words, numbers, fingerprints of every document that has a window; hashes as longs. numbers: the lines' numbers, and how many lines there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                lines = Lines(texts)
                start, _, fingerprint = windows(lines.hash, lines.words, lines.first, least)
                of = np.searchsorted(lines.first, start, side="right") - 1
                pairs = np.unique(np.stack((of.astype(np.uint64), fingerprint), 1), axis=0)
                begin = np.searchsorted(pairs[:, 0], np.arange(texts.rows + 1, dtype=np.uint64))
                columns = [_numbers(lines.hash.view(np.int64), lines.first), _numbers(lines.words.astype(np.int64), lines.first), _numbers(np.insert(lines.number, lines.first[1:], lines.total), lines.first + np.arange(texts.rows + 1)), _numbers(np.ascontiguousarray(pairs[:, 1]).view(np.int64), begin)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=["id", "text_hash", "hashes", "words", "numbers", "fingerprints"])

    source = docs.where(F.col(text).isNotNull()).select(*row_key(id_column, text), F.col(text).alias("text"))
    return source.mapInArrow(run, "id long, text_hash long, hashes array<long>, words array<long>, numbers array<long>, fingerprints array<long>").where(F.size("fingerprints") > 0)


def repeated_runs(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least: int = MIN_WORDS) -> DataFrame:
    """id, text_hash, runs array<struct<start, gap, length>>: the lines to be deleted of the documents that have some, as runs in order; gap: the lines since the run before."""
    table = stored(line_table(docs, text, id_column, least).dropDuplicates(["id", "text_hash"]))
    places = table.select("id", "text_hash", F.explode("fingerprints").alias("fingerprint"))
    # a document may hold a fingerprint at several places
    within = F.size("hashes") > F.size(F.array_distinct("hashes"))
    shared = stored(places.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    matched = places.join(shared, "fingerprint", "left_semi").groupBy("id", "text_hash").agg(F.collect_set("fingerprint").alias("matched"))
    around = table.join(matched.toDF("m_id", "m_hash", "matched"), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    around = around.where(F.col("matched").isNotNull() | within).select("id", "text_hash", "hashes", "words", "numbers", F.when(within, F.col("fingerprints")).otherwise(F.col("matched")).alias("matched"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [batch[c].flatten().to_numpy() for c in ("hashes", "words", "matched", "numbers")]
            first, m_first = (np.concatenate(([0], np.cumsum(batch[c].value_lengths().to_numpy()))) for c in ("hashes", "matched"))
            hashes = flat[0].view(np.uint64)
            start, end, fingerprint = windows(hashes, flat[1], first, least)
            of = np.searchsorted(first, start, side="right") - 1
            known = mixed(flat[2].view(np.uint64)) + np.repeat(np.arange(batch.num_rows), np.diff(m_first)).astype(np.uint64)
            ok = np.isin(mixed(fingerprint) + of.astype(np.uint64), known)
            start, end, of = start[ok], end[ok], of[ok]
            up, down = powers(len(hashes) + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes) * up[: len(hashes)])))
            key = mixed((sums[end + 1] - sums[start]) * down[start] + (end - start).astype(np.uint64))
            row = pa.array(of)
            from_, to = flat[3][start + of], flat[3][end + 1 + of] - 1  # each document has one number more than lines
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(row), batch["text_hash"].take(row), pa.array(key.view(np.int64)), pa.array(from_), pa.array(to)],
                names=["id", "text_hash", "key", "start", "end"],
            )

    found = stored(around.mapInArrow(run, "id long, text_hash long, key long, start long, end long"))
    place = F.struct("id", "text_hash", "start")
    earliest = stored(found.groupBy("key").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = found.join(earliest, "key").where(~place.eqNullSafe(F.col("place")))
    own = Window.partitionBy("id", "text_hash").orderBy("start", "end")
    upto = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.select("id", "text_hash", "start", "end", F.coalesce(F.col("start") > upto + 1, F.lit(True)).cast("int").alias("new"))
    islands = islands.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("id", "text_hash", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("id", "text_hash").orderBy("island")), F.lit(-1))
    run = F.struct("start", (F.col("start") - before - 1).cast("int").alias("gap"), (F.col("end") - F.col("start") + 1).cast("int").alias("length"))
    return merged.select("id", "text_hash", run.alias("run")).groupBy("id", "text_hash").agg(F.sort_array(F.collect_list("run")).alias("runs"))


def deduplicated(docs: DataFrame, text: str = "text", id_column: str = "doc_id", least: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """All rows and columns of the documents, the text without later repeated runs, and the lines before and deleted, under other names if a column has theirs."""
    counts = tuple(spare(docs, c) for c in counts)
    inner = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*inner.values())
    text_, id_ = inner[text], inner[id_column]
    runs = stored(repeated_runs(plain, text_, id_, least).toDF("run_id", "run_hash", "runs"))
    keyed = plain.withColumns(dict(zip(("key_id", "key_hash"), row_key(id_, text_), strict=True)))
    size = runs.agg(F.sum(16 * F.size("runs") + 64)).first()[0] or 0
    side = F.broadcast(runs) if size <= BROADCAST_BYTES else runs
    joined = keyed.join(side, F.col("key_id").eqNullSafe(F.col("run_id")) & (F.col("key_hash") == F.col("run_hash")), "left")
    lines = F.split(text_, "\n", -1)
    gone = F.flatten(F.transform("runs", lambda r: F.concat(F.array_repeat(F.lit(False), r["gap"]), F.array_repeat(F.lit(True), r["length"]))))
    marked = joined.withColumn("gone", gone)
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    new = F.when(F.col("gone").isNull(), F.col(text_)).otherwise(rest)
    deleted = F.aggregate("runs", F.lit(0), lambda n, r: n + r["length"])
    return marked.select(
        *(new.alias(c) if c == text else F.col(n).alias(c) for c, n in inner.items()),
        F.when(F.col(text_).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counts[0]),
        F.coalesce(deleted, F.lit(0)).cast("long").alias(counts[1]),
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_deleted of every document."""
    return deduplicated(docs.select("doc_id", "text"))
