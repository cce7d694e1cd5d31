"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of it. Pieces of one size are alike, so
the packing is planned on the number of pieces of each size: sizes from large to small, each into
the open bins with the least room that suffices; where none does, bins of the length with the least
cost for each token they are expected to hold are opened. How far open room is trusted to fill up
is a parameter of that estimate; several values, and each single length, are tried, and the plan
with the least total cost wins. Finally each bin is cut down to the smallest length that holds its
contents. The plan says for each size which numbers of its pieces go to which bins; Spark numbers
the pieces within their size and looks them up.

The driver sees one row for each size, at most as many as the largest length has tokens. Pieces of
a frequent size are numbered in several groups, each from its own offset.

Defined results: documents without tokens, null texts among them, need no room: their row has no
piece and no bin; repeated rows are packed each; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored
from .text import INK, Words, sliced

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Shares of open room that are expected to fill up.
TRUST = (0.5, 0.8, 0.9, 0.95, 0.98, 1.0)
#: Pieces of one size that are numbered together, about.
GROUP = 100


class Plan(NamedTuple):
    """Runs of pieces: size, number of the first, first bin, pieces to a bin, offset of a bin's first. Runs of bins: first, length. cost: of all bins."""

    size: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bins: np.ndarray
    length: np.ndarray
    cost: float


def cost_of(length: int) -> float:
    """Tokens that a sequence pays for; replace it where attention makes long ones dearer."""
    return float(length)


def planned(counts: dict[int, int], lengths=LENGTHS, trust=TRUST, cost=cost_of) -> Plan:
    """The cheapest of the plans."""
    ways = [(tuple(sorted(lengths)), t) for t in trust] + [((x, max(lengths)), None) for x in sorted(lengths)]
    return min((_one_plan(counts, sorted(lengths), w, cost) for w in ways), key=lambda p: p.cost)


def _one_plan(counts: dict[int, int], lengths: list[int], way, cost) -> Plan:
    most = lengths[-1]
    room: list[list[tuple[int, int, int]]] = [[] for _ in range(most + 1)]  # by room: first bin, bins, length
    filled = np.zeros(most + 1, bool)
    runs, next_bin = [], 0
    supply = float(sum(s * n for s, n in counts.items()))
    free = 0.0
    smallest = min(counts, default=0)

    def put(r: int, first: int, n: int, length: int) -> None:
        room[r].append((first, n, length))
        filled[r] = True

    for size in sorted(counts, reverse=True):
        left, done = counts[size], 0
        supply -= size * left
        while left:
            at = int(filled[size:].argmax()) + size
            if filled[at]:
                first, n, length = room[at].pop()
                filled[at] = bool(room[at])
            else:
                length = _cheapest(size, left, supply - free, smallest, way, cost)
                at, n = length, -(-left // (length // size))
                first, next_bin = next_bin, next_bin + n
                free += float(length) * n
            m = at // size
            whole, rest = divmod(min(left, n * m), m)
            runs.append((size, done, first, m, length - at))
            if whole:
                put(at - m * size, first, whole, length)
            if rest:
                put(at - rest * size, first + whole, 1, length)
            if n - whole - (rest > 0):
                put(at, first + whole + (rest > 0), n - whole - (rest > 0), length)
            placed = whole * m + rest
            free -= float(size) * placed
            left -= placed
            done += placed
    total, bins = 0.0, []
    for r, groups in enumerate(room):
        for first, n, length in groups:
            fits = next(x for x in lengths if x >= length - r)
            bins.append((first, fits))
            total += n * cost(fits)
    bins.sort()
    columns = [np.array(c, np.int64) for c in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((columns[1], columns[0]))
    return Plan(*(c[order] for c in columns), np.array([b for b, _ in bins], np.int64), np.array([x for _, x in bins], np.int64), total)


def _cheapest(size: int, left: int, supply: float, smallest: int, way, cost) -> int:
    """The length whose bins cost least for each token, if the share `trust` of their room beyond pieces of this size fills up from what is left."""
    lengths, trust = way
    fitting = [x for x in lengths if x >= size]
    if trust is None:
        return fitting[0]

    def price(x: int) -> tuple[float, int]:
        m = min(x // size, left)
        rest = x - m * size
        fill = min(trust * rest, max(supply, 0.0)) if smallest <= rest else 0.0
        return cost(x) / (m * size + fill), x

    return min(fitting, key=price)


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every document and n_tokens, its words between white space."""
    names = [f"c{i}" for i in range(len(keep))]
    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(Words(texts, INK).counts.astype(np.int64))], names=[*names, "n_tokens"])

    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).alias("text"))
    return source.mapInArrow(run, f"{fields}n_tokens long").toDF(*keep, "n_tokens")


def packed(docs: DataFrame, keep: list[str], tokens: Column, lengths=LENGTHS, cost=cost_of) -> DataFrame:
    """Columns `keep` of every document once for each piece: piece, start and size in tokens, bin, bin_length, and offset in the bin."""
    most = max(lengths)
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(tokens, F.lit(0)).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    count = F.ceil(F.col("n") / most)
    piece = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), count - 1))
    pieces = rows.select(*names, "row", "n", F.explode_outer(piece).alias("piece"))
    start = F.col("piece") * most
    pieces = stored(pieces.select(*names, "row", "piece", start.alias("start"), F.when(start.isNotNull(), F.least(F.lit(most), F.col("n") - start)).cast("int").alias("size")))
    histogram = pieces.where("size is not null").groupBy("size").agg(F.count("*").alias("n"))
    counts = {r["size"]: r["n"] for r in histogram.collect()}
    plan = docs.sparkSession.sparkContext.broadcast(planned(counts, lengths, cost=cost))

    groups = F.broadcast(histogram.select("size", (1 + F.col("n") / GROUP).cast("long").alias("groups")))  # a row for each size
    grouped = pieces.where("size is not null").join(groups, "size").withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.col("groups")))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.groupBy("size", "part").agg(F.count("*").alias("n")).select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("size", "part").orderBy("row", "piece"))
    numbered = grouped.withColumn("within", within).join(offsets, ["size", "part"]).select(*names, "piece", "start", "size", (F.col("before") + F.col("within") - 1).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        key = p.size * (1 << 44) + p.first
        for batch in batches:
            size = batch["size"].to_numpy().astype(np.int64)
            number = batch["number"].to_numpy()
            at = np.searchsorted(key, size * (1 << 44) + number, side="right") - 1
            whole, rest = np.divmod(number - p.first[at], p.per_bin[at])
            bin_ = p.bin[at] + whole
            length = p.length[np.searchsorted(p.bins, bin_, side="right") - 1]
            columns = [*batch.columns[:-1], pa.array(bin_), pa.array(length), pa.array(p.offset[at] + rest * size)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "bin", "bin_length", "offset"])

    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    placed = numbered.mapInArrow(run, f"{fields}piece long, start long, size int, bin long, bin_length long, offset long")
    none = [F.lit(None).cast(t).alias(n) for n, t in placed.dtypes[len(keep) :]]
    return placed.unionByName(pieces.where("size is null").select(*names, *none)).toDF(*keep, *placed.columns[len(keep) :])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, size, bin, bin_length, offset, of every piece of every document."""
    return packed(counted(docs, ["doc_id"]), ["doc_id"], F.col("n_tokens"))
