"""N-gram Jaccard join by MinHash banding, with every link verified on the full sets.

A text's set holds its shingles of SHINGLE words (op3's words; all words of a shorter text are one
shingle). Texts with the same set are one class and are compared once. Of the permitted bandings,
the one with the fewest hashes that finds a pair at THRESHOLD with probability RECALL is chosen.
Spark shuffles band hashes; classes that share one with others are linked to the least of them, and
connected classes form a group of candidates. Full sets are made for candidates only, one for each
class; a group too large for a task is split into blocks, and every two of its blocks meet in a part
of their own; the parts of a group are dealt to the partitions in turn. There all pairs are compared, by counting common shingles in numpy: no pair
is ever a row. What comes out is, for each class, how many documents it is linked with, and a
spanning part of the links, which is joined up again.

Defined results: null texts and texts without words have no set, and are linked with nothing;
repeated rows are documents of their own, and copies; the group of a document is the least id of
those connected with it, null ids aside; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import components, row_key, small_side, stored
from .text import LETTERS, Hasher, Texts, Words, chained, mixed, sliced

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Rows of a band that are considered; more make fewer false candidates.
ROWS = (3, 4, 5)
#: A pair of texts this alike is no candidate, but in at most the share FALSE of cases.
UNLIKE, FALSE = 0.3, 0.2
#: Shingles in a block of a group; a text counts LEAST at least.
BLOCK, LEAST = 40_000, 150
#: Shingles in more texts than that are counted in a matrix product.
COMMON = 24


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows=ROWS) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with the recall asked for, and few enough false candidates."""
    ways = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in rows]
    good = [w for w in ways if 1 - (1 - UNLIKE ** w[1]) ** w[0] <= FALSE]
    return min(good or ways[-1:], key=lambda w: w[0] * w[1])


def shingles(texts: Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sets of hashed shingles, sorted, and where each text's begins."""
    words = Words(texts, LETTERS, lower=True)
    hashes = Hasher(words.data)(words.start, words.end)
    of = words.text
    grams = chained(hashes, n)
    whole = np.flatnonzero(of[: len(grams)] == of[n - 1 :]) if len(grams) else np.zeros(0, int)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    single = np.zeros(len(short), np.uint64)
    for k in range(n - 1):  # the few words of short texts, in order, and how many
        at = words.first[short] + np.minimum(k, words.counts[short] - 1)
        single = np.where(k < words.counts[short], mixed(single * np.uint64(3) + hashes[at] + np.uint64(k + 1)), single)
    text = np.concatenate((of[whole], short))
    values = np.concatenate((grams[whole], single))
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.append(True, (text[1:] != text[:-1]) | (values[1:] != values[:-1]))[: len(text)]
    text, values = text[new], values[new]
    return values, np.searchsorted(text, np.arange(texts.rows + 1))


def band_hashes(values: np.ndarray, first: np.ndarray, bands: int, rows: int, seed: int = 20) -> np.ndarray:
    """A row of band hashes for each text that has shingles."""
    some = first[:-1][first[1:] > first[:-1]]
    r = np.random.default_rng(seed)
    out = np.zeros((len(some), bands), np.uint64)
    if not len(some):
        return out
    for b in range(bands):
        key = np.full(len(some), b + 1, np.uint64)
        for _ in range(rows):
            odd, add = (np.uint64(x) for x in r.integers(0, 1 << 63, 2, dtype=np.uint64) * 2 + 1)
            hashed = values * odd
            hashed ^= hashed >> np.uint64(32)
            key = mixed(key + np.minimum.reduceat(hashed * odd + add, some))
        out[:, b] = key
    return out


def signatures(docs: DataFrame, keep: list[str], text: str, bands: int, rows: int, n: int = SHINGLE) -> DataFrame:
    """Columns `keep` of every document, size, low and high, a hash of the set in two longs, and bands array<long>."""
    names = [f"c{i}" for i in range(len(keep))]
    fields = "".join(f"{x} {docs.schema[c].dataType.simpleString()}, " for x, c in zip(names, keep, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                values, first = shingles(texts, n)
                size = np.diff(first)
                some = np.flatnonzero(size)
                low, high = np.zeros(texts.rows, np.int64), np.zeros(texts.rows, np.int64)
                if len(some):
                    low[some] = np.add.reduceat(values, first[some]).view(np.int64)
                    high[some] = np.add.reduceat(mixed(values + np.uint64(77)), first[some]).view(np.int64)
                found = band_hashes(values, first, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((size > 0) * bands))).astype(np.int32)), pa.array(found.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(size.astype(np.int64)), pa.array(low), pa.array(high), lists], names=[*names, "size", "low", "high", "bands"])

    source = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, names, strict=True)), F.col(text).alias("text"))
    return source.mapInArrow(run, f"{fields}size long, low long, high long, bands array<long>").toDF(*keep, "size", "low", "high", "bands")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common. Frequent values are counted in a product of matrices, rare ones pair by pair."""
    g = len(sets)
    if g == 2:
        a, b = sorted(sets, key=len)
        at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
        n = int((b[at] == a).sum()) if len(b) else 0
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], float)
    of = np.repeat(np.arange(g), [len(s) for s in sets])
    _, value, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((g, g), np.float64)
    often = np.flatnonzero(df > COMMON)
    number = np.full(len(df), -1)
    number[often] = np.arange(len(often))
    for begin in range(0, len(often), 2048):
        use = (number[value] >= begin) & (number[value] < begin + 2048)
        m = np.zeros((g, min(2048, len(often) - begin)), np.float32)
        m[of[use], number[value[use]] - begin] = 1
        out += m @ m.T
    rare = df[value] <= COMMON
    order = np.argsort(value[rare], kind="stable")
    of, value = of[rare][order], value[rare][order]
    start = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, int)
    size = np.diff(np.append(start, len(value)))
    for n in np.unique(size).tolist():
        rows = of[start[size == n][:, None] + np.arange(n)]
        step = max(1, 2_000_000 // (n * n))
        for k in range(0, len(rows), step):
            pairs = rows[k : k + step, :, None] * g + rows[k : k + step, None, :]
            np.add.at(out.reshape(-1), pairs.ravel(), 1)
    return out


def linked(sets: list[np.ndarray], block: np.ndarray, threshold: float, inner: bool) -> np.ndarray:
    """Which two are alike; inner: the texts are of one block, and all are compared, else only those of different blocks."""
    both = common(sets)
    size = np.diag(both)
    alike = both >= threshold * (size[:, None] + size[None] - both) - 1e-9
    np.fill_diagonal(alike, False)
    if not inner:  # even if one of the two blocks is empty: its own part has the pairs of a block
        alike &= block[:, None] != block[None]
    return alike


def roots(alike: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node connected with each."""
    label = nodes.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(alike, label[None], top).min(1))
        if (new == label).all():
            return label
        label = new


def verified(candidates: DataFrame, threshold: float) -> DataFrame:
    """node, links, root of the rows of every task's group. candidates: part, inner, block, node, copies, shingles; grouped and sorted by part."""

    def group(inner: list, block: list, node: list, copies: list, sets: list) -> pa.RecordBatch:
        alike = linked(sets, np.array(block), threshold, inner[0])
        nodes = np.array(node, np.int64)
        links = (alike * np.array(copies, np.int64)[None]).sum(1)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(roots(alike, nodes))], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [], [], [])
        for batch in batches:
            flat, first = batch["shingles"].flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(batch["shingles"].value_lengths().to_numpy())))
            columns = [batch[c].to_pylist() for c in ("part", "inner", "block", "node", "copies")]
            for k, (part, *row) in enumerate(zip(*columns, strict=True)):
                if part != last:
                    if len(held[0]) > 1:
                        yield group(*held)
                    last, held = part, ([], [], [], [], [])
                for kept, x in zip(held, (*row, flat[first[k] : first[k + 1]].copy()), strict=True):
                    kept.append(x)
        if len(held[0]) > 1:
            yield group(*held)

    return candidates.select("part", "inner", "block", "node", "copies", "shingles").mapInArrow(run, "node long, links long, root long")


def _sets(docs: DataFrame, text: str, n: int) -> DataFrame:
    """The columns of docs, and shingles instead of the text."""
    names = [c for c in docs.columns if c != text]
    fields = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                values, first = shingles(texts, n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))], names=[*names, "shingles"])

    return docs.select(*names, F.col(text).alias("text")).mapInArrow(run, f"{fields}shingles array<long>")


def joined(docs: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """id, text_hash, set_id, group_id, n_links and group, a number or null, of every row.

    set_id: the least id of those with the same set; group_id: of those connected with it by links; n_links: the other rows with a similarity of `threshold` or more.
    """
    bands, rows = banding(threshold, recall)
    plain = docs.select(*row_key(id_column, text), F.col(text).alias("text"))
    all_rows = stored(signatures(plain, ["id", "text_hash"], "text", bands, rows, n).withColumn("row", F.monotonically_increasing_id()))
    full = all_rows.where("size > 0")
    keys = ["low", "high", "size"]
    classes = full.groupBy(*keys).agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"), F.count("*").alias("copies"))
    classes = stored(classes.select(*keys, F.col("first.row").alias("node"), F.col("first.id").alias("set_id"), "copies"))

    banded = full.join(classes.select("node"), full["row"] == F.col("node"), "left_semi").select(F.col("row").alias("node"), F.posexplode("bands").alias("band", "key"))
    hubs = stored(banded.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"))
    edges = banded.join(hubs, ["band", "key"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = stored(components(edges))

    members = groups.join(classes.select("node", "copies", "size"), "node")
    blocks = members.groupBy("root").agg(F.ceil(F.sum(F.greatest("size", F.lit(LEAST))) / block).alias("blocks"))
    members = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    texts = all_rows.select("row", F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash"))
    members = stored(members.join(texts, F.col("node") == F.col("row")).select("root", "node", "copies", "block", "blocks", "m_id", "m_hash"))
    twice = full.join(small_side(members.select("m_id", "m_hash"), 16), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))).groupBy("m_id", "m_hash").count().where("count > 1")
    found = plain.join(small_side(members, 80), F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))).select("root", "node", "copies", "block", "blocks", "text")
    if not twice.isEmpty():  # the same row several times
        found = found.dropDuplicates(["node"])
    return _finished(all_rows, classes, _sets(found, "text", n), keys, threshold)


def _finished(all_rows: DataFrame, classes: DataFrame, found: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("other")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    parts = found.select("*", other).withColumn("part", F.xxhash64("root", low, high)).withColumn("inner", F.col("block") == F.col("other"))
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.pmod(F.pmod(F.xxhash64("root"), F.lit(tasks)) + high * (high + 1) / 2 + low, F.lit(tasks)).cast("int")
    parts = parts.repartitionById(tasks, task).sortWithinPartitions("part", "node")
    links = stored(verified(parts, threshold))
    named = links.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    roots_ = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.join(named, "node", "left").join(roots_, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("set_id").alias("group_id"))
    known = stored(known.join(least, "root").select(*keys, "set_id", "group_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("root").alias("group")))
    out = all_rows.join(known, keys, "left")
    return out.select("id", "text_hash", F.coalesce("set_id", "id").alias("set_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group")


def representatives(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near duplicates the document with the least id, with the columns it came with; of repeated rows, one."""
    inner = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*inner.values())
    links = stored(joined(plain, inner[id_column], inner[text]))
    place = F.struct(F.col("id").isNull(), "id", "text_hash")
    first = stored(links.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("group is not null and n > 1").drop("n"))
    grouped = links.join(first, "group")
    gone = stored(grouped.where(place != F.col("first")).select(F.col("id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct())
    keyed = plain.withColumns(dict(zip(("key_id", "key_hash"), row_key(inner[id_column], inner[text]), strict=True)))
    left = keyed.join(small_side(gone, 40), F.col("key_id").eqNullSafe(F.col("g_id")) & (F.col("key_hash") == F.col("g_hash")), "left_anti")
    if not grouped.where(place == F.col("first")).groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["key_id", "key_hash"])  # the same row several times
    return left.select(*(F.col(x).alias(c) for c, x in inner.items()))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, set_id of every document."""
    return joined(docs).select(F.col("id").alias("doc_id"), F.col("group_id").alias("class_id"), "n_links", "set_id")
