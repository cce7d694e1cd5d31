"""Benchmark decontamination by Wu-Manber search of many patterns at once, over words.

A pattern is a window of 13 consecutive words of a benchmark item, or all words of a shorter one.
For patterns of one length, a shift table tells for each block of two words how far the search may
go on, since no pattern has that block nearer to its end. Where the shift is nought, the block's
hash selects a bucket of patterns that end in it; those whose first words also agree are compared
word by word. The search advances all texts of an Arrow batch side by side, in numpy.

Documents are only mapped: no text is shuffled. The benchmark is taken in blocks of BLOCK_BYTES, which
take about 12 times that in memory, 50 times while they are made, one at a time: each but the last is searched for by a job of its
own, which leaves the places of its occurrences, and the last meets those of the others.

Defined results: null and empty texts have no words and are clean; items without words have no
windows; windows of rows without an id hit words like others, but are no item, repeated rows count once; repeated
documents are each reported; other columns of the documents may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import BROADCAST_BYTES, stored
from .text import LETTERS, Hasher, Texts, Words, chained, mixed, sliced

WINDOW = 13
#: Bytes of benchmark text in one broadcast; more is searched for in further passes.
BLOCK_BYTES = 8 << 20
#: Window starts that one cursor of the search is in charge of.
SEGMENT = 128

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Items:
    """Words of benchmark items: `data`, and where each word starts and ends; `hash` of each; `ids`, in order as strings, and for each text its id's number; first: the words before each text."""

    def __init__(self, ids: list[str | None], texts: Texts):
        words = Words(texts, LETTERS, lower=True)
        self.data, self.start, self.end, self.first = words.data, words.start.astype(np.int32), words.end.astype(np.int32), words.first
        self.hash = Hasher(words.data)(words.start, words.end)
        self.ids = sorted(set(ids), key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(self.ids)}
        self.own = np.array([number[x] for x in ids], np.int32)


class Patterns:
    """Windows of `length` words, with the tables of the search. at: the first word of each, one for equal ones."""

    def __init__(self, items: Items, at: np.ndarray, own: np.ndarray, length: int):
        self.length, self.block = length, min(2, length)
        h = items.hash
        # equal windows are one pattern; windows are told apart by the hashes of all their words
        key = chained(h, length)[at]
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        for k in range(length):
            new[1:] |= h[at[order[1:]] + k] != h[at[order[:-1]] + k]
        group = np.cumsum(new) - 1
        pairs = np.unique(np.stack((group, own[order])), axis=1)
        self.at = at[order[new]].astype(np.int32)
        self.own, self.edges = pairs[1].astype(np.int32), np.searchsorted(pairs[0], np.arange(len(self.at) + 1))
        blocks = h if self.block == 1 else np.append(mixed(h[:-1] * _ODD + h[1:]), np.uint64(0))
        bits = max(16, min(len(h), len(self.at) * length).bit_length() + 4)
        self.mask = np.uint64((1 << bits) - 1)
        most = length - self.block + 1
        self.shift = np.full(1 << bits, min(most, 127), np.int8)
        for k in range(most):  # the further to the right, the smaller the shift
            self.shift[(blocks[self.at + k] & self.mask).astype(np.int64)] = min(most - 1 - k, 127)
        suffix = blocks[self.at + most - 1]
        order = np.argsort(suffix, kind="stable")
        self.suffixes, self.at = suffix[order], self.at[order]
        low, high = self.edges[:-1][order], self.edges[1:][order]
        self.low, self.high = low.astype(np.int32), high.astype(np.int32)

    def search(self, items: Items, words: Words, hashed: Hasher) -> Iterator[tuple[int, int]]:
        """(number of the window's first word, pattern) of each occurrence."""
        m = self.length
        starts = np.maximum(words.counts - m + 1, 0)  # window starts of each text
        parts = -(-starts // SEGMENT)
        total = int(parts.sum())
        if not total:
            return
        nth = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)
        text = np.repeat(np.arange(len(parts)), parts)
        cursor = words.first[text] + nth * SEGMENT + m - 1  # the last word of the window
        stop = words.first[text] + np.minimum((nth + 1) * SEGMENT, starts[text]) + m - 2
        found_at, found = [], []
        while len(cursor):
            key = hashed(words.start[cursor], words.end[cursor])
            if self.block == 2:
                key = mixed(hashed(words.start[cursor - 1], words.end[cursor - 1]) * _ODD + key)
            shift = self.shift[(key & self.mask).astype(np.int64)]
            if (hit := np.flatnonzero(shift == 0)).size:
                low, high = (np.searchsorted(self.suffixes, key[hit], side=x) for x in ("left", "right"))
                found_at.append(np.repeat(cursor[hit] - m + 1, high - low))
                found.append(np.arange(int((high - low).sum())) + np.repeat(low - np.concatenate(([0], np.cumsum(high - low)[:-1])), high - low))
            cursor = cursor + np.maximum(shift, 1)
            on = cursor <= stop
            cursor, stop = cursor[on], stop[on]
        if not found_at:
            return
        at, pattern = np.concatenate(found_at), np.concatenate(found)
        for k in range(m):  # the first word, then the others
            same = items.hash[self.at[pattern] + k] == hashed(words.start[at + k], words.end[at + k])
            at, pattern = at[same], pattern[same]
        for begin, i in zip(at.tolist(), pattern.tolist(), strict=True):
            if self.same(items, words, begin, i):
                yield begin, i

    def same(self, items: Items, words: Words, begin: int, i: int) -> bool:
        """Word by word, byte by byte."""
        own = range(self.at[i], self.at[i] + self.length)
        return all(words.data[words.start[begin + k] : words.end[begin + k]].tobytes() == items.data[items.start[j] : items.end[j]].tobytes() for k, j in enumerate(own))

    def ids(self, items: Items, i: int) -> list[str]:
        return [x for k in self.own[self.low[i] : self.high[i]].tolist() if (x := items.ids[k]) is not None]


class Block(NamedTuple):
    """A part of the benchmark, and its patterns by length."""

    items: Items
    patterns: list[Patterns]


def block_of(ids: list[str | None], texts: pa.Array, length: int = WINDOW) -> Block:
    items = Items(ids, Texts(texts))
    counts = np.diff(items.first)
    found = []
    for n in np.unique(np.minimum(counts[counts > 0], length)).tolist():
        of = np.flatnonzero(np.minimum(counts, length) == n)
        windows = counts[of] - n + 1
        at = np.repeat(items.first[of], windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        found.append(Patterns(items, at, np.repeat(items.own[of], windows), n))
    return Block(items, found)


def blocks_of(benchmark: DataFrame, length: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in as many blocks as it takes, one at a time."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("text is not null").distinct()
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        rows = b.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).toArrow().combine_chunks()
        texts = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
        yield block_of(rows["item"].to_pylist(), texts, length)


def occurrences(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", length: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns `keep` of every document, then its words, the words that occurrences cover, and the ids of the items found.

    n_words long, n_hit long, items array<string> (distinct, sorted as strings).
    """
    sc = docs.sparkSession.sparkContext
    names = [f"c{i}" for i in range(len(keep))]
    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).alias("text"))
    empty = [F.array().cast("array<long>").alias("hits"), F.array().cast("array<string>").alias("items")]
    blocks = blocks_of(benchmark, length, block_bytes)
    block, parts = next(blocks), []
    for following in blocks:
        keyed = docs.select(F.xxhash64(text).alias("text_hash"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"), F.col(text).alias("text"))
        parts.append(stored(keyed.mapInArrow(_places(sc.broadcast(block)), "text_hash long, size int, hits array<long>, items array<string>").dropDuplicates(["text_hash", "size"])))
        block = following
    if parts:
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        both = stored(both.groupBy("text_hash", "size").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items")))
        total = both.agg(F.sum(8 * F.size("hits") + 40 * F.size("items") + 64)).first()[0] or 0
        keyed = source.withColumns({"key_hash": F.xxhash64("text"), "key_size": F.coalesce(F.octet_length("text"), F.lit(0))})
        joined = keyed.join(F.broadcast(both) if total <= BROADCAST_BYTES else both, (F.col("key_hash") == F.col("text_hash")) & (F.col("key_size") == F.col("size")), "left")
        source = joined.select(*names, "text", *(F.coalesce(c, e).alias(c) for c, e in zip(("hits", "items"), empty, strict=True)))
    else:
        source = source.select(*names, "text", *empty)
    return source.mapInArrow(_counted(sc.broadcast(block), names), f"{fields}n_words long, n_hit long, items array<string>").toDF(*keep, "n_words", "n_hit", "items")


def _found(block: Block, words: Words) -> Iterator[tuple[int, int, int, list[str]]]:
    """text, first word, words and items of each occurrence."""
    hashed = Hasher(words.data)
    for p in block.patterns:
        for begin, i in p.search(block.items, words, hashed):
            yield int(np.searchsorted(words.first, begin, side="right")) - 1, begin, p.length, p.ids(block.items, i)


def _places(block) -> Callable:
    """Of the texts with occurrences, these - first word in the text, and words, in turn - and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                words = Words(texts, LETTERS, lower=True)
                hits: dict[int, list[int]] = {}
                ids: dict[int, set[str]] = {}
                for t, begin, n, own in _found(block.value, words):
                    hits.setdefault(t, []).extend((begin - int(words.first[t]), n))
                    ids.setdefault(t, set()).update(own)
                row = pa.array(list(hits), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part["text_hash"].take(row), part["size"].take(row), pa.array(list(hits.values()), pa.list_(pa.int64())), pa.array([sorted(x) for x in ids.values()], pa.list_(pa.string()))],
                    names=["text_hash", "size", "hits", "items"],
                )

    return run


def _counted(block, names: list[str]) -> Callable:
    """The words of every text, those that occurrences cover, here or among the hits it comes with, and all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                words = Words(texts, LETTERS, lower=True)
                edges = np.zeros(len(words) + 1, np.int32)
                items = [set(x) for x in part["items"].to_pylist()]
                for t, pairs in enumerate(part["hits"].to_pylist()):
                    for begin, n in zip(pairs[::2], pairs[1::2], strict=True):
                        edges[words.first[t] + begin] += 1
                        edges[words.first[t] + begin + n] -= 1
                for t, begin, n, own in _found(block.value, words):
                    items[t].update(own)
                    edges[begin] += 1
                    edges[begin + n] -= 1
                covered = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
                n_hit = covered[words.first[1:]] - covered[words.first[:-1]]
                ids = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(words.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), ids], names=[*names, "n_words", "n_hit", "items"])

    return run


def contaminated():
    """The rule on occurrences(): at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rule leaves, with the columns they came with."""
    inner = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    marked = occurrences(docs.toDF(*inner.values()), benchmark, list(inner.values()), inner[text])
    return marked.where(~contaminated()).select(*(F.col(n).alias(c) for c, n in inner.items()))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the items, comma-joined, of every document."""
    found = occurrences(docs, benchmark, ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.array_join("items", ",").alias("items"),
    )
