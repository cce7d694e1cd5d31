"""Language-model scoring by cross-entropy difference.

Two models of word pairs, of one order and one smoothing, share one vocabulary: the classes that
op3's words fall into by a hash, 2**VOCABULARY of them. The background model is counted from all
documents, the target model from those marked as target. A document's score is the mean, over its
words, of the target model's loss less the background model's; the less, the more it is like the
target. No document is scored by its own words: they are taken off both models' counts first.

The probability of word w after b, or after a start sign, has a Dirichlet prior of weight PRIOR:
(n(b, w) + PRIOR * p(w)) / (n(b) + PRIOR), with p(w) = (n(w) + 1) / (all + classes). Its logarithm
falls into terms of b, of w, and of the pair, the last being nought where the pair occurs nowhere
else. So pairs that occur once only are never needed again.

Counts of words and of the FREQUENT pairs add up within tasks and before the shuffle, and are
broadcast; their number is bounded. A sample of documents tells which pairs are frequent, so that no
key of the shuffle below is; which way a pair goes doesn't change its term. All other pairs are
shuffled by pair, each with the number of its text. Where they meet they are counted, and the terms
of those that other texts have too are summed by text before they go back to it. So the shuffle
grows with the corpus, in proportion.

Defined results: null texts and texts without words have no tokens and null losses; without a target
document the target model is uniform; repeated rows count and are scored each, by one another too;
labels of ids that several documents have count for each; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import small_side, stored
from .text import LETTERS, Hasher, Texts, Words, sliced

#: Bits of a word's class; class 0 is the start sign.
VOCABULARY = 20
PRIOR = 20.0
#: Pairs whose counts are broadcast, at most, and the share of documents that they are chosen from, as 1 of so many.
FREQUENT = 1_000_000
SAMPLE = 16


class Pairs(NamedTuple):
    """Words of some texts: text, class, class of the word before, and the pair as one number. counts: words of each text."""

    text: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    counts: np.ndarray


def pairs(texts: Texts, bits: int = VOCABULARY) -> Pairs:
    words = Words(texts, LETTERS, lower=True)
    word = np.maximum(Hasher(words.data)(words.start, words.end) >> np.uint64(64 - bits), np.uint64(1)).astype(np.int64)
    before = np.concatenate((np.zeros(1, np.int64), word))[:-1]
    before[words.first[:-1][words.counts > 0]] = 0
    return Pairs(words.text, word, before, before << bits | word, words.counts)


def frequent_pairs(docs: DataFrame, text: str = "text", most: int = FREQUENT, sample: int = SAMPLE, bits: int = VOCABULARY) -> np.ndarray:
    """The most frequent pairs of every sample-th document, `most` at most, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in sliced(batch, "text"):
                key, n = np.unique(pairs(texts, bits).pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")).where(F.pmod(F.xxhash64("row"), F.lit(sample)) == 0)
    found = chosen.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    return np.sort(found.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()["key"].to_numpy())


class Model:
    """Counts of words, of words as the one before, and of frequent pairs, in the background and in the target."""

    def __init__(self, bits: int, prior: float, keys: np.ndarray):
        self.bits, self.prior, self.keys = bits, prior, keys
        self.words, self.contexts = np.zeros((2, 1 << bits), np.int64), np.zeros((2, 1 << bits), np.int64)
        self.pairs = np.zeros((2, len(keys)), np.int64)

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.words, self.contexts, self.pairs

    def find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are frequent, and their places."""
        at = np.minimum(np.searchsorted(self.keys, pair), max(len(self.keys) - 1, 0))
        return (self.keys[at] == pair) if len(self.keys) else np.zeros(len(pair), bool), at

    def add(self, p: Pairs, marked: np.ndarray) -> None:
        known, at = self.find(p.pair)
        for table, index, of in ((self.words, p.word, p.text), (self.contexts, p.before, p.text), (self.pairs, at[known], p.text[known])):
            table[0] += np.bincount(index, minlength=table.shape[1])
            table[1] += np.bincount(index[marked[of]], minlength=table.shape[1])

    def lower(self, word: np.ndarray, times: np.ndarray, size: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Probabilities, times the prior, of words in texts where they occur so often, of that size, without the text: a row for each model."""
        own = np.stack([np.ones(len(word)), marked])
        return self.prior * (self.words[:, word] - own * times + 1) / (self.words.sum(1)[:, None] - own * size + (1 << self.bits))


def counted(docs: DataFrame, target: Column, text: str = "text", bits: int = VOCABULARY, prior: float = PRIOR, frequent: int = FREQUENT, sample: int = SAMPLE) -> Model:
    """The model of these documents and this target."""
    empty = Model(bits, prior, frequent_pairs(docs, text, frequent, sample, bits))
    shared = docs.sparkSession.sparkContext.broadcast(empty.keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(bits, prior, shared.value)
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                m.add(pairs(texts, bits), part["target"].to_numpy(zero_copy_only=False).astype(bool))
        for kind, table in enumerate(m.tables):
            at = np.flatnonzero(table[0])
            for k in range(0, len(at), 100_000):
                part = at[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), *(pa.array(table[i, part]) for i in range(2))], names=["kind", "at", "background", "target"])

    source = docs.where(F.col(text).isNotNull()).select(F.coalesce(target, F.lit(False)).alias("target"), F.col(text).alias("text"))
    found = source.mapInArrow(run, "kind int, at long, background long, target long").groupBy("kind", "at").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))
    found = found.select((F.col("at") * 4 + F.col("kind")).alias("code"), "background", "target").toArrow()
    code = found["code"].to_numpy()
    for kind, table in enumerate(empty.tables):
        own = code % 4 == kind
        for i, name in enumerate(("background", "target")):
            table[i, code[own] // 4] = found[name].to_numpy()[own]
    return empty


def _own(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) in order, as first places in order, the order, and how often each occurs."""
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    start = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]))) if len(k) else np.zeros(0, np.int64)
    return start, order, np.diff(np.append(start, len(k)))


def _times(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each key occurs in its text."""
    _, order, n = _own(key, text)
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(n, n)
    return out


_FIELDS = "row long, pair long, n int, marked boolean, times int, size long"
_SUMS = "n_tokens long, background double, target double"


def scored(docs: DataFrame, model: Model, target: Column, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every document, n_tokens, background and target, the mean losses, and difference. model: counted() of these documents and this target; keep: of types that have an order."""
    names = [f"c{i}" for i in range(len(keep))]
    models = ("background", "target")
    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    other = [f.split()[0] for f in _FIELDS.split(", ")]

    def texts_and_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text - its pair is negative - with what the words and frequent pairs say, and one for each other pair of it."""
        m: Model = shared.value
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                marked = part["marked"].to_numpy(zero_copy_only=False).astype(bool)
                p = pairs(texts, m.bits)
                lower = m.lower(p.word, times := _times(p.word, p.text), p.counts[p.text], marked[p.text])
                own = np.stack([np.ones(len(p.text)), marked[p.text]])
                each = np.log(m.contexts[:, p.before] - own * _times(p.before, p.text) + m.prior) - np.log(lower)
                start, order, n = _own(p.pair, p.text)
                first = order[start]
                known, at = m.find(p.pair[first])
                use = first[known]
                each[:, use] -= n[known] * np.log1p((m.pairs[:, at[known]] - own[:, use] * n[known]) / lower[:, use])
                upto = np.concatenate((np.zeros((2, 1)), np.cumsum(each, 1)), 1)
                edge = np.concatenate(([0], np.cumsum(p.counts)))
                sums = upto[:, edge[1:]] - upto[:, edge[:-1]]
                row = part["row"].to_numpy()
                none = pa.nulls(texts.rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], part["row"], pa.array(-1 - row), none, part["marked"], none, pa.nulls(texts.rows, pa.int64()), pa.array(p.counts.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                    names=[*names, *other, "n_tokens", *models],
                )
                rest, n = first[~known], n[~known]
                of = p.text[rest]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.nulls(len(rest), c.type) for c in part.columns[: len(names)]),
                        *(pa.array(x) for x in (row[of], p.pair[rest], n.astype(np.int32), marked[of], times[rest].astype(np.int32), p.counts[of].astype(np.int64))),
                        pa.nulls(len(rest), pa.int64()), *(pa.nulls(len(rest), pa.float64()) for _ in models),
                    ],
                    names=[*names, *other, "n_tokens", *models],
                )

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of texts as they are, and the terms of their pairs, added up by text in each batch. Rows come sorted by pair."""
        m: Model = shared.value
        carried: list[np.ndarray] | None = None
        kinds: list[pa.DataType] = []

        def terms(columns: list[np.ndarray]) -> pa.RecordBatch:
            row, pair, n, marked, times, size = columns
            start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pair))))
            own = np.stack([n, n * marked])
            others = np.stack([np.add.reduceat(x, start) for x in own])[:, group] - own
            use = np.flatnonzero(others[0] > 0)
            lower = m.lower(pair[use] & ((1 << m.bits) - 1), times[use], size[use], marked[use])
            each = -n[use] * np.log1p(others[:, use] / lower)
            rows, at = np.unique(row[use], return_inverse=True)
            sums = [np.bincount(at, x, len(rows)).astype(float) for x in each]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in kinds), pa.array(rows), pa.nulls(len(rows), pa.int64()), *(pa.array(x) for x in sums)], names=[*names, "row", "n_tokens", *models])

        for batch in batches:
            kinds = [c.type for c in batch.columns[: len(names)]]
            pair = batch["pair"].to_numpy()
            n_texts = int(np.searchsorted(pair, 0))
            if n_texts:
                kept = [*names, "row", "n_tokens", *models]
                yield pa.RecordBatch.from_arrays([batch[c].slice(0, n_texts) for c in kept], names=kept)
            if n_texts == len(pair):
                continue
            columns = [batch[c].slice(n_texts).to_numpy(zero_copy_only=False) for c in other]
            columns[3] = columns[3].astype(np.int64)
            columns = [x.astype(np.int64) for x in columns]
            if carried is not None:
                columns = [np.concatenate(x) for x in zip(carried, columns, strict=True)]
            whole = int(np.searchsorted(columns[1], columns[1][-1]))  # the last pair may go on
            carried = [x[whole:] for x in columns]
            if whole:
                yield terms([x[:whole] for x in columns])
        if carried is not None:
            yield terms(carried)

    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.monotonically_increasing_id().alias("row"), F.coalesce(target, F.lit(False)).alias("marked"), F.col(text).alias("text"))
    rows = source.mapInArrow(texts_and_pairs, f"{fields}{_FIELDS}, {_SUMS}").repartition("pair").sortWithinPartitions("pair")
    sums = rows.mapInArrow(met, f"{fields}row long, {_SUMS}").groupBy("row").agg(*(F.max(n).alias(n) for n in names), *(F.sum(c).alias(c) for c in ("n_tokens", *models)))
    mean = {m: F.when(F.col("n_tokens") > 0, F.col(m) / F.col("n_tokens")) for m in models}
    return sums.select(*names, "n_tokens", *(v.alias(m) for m, v in mean.items()), (mean["target"] - mean["background"]).alias("difference")).toDF(*keep, "n_tokens", *models, "difference")


def report(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_tokens, background, target, difference; the target is the documents labelled as of good quality."""
    good = stored(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct())
    marked = docs.select("doc_id", "text").join(small_side(good, 16), F.col("doc_id") == F.col("good_id"), "left")
    target = F.col("good_id").isNotNull()
    return scored(marked, counted(marked, target, **parameters), target, ["doc_id"])
