"""Toxicity by a convolutional classifier, trained in numpy.

Words are embedded by hashing: a word's vector is the sum of rows chosen by the hashes of the word
and of its first bytes, so that unseen forms of a known stem are known too. Filters of one, two and
three words run over the text; the largest response of each over the whole text goes through a
rectifier into a logistic output. Scores are then calibrated by the language that the text's own
words suggest: the threshold that serves that language best is mapped to THRESHOLD.

Every labelled document is learned from, whole. They are dealt by hash to shards of about SHARD
documents and SHARD_BYTES; a task learns from one shard, STEPS steps in all, in ROUNDS rounds. After
each round the shards' networks are made one: a parameter moves by the mean of the shards that moved
it. A fifth, by hash, is set aside for the thresholds, which come from counts over all of it, by
score to 1 / GRADES. Languages are counted over all labelled documents. Scoring only maps: whole
texts, in numpy over Arrow batches. The model's size is fixed, and only it passes through the driver.

Defined results: null and empty texts get the score of a text in which no filter responds; null
labels and ids aren't learned from; without labels of both classes every score is the share of
toxic labels (0 without any); repeated rows are each scored; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import small_side, stored
from .text import LETTERS, Hasher, Texts, Words, sliced

#: Documents and bytes that a task learns from; with more there are more shards. A round's steps pass over all of a shard.
SHARD = 1 << 14
SHARD_BYTES = 64 << 20
ROUNDS = 3
#: Parameters in a row of those that are sent to be made one.
BLOCK = 1 << 15
#: Steps of the scores that are counted for the thresholds.
GRADES = 1 << 16
#: With fewer labelled documents, none is set aside.
LEAST = 100
THRESHOLD = 0.3

ROWS = 1 << 17
SIZE = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Bytes of a word's beginnings that are embedded, besides the whole word.
STEMS = (4, 5, 6)
BATCH = 64
STEPS = 900
RATE = 0.08
DROP = 0.15

#: What is trained.
PARAMETERS = ("e", "w", "b", "v", "c")

_STARTS = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]


class Encoded:
    """The words of some texts: `word`, the number of each among the different ones; `keys` and `rows`, the hash of these and what embeds them; `first`, the words before each text."""

    def __init__(self, texts: Texts):
        words = Words(texts, LETTERS, lower=True)
        hashed = Hasher(words.data)
        whole = hashed(words.start, words.end)
        self.keys, index, self.word = np.unique(whole, return_index=True, return_inverse=True)
        start, end = words.start[index], words.end[index]
        parts = [self.keys, *(hashed(start, np.minimum(end, start + k)) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in STEMS)]
        self.rows = np.stack([(p >> np.uint64(20)).astype(np.int32) & (ROWS - 1) for p in parts], 1)
        self.first = words.first

    @classmethod
    def joined(cls, parts: list[Encoded]) -> Encoded:
        out = object.__new__(cls)
        out.keys, index = np.unique(np.concatenate([p.keys for p in parts]), return_index=True)
        out.rows = np.concatenate([p.rows for p in parts])[index]
        out.word = np.concatenate([np.searchsorted(out.keys, p.keys).astype(np.int32)[p.word] for p in parts])
        before = np.cumsum([0] + [len(p.word) for p in parts[:-1]])
        out.first = np.concatenate([[0], *(n + p.first[1:] for n, p in zip(before, parts, strict=True))])
        return out

    def chosen(self, rows: np.ndarray) -> Encoded:
        out = object.__new__(Encoded)
        out.keys, out.rows = self.keys, self.rows
        parts = [self.word[self.first[t] : self.first[t + 1]] for t in rows]
        out.word = np.concatenate(parts)
        out.first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return out


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = r.normal(0, 0.1, (ROWS, SIZE)).astype(np.float32)
        self.w = r.normal(0, 0.3, (sum(WIDTHS), SIZE, FILTERS)).astype(np.float32)  # of each width, each place
        self.b = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.v = np.abs(r.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.c = np.float32(-1)
        self.langs: list[str] = []
        self.lang_log = np.zeros((ROWS, 0), np.float32)
        self.cuts = np.zeros(0)
        self.cut = 0.5
        self.sums = {k: np.full(np.shape(getattr(self, k)), 1e-3, np.float32) for k in PARAMETERS}  # of squared gradients

    def vector(self) -> np.ndarray:
        """All that training changes."""
        return np.concatenate([np.ravel(x) for k in PARAMETERS for x in (getattr(self, k), self.sums[k])])

    def put(self, vector: np.ndarray) -> None:
        at = 0
        for k in PARAMETERS:
            for held in (self.__dict__, self.sums):
                shape = np.shape(held[k])
                n = int(np.prod(shape))
                held[k] = vector[at : at + n].reshape(shape).astype(np.float32) if shape else np.float32(vector[at])
                at += n

    def responses(self, vectors: np.ndarray, word: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """For each width, the filters' responses at every place of texts that each are followed by two blanks; blanks don't respond."""
        n = len(counts)
        blank = len(vectors)
        padded = np.full(len(word) + 2 * n + 2, blank, np.int64)
        of = np.repeat(np.arange(n), counts)
        place = np.arange(len(word)) + 2 * of
        padded[place] = word
        table = np.concatenate([np.einsum("nd,kdf->nkf", vectors, self.w), np.zeros((1, sum(WIDTHS), FILTERS), np.float32)])
        silent = padded[: len(padded) - 2] == blank
        silent[(np.cumsum(counts) - counts + 2 * np.arange(n))[counts == 0]] = False  # an empty text is one blank
        out = []
        for i, width in enumerate(WIDTHS):
            y = np.broadcast_to(self.b[i], (len(silent), FILTERS)).copy()
            for k in range(width):
                y += table[:, _STARTS[i] + k][padded[k : k + len(silent)]]
            y[silent] = -np.inf
            y[np.flatnonzero(~silent & (padded[: len(silent)] == blank))] = self.b[i]
            out.append(y)
        return out

    def logits(self, enc: Encoded) -> np.ndarray:
        counts = np.diff(enc.first)
        ys = self.responses(self.e[enc.rows].sum(1), enc.word, counts)
        begin = np.cumsum(counts) - counts + 2 * np.arange(len(counts))
        h = np.concatenate([np.maximum(np.maximum.reduceat(y, begin, axis=0), 0) for y in ys], 1)
        return h @ self.v + self.c

    def language(self, enc: Encoded) -> np.ndarray:
        """The number of the language that the words suggest; without words, or languages, -1."""
        counts = np.diff(enc.first)
        if not self.langs:
            return np.full(len(counts), -1)
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.lang_log[enc.rows[:, 0]][enc.word], 0, dtype=np.float64)])
        return np.where(counts > 0, (sums[enc.first[1:]] - sums[enc.first[:-1]]).argmax(1), -1)

    def scores(self, texts: Texts) -> np.ndarray:
        enc = Encoded(texts)
        raw = 1 / (1 + np.exp(-self.logits(enc).astype(np.float64)))
        cut = np.append(self.cuts, self.cut)[self.language(enc)]
        return np.where(raw < cut, THRESHOLD * raw / cut, THRESHOLD + (1 - THRESHOLD) * (raw - cut) / (1 - cut))

    def train(self, enc: Encoded, toxic: np.ndarray, steps: int = STEPS, seed: int | list[int] = 11, share: float | None = None, done: float = 0, part: float = 1) -> None:
        """Logistic loss, both classes alike in weight; Adagrad; some words are left out at random.

        share: of toxic documents, if these are some of them; the steps are `part` of the training, of which `done` lies before them.
        """
        r = np.random.default_rng(seed)
        share = toxic.mean() if share is None else share
        weight = np.where(toxic > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        sums = self.sums
        order = np.zeros(0, int)
        for step in range(steps):
            if len(order) < min(BATCH, len(toxic)):
                order = np.append(order, r.permutation(len(toxic)))
            rows, order = order[:BATCH], order[BATCH:]
            rate = RATE * (1 - 0.8 * (done + part * step / steps))
            words = [enc.word[enc.first[t] : enc.first[t + 1]] for t in rows]
            words = [w[r.random(len(w)) >= DROP] for w in words]
            counts = np.array([len(w) for w in words])
            used, local = np.unique(np.concatenate(words), return_inverse=True)
            ids = enc.rows[used]
            vectors = self.e[ids].sum(1)
            begin = np.cumsum(counts) - counts + 2 * np.arange(len(rows))
            padded = np.full(int(counts.sum()) + 2 * len(rows) + 2, len(used), np.int64)
            padded[np.arange(len(local)) + 2 * np.repeat(np.arange(len(rows)), counts)] = local
            ys = self.responses(vectors, local, counts)
            at = [np.stack([b + y[b : b + max(1, n)].argmax(0) for b, n in zip(begin, counts, strict=True)]) for y in ys]
            peak = [np.take_along_axis(y, a, 0) for y, a in zip(ys, at, strict=True)]
            h = np.maximum(np.concatenate(peak, 1), 0)
            z = h @ self.v + self.c
            dz = ((1 / (1 + np.exp(-z)) - toxic[rows]) * weight[rows] / len(rows)).astype(np.float32)
            dh = dz[:, None] * self.v * (h > 0)
            grads = {"v": dz @ h + 1e-4 * self.v, "c": dz.sum(), "b": np.zeros_like(self.b), "w": 1e-5 * self.w}
            dx = np.zeros((len(used) + 1, SIZE), np.float32)
            x = np.concatenate([vectors, np.zeros((1, SIZE), np.float32)])
            for i, width in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                grads["b"][i] = d.sum(0)
                for k in range(width):
                    word = padded[at[i] + k]
                    grads["w"][_STARTS[i] + k] += np.einsum("bf,bfd->df", d, x[word])
                    np.add.at(dx, word, d[:, :, None] * self.w[_STARTS[i] + k].T[None])
            for name, g in grads.items():
                sums[name] = sums[name] + g * g
                setattr(self, name, (getattr(self, name) - rate * g / np.sqrt(sums[name])).astype(np.float32))
            hit = np.flatnonzero(np.abs(dx[:-1]).sum(1))
            if len(hit):
                flat, g = ids[hit].ravel(), np.repeat(dx[hit], ids.shape[1], 0)
                np.add.at(sums["e"], flat, g * g)
                np.subtract.at(self.e, flat, rate * g / np.sqrt(sums["e"][flat]))

    def learn_languages(self, counts: list[tuple[str, int, int]]) -> None:
        """counts: language, row of a word, and how often it stands in texts of the language."""
        self.langs = sorted({lang for lang, _, _ in counts})
        number = {lang: k for k, lang in enumerate(self.langs)}
        n = np.full((ROWS, len(self.langs)), 0.1)
        for lang, row, times in counts:
            n[row, number[lang]] += times
        self.lang_log = np.log(n / n.sum(0)).astype(np.float32)

    def calibrate(self, lang: np.ndarray, raw: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> None:
        """The cut of each language, and of all, halfway between the scores around the best F1. Documents of a language, score and class are counted."""
        self.cut = best_cut(raw, toxic, times, 0.5)
        self.cuts = np.array([best_cut(raw[lang == k], toxic[lang == k], times[lang == k], self.cut) for k in range(len(self.langs))])


def best_cut(raw: np.ndarray, toxic: np.ndarray, weight: np.ndarray, otherwise: float, least: int = 15) -> float:
    """With a weight of fewer than `least` documents of either class, `otherwise`."""
    if min((toxic * weight).sum(), ((1 - toxic) * weight).sum()) < least:
        return otherwise
    order = np.argsort(-raw)
    s, y, w = raw[order], toxic[order], weight[order]
    hits, all_ = np.cumsum(y * w), np.cumsum(w)
    f1 = 2 * hits / (all_ + (y * w).sum())
    f1[np.append(s[1:] == s[:-1], False)] = -1
    k = int(f1.argmax())
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float(np.clip((s[k] + below) / 2, 0.02, 0.98))


def _encoded(values: Sequence[str]) -> Encoded:
    """A slice of the texts at a time, since hashing takes many times their size."""
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.large_string())], names=["text"])
    return Encoded.joined([Encoded(texts) for _, texts in sliced(batch, "text")])


def _learned(rows: DataFrame, net: Network, number: int, share: float) -> np.ndarray:
    """By how much a round moves the network's vector. The rows (shard, h, toxic, text) of a shard stand together in a partition."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (tuple(r.values()) for batch in batches for r in batch.to_pylist())
        before = shared.value.vector()
        for shard, own in groupby(each, key=lambda r: r[0]):
            _, _, toxic, texts = zip(*sorted(own, key=lambda r: (r[1], r[3])), strict=True)
            mine = Network()
            mine.put(before)
            mine.train(_encoded(texts), np.array(toxic, np.float64), STEPS // ROUNDS, [11, shard, number], share, number / ROUNDS, 1 / ROUNDS)
            moved = mine.vector() - before
            for k, at in enumerate(range(0, len(moved), BLOCK)):
                yield pa.RecordBatch.from_pylist([{"shard": shard, "block": k, "moved": moved[at : at + BLOCK].tobytes()}])

    def mean(blocks: pa.Table) -> pa.Table:
        total = moved = 0
        for _, x in sorted(zip(blocks["shard"].to_pylist(), blocks["moved"], strict=True), key=lambda r: r[0]):
            x = np.frombuffer(x.as_py(), np.float32)
            total, moved = total + x.astype(np.float64), moved + (x != 0)
        return pa.Table.from_pylist([{"block": blocks["block"][0].as_py(), "moved": (total / np.maximum(moved, 1)).astype(np.float32).tobytes()}])

    blocks = rows.mapInArrow(learn, "shard long, block long, moved binary").groupBy("block").applyInArrow(mean, "block long, moved binary").collect()
    shared.unpersist()
    return np.concatenate([np.frombuffer(r.moved, np.float32) for r in sorted(blocks, key=lambda r: r.block)])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, row, times: the rows of the words of texts of each language, counted in slices."""
    for batch in batches:
        for part, texts in sliced(batch, "text"):
            enc = Encoded(texts)
            names = part.column(0).dictionary_encode()
            of = np.repeat(names.indices.to_numpy(zero_copy_only=False), np.diff(enc.first))
            each, times = np.unique(of.astype(np.int64) * ROWS + enc.rows[enc.word, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(each // ROWS)), pa.array(each % ROWS), pa.array(times.astype(np.int64))], names=["lang", "row", "times"])


def _grades(rows: DataFrame, net: Network) -> DataFrame:
    """number of the language, grade of the score, toxic, and how many of the rows (toxic, text) have them."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                enc = Encoded(texts)
                raw = 1 / (1 + np.exp(-shared.value.logits(enc).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.language(enc).astype(np.int64)), pa.array(np.rint(raw * GRADES).astype(np.int64)), part.column(0)], names=["lang", "grade", "toxic"])

    return rows.select("toxic", "text").mapInArrow(grade, "lang long, grade long, toxic long").groupBy("lang", "grade", "toxic").count()


def fit(docs: DataFrame, labels: DataFrame, lang: str = "lang", shard: int = SHARD) -> Network | float:
    """A trained network, or where a class is missing the share of toxic labels. docs: doc_id, text and lang; labels: doc_id and toxic, at most one a document."""
    known = stored(labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")))
    classes = [r.toxic for r in known.select("toxic").distinct().collect()]
    if len(classes) < 2:
        return float(max(classes, default=0))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang")).join(small_side(known, 16), "doc_id")
    n, toxic, size = found.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not 0 < toxic < n:
        return toxic / n if n else 0.0
    shards = max(-(-n // shard), -(-size // SHARD_BYTES))
    h = F.xxhash64("doc_id", "text")
    dealt = found.select(F.pmod(F.xxhash64(h, F.lit(1)), F.lit(shards)).alias("shard"), h.alias("h"), "toxic", "text", "lang", ((F.pmod(h, F.lit(5)) == 0) & F.lit(n >= LEAST)).alias("aside"))
    # a file for each shard, too small for more than one row group, so that one task reads it in every round
    dealt = stored(dealt.repartitionById(shards, F.col("shard").cast("int")))
    net = Network()
    counted = dealt.where("lang is not null").select("lang", "text").mapInArrow(_word_rows, "lang string, row long, times long").groupBy("lang", "row").agg(F.sum("times").alias("times")).toArrow()
    net.learn_languages(list(zip(*(counted[c].to_pylist() for c in ("lang", "row", "times")), strict=True)))
    own = dealt.where("not aside").select("shard", "h", "toxic", "text")
    for number in range(ROUNDS):
        net.put(net.vector() + _learned(own, net, number, toxic / n))
    net.sums = {}  # not needed to score
    grades = _grades(dealt.where("aside"), net).toArrow()
    column = lambda c: grades[c].to_numpy().astype(np.float64)
    net.calibrate(column("lang"), column("grade") / GRADES, column("toxic"), column("count"))
    return net


def scored(docs: DataFrame, model: Network | float, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every document and its score."""
    names = [f"c{i}" for i in range(len(keep))]
    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                score = m.scores(texts) if isinstance(m, Network) else np.full(texts.rows, m)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], names=[*names, "score"])

    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).alias("text"))
    return source.mapInArrow(run, f"{fields}score double").toDF(*keep, "score")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; a quarter of the documents, by id, is held out of training."""
    model = fit(docs, labels.where(~held_out()))
    return scored(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
