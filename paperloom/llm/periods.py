"""Periodic runs of words: stretches that repeat a period of words three times or more.

Seed and extend on diagonals. A run with period q and length L holds L - q words that equal the word q
places on, at least max(24 - q, 2 q) of them. So for periods up to 16 every run holds a seed, equal
16-grams q places apart, and for periods in (k / 2, k], k = 32, 64, ..., equal k-grams. A k-gram of a
run covers its whole period, so between a seed's two places the k-gram can't occur again, or a shorter
period would hold for the run: seeds are only sought between one occurrence of a k-gram and the next of
the same document. Their number is at most that of the words, however often a k-gram occurs, and the
diagonals that they lie on are those of smallest periods. Hashes of k-grams are made from those of half
their length; only words whose k-gram occurs twice are looked at in the next step.

Seeds are taken diagonal by diagonal, left to right. A table of how far each lag is covered suppresses
those that the last extension reached; others are extended both ways, word by word. Words and k-grams
are compared by 64-bit hashes. A text is taken whole, about 150 bytes of memory for each word.

Defined results: null texts and texts without words have no runs, and no words to keep. Ties for the
greatest exponent go to the least start, then the least period. Repeated rows are documents of their own.
Documents without an id are not changed before the search. Further columns are ignored by report() and
kept by collapsed(). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import spare
from .text import INK, U64, Hasher, Texts, Words, mixed, sliced

#: Words that a run has at least, and times that it holds its period.
LEAST, TIMES = 24, 3
#: Length of the first seeds: what LEAST and TIMES guarantee for every period, at period 8.
SEED = 16


class Runs:
    """Runs of some texts, by text, start and period; a run is words [start, start + length) of its text."""

    def __init__(self, words: Words):
        self.words = words
        self.of = words.text
        begin, end = words.first[:-1][self.of], words.first[1:][self.of]
        h = Hasher(words.data)(words.start, words.end)
        found = [np.zeros((3, 0), np.int64)]
        grams, k = h, 1
        while k < SEED:
            grams, k = self._doubled(grams, k), 2 * k
        alive = np.flatnonzero(np.arange(len(grams)) + k <= end[: len(grams)]) if len(grams) else np.zeros(0, np.int64)
        least = 1
        while len(alive):
            key = mixed(grams[alive] + self.of[alive].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            left, right = alive[order[:-1][same]], alive[order[1:][same]]
            lag = right - left
            use = (lag >= least) & (lag <= k)
            found.append(self._extended(h, left[use], lag[use], k, begin, end))
            again = np.zeros(len(alive), bool)
            again[order[:-1][same]] = again[order[1:][same]] = True
            alive, least = alive[again], k + 1
            grams, k = self._doubled(grams, k), 2 * k
            alive = alive[alive + k <= end[alive]]
        start, length, period = np.concatenate(found, 1)
        order = np.lexsort((period, start))
        start, self.length, self.period = start[order], length[order], period[order]
        self.text = self.of[start]
        self.first_word = start
        self.start = start - words.first[self.text]
        self.edge = np.searchsorted(self.text, np.arange(len(words.counts) + 1))

    @staticmethod
    def _doubled(grams: np.ndarray, k: int) -> np.ndarray:
        """Hashes of 2k words from those of k."""
        return mixed(grams[:-k] * U64(0xD6E8FEB86659FD93) + mixed(grams[k:])) if len(grams) > k else grams[:0]

    @staticmethod
    def _extended(h: np.ndarray, left: np.ndarray, lag: np.ndarray, k: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """start, length, period of the runs around these seeds, the words [left, left + k) and those a lag on."""
        order = np.lexsort((left, lag))
        left, lag = left[order], lag[order]
        fresh = np.append(True, (lag[1:] != lag[:-1]) | (left[1:] > left[:-1] + 1)) if len(left) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        # what the seeds that follow on each other cover of their diagonal
        low, high, lag = left[at], (left[np.append(at[1:], len(left)) - 1] + k if len(at) else left), lag[at]
        wide = high - low + lag >= np.maximum(LEAST, TIMES * lag)
        low, high, lag = low[wide], high[wide], lag[wide]
        first, last = begin[low], end[low]
        while (more := (low > first) & (h[low - 1] == h[low - 1 + lag])).any():
            low = low - more
        while (more := (high + lag < last) & (h[np.minimum(high, len(h) - 1)] == h[np.minimum(high + lag, len(h) - 1)])).any():
            high = high + more
        return np.stack([low, high - low + lag, lag])

    def kept(self) -> np.ndarray:
        """Words that no run drops: a run keeps its first period."""
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, self.first_word + self.period, 1)
        np.add.at(change, self.first_word + self.length, -1)
        return np.cumsum(change)[:-1] == 0

    def collapsed(self) -> list[bytes]:
        """The kept words of each text, with one space between them."""
        kept = np.flatnonzero(self.kept())
        size = self.words.end[kept] - self.words.start[kept] + 1
        upto = np.cumsum(size)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.words.start[kept] - upto + size, size)
        out = self.words.data[np.minimum(at, len(self.words.data) - 1)]
        out[upto - 1] = 32
        edge = np.concatenate(([0], upto))[np.searchsorted(kept, self.words.first)]
        whole = out.tobytes()
        return [whole[i : max(i, j - 1)] for i, j in zip(edge[:-1], edge[1:], strict=True)]

    def best(self, text: int) -> tuple[int, int, int, int] | None:
        """start, length, period and floor(1000 * exponent) of the run with the greatest exponent."""
        found: tuple[int, int, int] | None = None
        for k in range(self.edge[text], self.edge[text + 1]):
            one = (int(self.start[k]), int(self.length[k]), int(self.period[k]))
            if found is None or one[1] * found[2] > found[1] * one[2]:  # they come by start and period
                found = one
        return found and (*found, 1000 * found[1] // found[2])


def runs_of(texts: Texts) -> Runs:
    return Runs(Words(texts, INK))


def _mapped(df: DataFrame, text: str, schema: str, rows: Callable[[pa.RecordBatch, Runs], pa.RecordBatch], before: Callable[[pa.RecordBatch], pa.Array] | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, text):
                yield rows(part, runs_of(Texts(before(part)) if before else texts))

    return df.mapInArrow(run, schema)


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start, length, period: every run of every text."""

    def rows(part: pa.RecordBatch, found: Runs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(found.text)), *(pa.array(x.astype(np.int64)) for x in (found.start, found.length, found.period))], names=["doc_id", "start", "length", "period"])

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "doc_id long, start long, length long, period long", rows)


def collapsed(docs: DataFrame, text: str = "text", n_runs: str | None = None) -> DataFrame:
    """The documents, their texts' words with one space between them and without what runs repeat; null stays null. n_runs: a name for the number of runs, another if `docs` has a column of it."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))

    def rows(part: pa.RecordBatch, found: Runs) -> pa.RecordBatch:
        columns = list(part.columns)
        columns[at] = pa.array([t.decode() if k else None for t, k in zip(found.collapsed(), part.column(at).is_valid().to_pylist(), strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(found.edge).astype(np.int64))], names=[*names, "n"])

    out = _mapped(docs.toDF(*names), names[at], f"{schema}, n long", rows)
    return out.toDF(*docs.columns, spare(docs, n_runs)) if n_runs else out.drop("n").toDF(*docs.columns)


def planted(text: bytes, h: int) -> bytes:
    """The words of a text, those from some place on replaced by a period from there, three times or more where it is long enough; place and period follow from h."""
    words = text.split()
    n, g = len(words), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent, and digests of all runs and of the collapsed text. In a tenth of the documents, told by a checksum of the id, runs are planted first."""

    def before(part: pa.RecordBatch) -> pa.Array:
        h = part["h"].to_pylist()
        if not any(x is not None and x % 10 == 0 for x in h):
            return part["text"]
        return pa.array([planted(t.as_buffer().to_pybytes(), x) if t.is_valid and x is not None and x % 10 == 0 else t.as_py().encode() if t.is_valid else None for t, x in zip(part["text"], h, strict=True)], pa.binary())

    def rows(part: pa.RecordBatch, found: Runs) -> pa.RecordBatch:
        best = [found.best(k) for k in range(part.num_rows)]
        lines = [f"{s},{n},{p}\n".encode() for s, n, p in zip(found.start, found.length, found.period, strict=True)]
        listed = [hashlib.sha256(b"".join(lines[i:j])).hexdigest() for i, j in zip(found.edge[:-1], found.edge[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                part["doc_id"], pa.array(np.diff(found.edge).astype(np.int64)), *(pa.array([b and b[k] for b in best], pa.int64()) for k in range(4)),
                pa.array(listed), pa.array([hashlib.sha256(t).hexdigest() for t in found.collapsed()]),
            ],
            names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    return _mapped(source, "text", "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", rows, before)
