"""The languages of a text, as a mixture.

A language is a distribution over hashed byte trigrams of lower-cased letters, from counts over all
training documents. A text is taken as draws from a mixture of the languages; expectation
maximisation estimates their shares. The set of languages is then selected by penalised likelihood:
one language, or the two, three ... with the largest shares, estimated again for these alone,
whichever has the least -2 log likelihood + PENALTY * languages * log(trigrams).

The model has a fixed size for each language and is broadcast; texts are only mapped, in numpy over
whole Arrow batches.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text
where no language was learned; null languages aren't learned; repeated rows are each predicted;
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, Texts, sliced

BITS = 16
SMOOTH = 0.2
ROUNDS = 10
#: Trigrams of a text overlap, so they count as evidence for fewer.
PENALTY = 6.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hashed trigram at every place where one stands; anything but letters counts as one space."""
    sizes = np.diff(texts.offsets)
    of = np.repeat(np.arange(texts.rows), sizes)
    padded = np.full(len(texts.data) + texts.rows + 1, 32, np.uint8)
    padded[np.arange(len(of)) + of + 1] = _FOLD[texts.data]
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    pads = np.zeros(len(padded), bool)
    pads[texts.offsets + np.arange(texts.rows + 1)] = True
    good = (b != 32) | ((a != 32) & (c != 32) & ~pads[1:-1])
    good &= ~((a == 32) & (b == 32)) & ~((b == 32) & (c == 32))
    place = np.flatnonzero(good)
    key = (a[place].astype(np.uint32) << 16) | (b[place].astype(np.uint32) << 8) | c[place]
    text = np.searchsorted(texts.offsets + np.arange(texts.rows + 1), place + 1, side="right") - 1
    inner = np.minimum(text, texts.rows - 1)
    return inner, (key * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, bucket, n over all documents with a language; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, n in found.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

        for batch in batches:
            for part, texts in sliced(batch, "text"):
                codes = part["lang"].dictionary_encode()
                names = codes.dictionary.to_pylist()
                of, bucket = trigrams(texts)
                code = codes.indices.to_numpy(zero_copy_only=False)[of].astype(np.int64)
                both = np.bincount(code << BITS | bucket, minlength=len(names) << BITS).reshape(-1, 1 << BITS)
                for name, n in zip(names, both, strict=True):
                    found[name] = found.get(name, 0) + n
                if len(found) > 100:
                    yield from rows()
                    found.clear()
        yield from rows()

    source = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return source.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Trigram distributions of some languages."""

    def __init__(self, names: list[str], n: np.ndarray):
        self.names = names
        p = (n + SMOOTH) / (n.sum(1, keepdims=True) + SMOOTH * n.shape[1])
        self.p = np.ascontiguousarray(p.T, np.float32)
        self.log = np.log(self.p)

    def infer(self, texts: Texts) -> tuple[list[list[int]], list[list[float]], np.ndarray]:
        """Of each text the selected languages, largest share first, their shares, and the largest share of all languages together."""
        k, rows = len(self.names), texts.rows
        of, bucket = trigrams(texts)
        key = np.sort((of.astype(np.uint32) << BITS | bucket) if rows < 1 << (32 - BITS) else (of.astype(np.uint64) << np.uint64(BITS) | bucket))
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(key))).astype(np.float32)
        of, bucket = (key[new] >> BITS).astype(np.int64), (key[new] & ((1 << BITS) - 1)).astype(np.int64)
        total = np.bincount(of, n, rows)
        edges = np.searchsorted(of, np.arange(rows + 1))
        some = np.flatnonzero(edges[1:] > edges[:-1])
        picked, shares, top = [[] for _ in range(rows)], [[] for _ in range(rows)], np.zeros(rows)
        if not len(some):
            return picked, shares, top

        def per_text(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, edges[some], axis=0)

        single = per_text(self.log[bucket] * n[:, None])
        best = single.argmax(1)
        pi, fit = self.mix(bucket, n, np.searchsorted(some, of), edges[some], np.ones((len(some), k), np.float32))
        order = np.argsort(-pi, axis=1)
        penalty = PENALTY * np.log(np.maximum(total[some], 2))
        cost = -2 * single.max(1) + penalty
        chosen = np.ones(len(some), int)
        final = np.zeros_like(pi)
        final[np.arange(len(some)), best] = 1
        for size in range(2, k + 1):
            again = np.flatnonzero(-2 * fit + size * penalty < cost)  # no smaller set fits better than all languages
            if not len(again):
                break
            allowed = np.zeros((len(again), k), np.float32)
            np.put_along_axis(allowed, order[again, :size], 1, axis=1)
            spans = [np.arange(edges[some[t]], edges[some[t] + 1]) for t in again]
            own = np.concatenate(spans)
            local = np.repeat(np.arange(len(again)), [len(s) for s in spans])
            begin = np.cumsum([0] + [len(s) for s in spans[:-1]])
            part, ll = self.mix(bucket[own], n[own], local, begin, allowed)
            price = -2 * ll + size * penalty[again]
            better = price < cost[again]
            cost[again[better]], chosen[again[better]], final[again[better]] = price[better], size, part[better]
        for t, row in enumerate(some.tolist()):
            langs = np.argsort(-final[t], kind="stable")[: chosen[t]]
            picked[row], shares[row], top[row] = langs.tolist(), final[t][langs].tolist(), float(pi[t][langs[0]])
        return picked, shares, top

    def mix(self, bucket: np.ndarray, n: np.ndarray, local: np.ndarray, begin: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the allowed languages by expectation maximisation, and the log likelihood."""
        p = self.p[bucket]
        pi = allowed / allowed.sum(1, keepdims=True)
        size = np.add.reduceat(n, begin)[:, None]
        for _ in range(ROUNDS):
            q = p * pi[local]
            q *= (n / np.maximum(q.sum(1), 1e-30))[:, None]
            pi = np.add.reduceat(q, begin, axis=0) / size
        ll = np.add.reduceat(n * np.log(np.maximum(np.einsum("ij,ij->i", p, pi[local]), 1e-30)), begin)
        return pi, ll


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Mixture | None:
    """The table collected has 2**BITS rows for each language at most."""
    rows = counts(docs, lang, text).toArrow()
    names = sorted(rows["lang"].unique().to_pylist())
    if not names:
        return None
    n = np.zeros((len(names), 1 << BITS))
    code = {x: i for i, x in enumerate(names)}
    n[[code[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Mixture(names, n)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


def _lettered(part: pa.Array, texts: Texts) -> np.ndarray:
    flags = np.diff(np.concatenate(([0], np.cumsum(_ASCII_LETTER[LOWER[texts.data]])))[texts.offsets]) > 0
    for k in np.flatnonzero(~flags & (np.diff(texts.offsets) > 0)).tolist():
        flags[k] = any(map(str.isalpha, part[k].as_py()))
    return flags


def predicted(docs: DataFrame, model: Mixture | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every document, lang_pred, score, and langs and shares, the selected mixture."""
    names = [f"c{i}" for i in range(len(keep))]
    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                known = _lettered(part["text"], texts) if m else np.zeros(texts.rows, bool)
                picked, shares, top = m.infer(texts) if m else ([[]] * texts.rows, [[]] * texts.rows, np.zeros(texts.rows))
                known &= np.array([len(x) > 0 for x in picked], bool)
                langs = [[m.names[i] for i in x] if k else [] for x, k in zip(picked, known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array([x[0] if x else "und" for x in langs], pa.string()),
                        pa.array(np.where(known, np.clip(top, 0, 1), 0.0)),
                        pa.array(langs, pa.list_(pa.string())),
                        pa.array([x if k else [] for x, k in zip(shares, known, strict=True)], pa.list_(pa.float64())),
                    ],
                    names=[*names, "lang_pred", "score", "langs", "shares"],
                )

    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).alias("text"))
    return source.mapInArrow(run, f"{fields}lang_pred string, score double, langs array<string>, shares array<double>").toDF(*keep, "lang_pred", "score", "langs", "shares")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs, shares; a third of the documents, by id, is held out of training."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return predicted(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "langs", "shares")
