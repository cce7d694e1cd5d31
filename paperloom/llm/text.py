"""Bytes of a whole Arrow batch of texts as numpy arrays: words, lines and hashes.

UTF-8 keeps every byte of a character beyond ASCII at 0x80 or above, so word classes that treat
those characters alike can be decided byte by byte, for all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; one text above it is taken alone and whole.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: ASCII letters in lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

#: Bytes of `[^\x20\x09-\x0D]+`.
INK = np.ones(256, dtype=bool)
INK[9:14] = INK[32] = False

#: A random 64-bit value for each byte.
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Texts:
    """Some consecutive texts: their bytes and where each begins. Null counts as empty."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("")
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.rows = len(column)


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in slices of about `limit` bytes of text; every row is in one slice."""
    at = batch.schema.get_field_index(column)
    if not batch.num_rows:
        return
    sizes = Texts(batch.column(at)).offsets
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + limit, side="right")) - 1)
        part = batch.slice(begin, end - begin)
        yield part, Texts(part.column(at))
        begin = end


class Words:
    """Words of some texts: `start` and `end` in `data`, and `first`, the number of words before each text."""

    def __init__(self, texts: Texts, kind: np.ndarray, lower: bool = False):
        self.data = LOWER[texts.data] if lower else texts.data
        ink = kind[self.data]
        start, end = ink.copy(), ink.copy()
        if len(ink):
            start[1:] &= ~ink[:-1]
            end[:-1] &= ~ink[1:]
            inner = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(ink))]
            start[inner] = ink[inner]  # words don't run from one text into the next
            end[inner - 1] = ink[inner - 1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, texts.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        """The text of each word, as a row number."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up), np.cumprod(down))
    return _powers


class Hasher:
    """64-bit hashes of any stretches of some bytes, from sums over the bytes before."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of `n` consecutive values, in order, at each place where so many follow."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = mixed(out + hashes[k : k + count] * _BASE)
    return out
