"""Where sentences stand in the text items of their document, found by letters and digits alone.

Texts are reduced to keys, letters and digits decomposed and in lower case. A document's items make one string of keys, in which each sentence's key is sought
as a whole: the only place of a long key is an anchor; of a short or repeated one, the only place between the anchors before and behind it in reading order; a
key without a place is put together of the longest beginnings that are found, each within reach of the one before. What is left has to be placed by hand.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of an anchor and of a segment at least, how far a segment may be from the one before, and how many there are at most.
ANCHOR, SEGMENT, REACH, SEGMENTS = 20, 12, 8000, 5
UNIQUE, SHORT, REPEATED, SEGMENTED, MANUAL = "unique", "unique_short", "repeated_by_order", "segmented", "manual"

_SPAN = pa.struct([("page", pa.int64()), ("index", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_FIELDS = [("position", pa.int64()), ("how", pa.string()), ("occurrences", pa.int64()), ("key_length", pa.int64()), ("spans", pa.list_(_SPAN)), ("gaps", pa.list_(pa.int64())), ("tags", pa.list_(pa.string()))]
_SCHEMA = "position long, how string, occurrences long, key_length long, spans array<struct<page: long, index: long, start: long, end: long>>, gaps array<long>, tags array<string>"


class _Keys(dict):
    """The key characters of each character, as a table for str.translate; one that is new is looked up once."""

    def __missing__(self, code: int) -> str:
        own = lambda c: unicodedata.category(c)[0] in "LN"
        self[code] = "".join(k for d in unicodedata.normalize("NFKD", chr(code)) if own(d) for k in d.lower() if own(k))
        return self[code]


_KEYS = _Keys()


def key_of(text: str) -> str:
    """The key characters of a text."""
    return text.translate(_KEYS)


def keyed(text: str) -> tuple[str, list[int]]:
    """The key characters of a text, and for each the place of the character it comes from."""
    parts = [_KEYS[ord(c)] for c in text]
    return "".join(parts), [at for at, k in enumerate(parts) for _ in k]


def places(hay: str, key: str, low: int = 0, high: int | None = None) -> Iterator[int]:
    at = hay.find(key, low, high) if key else -1
    while at >= 0:
        yield at
        at = hay.find(key, at + 1, high)


def _beginning(hay: str, key: str, low: int, high: int) -> int:
    """How much of the key, from its beginning, stands somewhere in the stretch."""
    short, long = 0, len(key)
    while short < long:
        middle = (short + long + 1) // 2
        short, long = (middle, long) if hay.find(key[:middle], low, high) >= 0 else (short, middle - 1)
    return short


def _segments(hay: str, key: str, after: int | None) -> list[tuple[int, int]] | None:
    """The stretches that make up the key; None where they can't be told. after: where the anchor before ends."""
    found: list[tuple[int, int]] = []
    while key:
        low, high = (found[-1][1], min(len(hay), found[-1][1] + REACH)) if found else (0, len(hay))
        n = _beginning(hay, key, low, high)
        if n < min(SEGMENT, len(key)) or n == 0 or len(found) == SEGMENTS:
            return None
        first = hay.find(key[:n], low, high)
        if not found:
            starts = list(places(hay, key[:n]))
            near = [p for p in starts if after is not None and after <= p < after + REACH] or starts
            if len(near) > 1:
                return None
            first = near[0]
        found.append((first, first + n))
        key = key[n:]
    return found


class Stream:
    """The keys of a document's items in order, and which item and place each comes from. items: page, index, text."""

    def __init__(self, items: list[tuple[int, int, str]]):
        self.items = items
        keys = [key_of(text or "") for _, _, text in items]
        self.text = "".join(keys)
        self.ends = list(accumulate(map(len, keys)))
        self.at: dict[int, list[int]] = {}

    def places_of(self, i: int) -> list[int]:
        """Where in item i each of its keys comes from."""
        if i not in self.at:
            self.at[i] = keyed(self.items[i][2] or "")[1]
        return self.at[i]

    def spans(self, segments: list[tuple[int, int]]) -> list[dict]:
        """Stretches of keys as spans of items, from the first key's character to the last one's; segments don't share one."""
        out: list[dict] = []
        for low, high in segments:
            i = bisect_right(self.ends, low)
            while low < high:
                first, end = self.ends[i - 1] if i else 0, min(high, self.ends[i])
                if low < end:
                    at = self.places_of(i)
                    out.append({"page": self.items[i][0], "index": self.items[i][1], "start": at[low - first], "end": at[end - 1 - first] + 1})
                low, i = max(low, end), i + 1
        return out


def found_in(stream: Stream, sentences: list[tuple[int, str]]) -> list[dict]:
    """A row for each sentence (position, text), in order."""
    hay = stream.text
    keys = [key_of(text or "") for _, text in sentences]
    at = [list(places(hay, k)) for k in keys]
    anchors = [i for i, (k, p) in enumerate(zip(keys, at, strict=True)) if len(p) == 1 and len(k) >= ANCHOR]
    rows = []
    for i, (position, _) in enumerate(sentences):
        key, own = keys[i], at[i]
        before, behind = bisect_left(anchors, i), bisect_right(anchors, i)
        low = at[anchors[before - 1]][0] + len(keys[anchors[before - 1]]) if before else None
        high = at[anchors[behind]][0] if behind < len(anchors) else None
        how, segments = MANUAL, None
        if len(own) == 1 and len(key) >= ANCHOR:
            how, segments = UNIQUE, [(own[0], own[0] + len(key))]
        elif own:
            inside = [p for p in own if low is not None and high is not None and low <= p and p + len(key) <= high]
            if len(inside) == 1:
                how, segments = SHORT if len(own) == 1 else REPEATED, [(inside[0], inside[0] + len(key))]
        elif key:
            segments = _segments(hay, key, low)
            how = SEGMENTED if segments else MANUAL
        spans = stream.spans(segments or [])
        gaps = [b[0] - a[1] for a, b in zip(segments or [], (segments or [])[1:])]
        signs = {"page_boundary": len({s["page"] for s in spans}) > 1, "repeated": len(own) > 1, "gapped": bool(gaps), "short": len(key) < ANCHOR}
        rows.append({"position": position, "how": how, "occurrences": len(own), "key_length": len(key), "spans": spans, "gaps": gaps, "tags": [t for t, yes in signs.items() if yes]})
    return rows


def located(sentences: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """key, position, how, occurrences, key_length, spans, gaps and tags of every sentence.

    sentences: key, position, text; items: key, page, index, text. Sentences and items of a document meet in one task; a document bounds both. Offsets count code points.
    """
    kind = sentences.schema[key].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = sorted(zip(left["position"].to_pylist(), left["text"].to_pylist(), strict=True), key=lambda r: r[0])
        them = sorted(zip(*(right[c].to_pylist() for c in ("page", "index", "text")), strict=True), key=lambda r: r[:2])
        found = pa.Table.from_pylist(found_in(Stream(them), own), schema=pa.schema(_FIELDS))
        return found.add_column(0, "doc_key", left["doc_key"])

    both = sentences.select(F.col(key).alias("doc_key"), "position", "text").groupBy("doc_key").cogroup(items.select(F.col(key).alias("doc_key"), "page", "index", "text").groupBy("doc_key"))
    return both.applyInArrow(run, f"doc_key {kind}, {_SCHEMA}").withColumnRenamed("doc_key", key)
