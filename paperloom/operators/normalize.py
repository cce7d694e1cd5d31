"""Normalised texts with a map back: which stretch of the raw text each stretch of the normalised one comes from. Offsets count code points."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import LIGATURES

SEGMENTS = "array<struct<raw_start: int, raw_end: int, norm_start: int, norm_end: int, kind: string>>"

KINDS = ["copy", "ligature", "hyphen", "drop", "space"]

# Zero-width characters with the soft hyphen, and white space as scripts of the web define it.
_DROP = "­​‌‍﻿"
_SPACE = "\t\n\x0b\x0c\r    -     　"
_GAP = f"[{_SPACE}{_DROP}]"
# what a change begins with is told at once; the kinds are only asked behind it
_CHANGE = re.compile(
    f"(?=[{''.join(LIGATURES)}{_SPACE}{_DROP}‐-])(?:(?P<ligature>[{''.join(LIGATURES)}])|(?P<hyphen>[-‐­](?={_GAP}*[\n\r  ]){_GAP}+)|(?P<drop>[{_DROP}])|(?P<space>(?: (?={_GAP})|[{_SPACE.replace(' ', '', 1)}]){_GAP}*))"
)


def _joins(raw: str, m: re.Match) -> bool:
    """A hyphen joins what stands around the line end if a letter is before it and a small letter behind."""
    before = raw[: m.start()].rstrip(_DROP)[-1:] if m.start() and raw[m.start() - 1] in _DROP else raw[m.start() - 1 : m.start()]
    behind = raw[m.end() : m.end() + 1]
    return before.isalpha() and behind.islower()


def segments(raw: str) -> tuple[str, list[tuple[int, int, int, int, str]]]:
    out: list[str] = []
    found: list[tuple[int, int, int, int, str]] = []
    length = at = pos = 0

    def put(end: int, text: str, kind: str) -> None:
        nonlocal length, at
        if end > at:
            found.append((at, end, length, length + len(text), kind))
            out.append(text)
            length, at = length + len(text), end

    while m := _CHANGE.search(raw, pos):
        kind, pos = m.lastgroup, m.end()
        if kind == "hyphen" and not _joins(raw, m):
            pos = m.start() + 1
            if m[0][0] != "\u00ad":
                continue  # stays as it is
            kind = "drop"
        put(m.start(), raw[at : m.start()], "copy")
        put(pos, {"ligature": LIGATURES.get(m[0], ""), "space": " "}.get(kind, ""), kind)
    put(len(raw), raw[at:], "copy")
    return "".join(out), found


def mapped(raw: pa.Array) -> pa.Array:
    """text and segments of each text; the numbers of a batch are held side by side, as Arrow does."""
    texts, ends, kinds, numbers = [], array("i", [0]), array("b"), [array("i") for _ in range(4)]
    for value in raw:
        text, found = (None, []) if (own := value.as_py()) is None else segments(own)
        texts.append(text)
        for *places, kind in found:
            for column, place in zip(numbers, places, strict=True):
                column.append(place)
            kinds.append(KINDS.index(kind))
        ends.append(len(kinds))
    names = ["raw_start", "raw_end", "norm_start", "norm_end", "kind"]
    ints = [pa.array(np.frombuffer(column, np.int32)) if column else pa.array([], pa.int32()) for column in numbers]
    which = pa.array(np.frombuffer(kinds, np.int8)) if kinds else pa.array([], pa.int8())
    parts = pa.StructArray.from_arrays([*ints, pa.array(KINDS).take(which)], names)
    listed = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), parts, mask=pa.array([t is None for t in texts], pa.bool_()))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), listed], ["text", "segments"])


def normalized_with_map(text: Column) -> Column:
    """struct<text, segments>."""

    @F.arrow_udf(f"struct<text: string, segments: {SEGMENTS}>")
    def run(raw: pa.Array) -> pa.Array:
        return mapped(raw)

    return run(text)


def _projected(maps: Column, start: Column, end: Column, src: tuple[str, str], dst: tuple[str, str]) -> Column:
    def inside(s: Column) -> Column:
        a, b = s[src[0]], s[src[1]]
        return F.when(a == b, (start < a) & (a < end)).when(start == end, (a <= start) & (start < b)).otherwise((a < end) & (b > start))

    hits = F.filter(maps, inside)
    low = F.transform(hits, lambda s: F.when(s["kind"] == "copy", s[dst[0]] + F.greatest(start, s[src[0]]) - s[src[0]]).otherwise(s[dst[0]]))
    high = F.transform(hits, lambda s: F.when(s["kind"] == "copy", s[dst[0]] + F.least(end, s[src[1]]) - s[src[0]]).otherwise(s[dst[1]]))
    last = F.coalesce(F.try_element_at(maps, F.lit(-1))[dst[1]], F.lit(0))
    return F.struct(F.coalesce(F.array_min(low), last).alias("start"), F.coalesce(F.array_max(high), last).alias("end"))


def raw_range(maps: Column, start: Column, end: Column) -> Column:
    """The stretch of the raw text that a stretch of the normalised text comes from."""
    return _projected(maps, start, end, ("norm_start", "norm_end"), ("raw_start", "raw_end"))


def norm_range(maps: Column, start: Column, end: Column) -> Column:
    return _projected(maps, start, end, ("raw_start", "raw_end"), ("norm_start", "norm_end"))
