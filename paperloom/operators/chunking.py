"""Greedy packing of a text's units into chunks of bounded size, with the neighbours of each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_numbers(tokens: list[int], sections: list[int], most: int, least: int) -> list[int]:
    """The chunk of each unit: a new one starts where the limit would be passed, or where the section changes once `least` is reached."""
    out, chunk, held = [], 0, 0
    for k, (n, section) in enumerate(zip(tokens, sections, strict=True)):
        if k and (held + n > most or held >= least and section != sections[k - 1]):
            chunk, held = chunk + 1, 0
        out.append(chunk)
        held += n
    return out


def chunks(tokens: Column, sections: Column, most: int = 1800, least: int = 1000) -> Column:
    """array<int>, the chunk of each unit of one document; each document is packed on its own."""
    if not 0 <= least <= most or most < 1:
        raise ValueError(f"no chunk sizes: {least} to {most}")

    @F.pandas_udf("array<int>")
    def number(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([np.array(chunk_numbers(list(a), list(b), most, least), np.int32) for a, b in zip(t, s, strict=True)])

    return number(tokens, sections)


def unit_numbers(tokens: list[int], sections: list[int], paragraphs: list[int], most: int) -> list[int]:
    """The unit of each sentence: a paragraph of a section, or where that has more than `most` tokens, as many of its sentences as fit."""
    out, begin, unit = [], 0, -1
    for k in range(1, len(tokens) + 1):
        if k < len(tokens) and (sections[k], paragraphs[k]) == (sections[begin], paragraphs[begin]):
            continue
        whole, held = sum(tokens[begin:k]) <= most, 0
        for j in range(begin, k):
            if j == begin or not whole and held + tokens[j] > most:
                unit, held = unit + 1, 0
            out.append(unit)
            held += tokens[j]
        begin = k
    return out


def planned_numbers(tokens: list[int], sections: list[int], paragraphs: list[int], most: int, least: int) -> list[int]:
    """The chunk of each sentence; units stay whole."""
    units = unit_numbers(tokens, sections, paragraphs, most)
    if not units:
        return []
    sizes, of = [0] * (units[-1] + 1), [0] * (units[-1] + 1)
    for n, section, u in zip(tokens, sections, units, strict=True):
        sizes[u], of[u] = sizes[u] + n, section
    chunk = chunk_numbers(sizes, of, most, least)
    return [chunk[u] for u in units]


def planned(tokens: Column, sections: Column, paragraphs: Column, most: int = 1800, least: int = 1000) -> Column:
    """array<int>, the chunk of each sentence of one document: whole paragraphs, or parts of oversized ones, of one document each."""
    if not 0 <= least <= most or most < 1:
        raise ValueError(f"no chunk sizes: {least} to {most}")

    @F.pandas_udf("array<int>")
    def number(t: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([np.array(planned_numbers(list(a), list(b), list(c), most, least), np.int32) for a, b, c in zip(t, s, p, strict=True)])

    return number(tokens, sections, paragraphs)


def part_numbers(chars: list[int], most: int) -> list[int]:
    """The part of each sentence: a new one starts where the estimated tokens of all its characters would pass `most`."""
    out, part, held = [], 0, 0
    for n in chars:
        if held and -(-(held + n) // 4) > most:
            part, held = part + 1, 0
        out.append(part)
        held += n
    return out


def parts(chars: Column, most: int = 6000) -> Column:
    """array<int>, the part of each sentence of one document."""

    @F.pandas_udf("array<int>")
    def number(c: pd.Series) -> pd.Series:
        return pd.Series([np.array(part_numbers(list(x), max(1, most)), np.int32) for x in c])

    return number(chars)
