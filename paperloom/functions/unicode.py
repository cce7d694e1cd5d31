"""Functions that need Unicode normalisation, or a decoder with state; Arrow batches of Python."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import paper_number, without_site


def _fold(text: str | None) -> str | None:
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if unicodedata.category(c)[0] in "LN")


def title_key(title: Column) -> Column:
    """A title as letters and numbers only, in lower case and compatibility form."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(_fold, na_action="ignore")

    return run(title)


class _Kept(dict):
    """Each character if it holds a letter or a number when decomposed, else None, as a table for str.translate; one that is new is looked up once."""

    def __missing__(self, code: int) -> int | None:
        self[code] = code if any(unicodedata.category(d)[0] in "LN" for d in unicodedata.normalize("NFKD", chr(code))) else None
        return self[code]


_KEPT = _Kept()


def kept_characters(text: str) -> int:
    return len(text.translate(_KEPT))


def key_characters(text: Column) -> Column:
    """How many characters hold a letter or a number when decomposed."""

    @F.pandas_udf("int")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else kept_characters(t) for t in rows], dtype="Int32")

    return run(text)


def is_self_source(url: Column, title: Column, own_number: Column, own_doi: Column, own_title: Column, least: int = 16) -> Column:
    """Whether a source is the paper itself: by its number or DOI in the URL, or by a title that is long enough."""
    address = F.lower(F.coalesce(F.try_url_decode(url), url))
    by_number = (paper_number(address) != "") & (paper_number(address) == own_number)
    wanted = title_key(own_title)
    by_title = (F.length(wanted) >= least) & ((title_key(title) == wanted) | (title_key(without_site(title)) == wanted))
    return F.coalesce(by_number, F.lit(False)) | F.coalesce(F.contains(address, own_doi), F.lit(False)) | F.coalesce(by_title, F.lit(False))


_HEAD = re.compile(r'\s*(?:```(?:json)?\s*)?\{\s*"(\w+)"\s*:\s*"')
_BODY = re.compile(r'(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*')


def partial_string(raw: str | None, name: str) -> str:
    """As much of the string in the first field of an unfinished JSON object as can be read; a half surrogate at its end waits."""
    head = _HEAD.match(raw or "")
    if not head or head[1] != name:
        return ""
    text = json.loads(f'"{_BODY.match(raw, head.end())[0]}"')
    return text[:-1] if text and "\ud800" <= text[-1] <= "\udbff" else text


def streamed_field(raw: Column, name: str) -> Column:
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([partial_string(r, name).encode("utf-16", "surrogatepass").decode("utf-16", "replace") for r in rows], dtype=object)

    return run(raw)
