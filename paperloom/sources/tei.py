"""Sentences of structured XML documents."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences that are given on at once, or those of one document, if it has more.
ROWS = 1000
_FIELDS = ["section", "section_number", "section_title", "paragraph", "order", "text", "coords"]
_SCHEMA = "section int, section_number string, section_title string, paragraph int, `order` int, text string, coords string"


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _text(e: ET.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def rows_of(xml: str | None) -> list[tuple]:
    """A row for each sentence of the body, in order; none of what isn't well formed."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    out: list[tuple] = []
    body = next((e for e in root.iter() if _name(e) == "body"), None)
    for section, div in enumerate(e for e in (body if body is not None else ()) if _name(e) == "div"):
        head = next((e for e in div if _name(e) == "head"), None)
        title, number = ("", None) if head is None else (_text(head), (head.get("n") or "").rstrip(".") or None)
        for paragraph, p in enumerate(e for e in div.iter() if _name(e) == "p"):
            for s in (e for e in p.iter() if _name(e) == "s"):
                out.append((section, number, title, paragraph, len(out), _text(s), s.get("coords")))
    return out


def sentences(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """key, section, section_number, section_title, paragraph, order, text, coords of every sentence of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

        def flat(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([batch["doc_key"].take(pa.array(at, pa.int64())), *columns], names=["doc_key", *_FIELDS])

        for batch in batches:
            at, rows = [], []
            for k in range(batch.num_rows):
                own = rows_of(batch["xml"][k].as_py())
                at.extend([k] * len(own))
                rows.extend(own)
                if len(rows) >= ROWS:
                    yield flat(batch, at, rows)
                    at, rows = [], []
            yield flat(batch, at, rows)

    rows = docs.select(F.col(key).alias("doc_key"), F.col(xml).alias("xml")).mapInArrow(run, f"doc_key {kind}, {_SCHEMA}")
    return rows.withColumnRenamed("doc_key", key)
