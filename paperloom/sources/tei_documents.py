"""Structured XML documents taken apart in one parse: metadata, sections, sentences, excluded blocks, references and warnings.

What isn't well formed is read as far as it goes, and said to be; characters that XML forbids are dropped, and that is said too. Nothing is left out in
silence: a document without anything to read has a row of metadata and a warning. Identifiers follow from the document's key, a revision and
the place in the order of reading, so a second parse gives the same.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_REFS = pa.list_(pa.struct([("type", pa.string()), ("target", pa.string()), ("text", pa.string())]))
_FIELDS = [
    ("record", pa.string()), ("position", pa.int32()), ("section", pa.int32()), ("paragraph", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("coords", pa.string()), ("detail", pa.string()),
    ("refs", _REFS), ("others", pa.list_(pa.string())), ("authors", pa.list_(pa.string())), ("year", pa.int32()), ("doi", pa.string()), ("url", pa.string()), ("xml_id", pa.string()),
]
_SCHEMA = (
    "record string, position int, section int, paragraph int, type string, text string, coords string, detail string, refs array<struct<type: string, target: string, text: string>>, "
    "others array<string>, authors array<string>, year int, doi string, url string, xml_id string"
)
_FORBIDDEN = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
#: Records that are given on at once, or those of one document, if it has more.
ROWS = 1000
_ID = "{http://www.w3.org/XML/1998/namespace}id"


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _text(e: ET.Element | None) -> str:
    return "" if e is None else " ".join("".join(e.itertext()).split())


def _all(e: ET.Element | None, *names: str) -> list[ET.Element]:
    """Children of these names."""
    return [] if e is None else [c for c in e if _name(c) in names]


def _one(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next(iter(_all(e, name)), None)
    return e


def _below(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if e is None else [c for c in e.iter() if c is not e and _name(c) == name]


def read_tree(xml: str | None) -> tuple[ET.Element | None, list[tuple[str, str]]]:
    """The document's root, as far as it can be read, and what is wrong with it: (code, detail)."""
    if xml is None or not xml.strip():
        return None, [("empty_document", "")]
    clean = _FORBIDDEN.sub("", xml)
    problems = [("forbidden_characters", str(len(xml) - len(clean)))] if len(clean) < len(xml) else []
    parser, root, broken = ET.XMLPullParser(["start"]), None, None
    try:
        parser.feed(clean)
        parser.close()
    except ET.ParseError as error:
        broken = error
    try:
        for _, e in parser.read_events():
            root = e if root is None else root
    except ET.ParseError as error:  # what was found while it was fed stands among the events
        broken = error
    if broken:
        problems.append(("malformed_xml", "{}:{}".format(*broken.position)))
    if root is not None and _name(root) != "TEI":
        return None, [*problems, ("no_tei_root", _name(root))]
    return root, problems if root is not None else [*problems, ("unreadable", "")]


class Document:
    """The records of one document, in the order of reading."""

    def __init__(self, xml: str | None):
        self.rows: list[dict] = []
        self.counts = dict.fromkeys(("section", "paragraph", "sentence", "block", "reference"), 0)
        root, problems = read_tree(xml)
        for code, detail in problems:
            self.warn(code, detail)
        self.metadata(_one(root, "teiHeader"))
        if root is None:
            return
        self.abstract(_one(root, "teiHeader", "profileDesc", "abstract"))
        self.body(_one(root, "text", "body"))
        self.back(_one(root, "text", "back"))

    def put(self, record: str, **fields) -> int:
        at = self.counts.get(record, 0)
        self.counts[record] = at + 1
        self.rows.append({"record": record, "position": at} | fields)
        return at

    def warn(self, code: str, detail: str = "", section: int | None = None) -> None:
        self.put("warning", type=code, detail=detail, section=section)

    def metadata(self, header: ET.Element | None) -> None:
        source = _one(header, "fileDesc", "sourceDesc", "biblStruct")
        article, volume = _one(source, "analytic"), _one(source, "monogr")
        dates = [*_all(_one(header, "fileDesc", "publicationStmt"), "date")[:1], *_below(volume, "date")[:1]]
        year = next((y for d in dates if (y := _year(d)) or d.get("when")), None)
        title = _title(_one(header, "fileDesc", "titleStmt")) or _title(article)
        self.put("metadata", text=title, authors=_people(volume if article is None else article), year=year, doi=_identifier(source, "DOI"))

    def abstract(self, e: ET.Element | None) -> None:
        if e is None:
            return self.warn("abstract_missing")
        section = self.put("section", text="Abstract")
        before = self.counts["sentence"]
        for p in _below(e, "p"):
            self.paragraph(p, section)
        if self.counts["sentence"] == before:
            self.warn("abstract_empty")

    def body(self, e: ET.Element | None) -> None:
        if e is None:
            return self.warn("body_missing")
        numbered: dict[str, int] = {}
        for child in e:
            head = _one(child, "head")
            number = None if head is None or head.get("n") is None else re.sub(r"\.$", "", head.get("n"))
            if _name(child) == "div":
                section = self.division(child, numbered.get(number.rpartition(".")[0]) if number else None)
                if number:
                    numbered[number] = section
            elif not self.block(child):
                self.warn("unexpected_in_body", _name(child))

    def division(self, e: ET.Element, parent: int | None) -> int:
        head = _one(e, "head")
        section = self.put("section", section=parent, text=_text(head))
        if head is None:
            self.warn("section_without_head", section=section)
        for child in e:
            if _name(child) == "p":
                self.paragraph(child, section)
                for other in child:
                    if _name(other) != "s":
                        self.warn("unexpected_in_p", _name(other), section)
            elif _name(child) == "div":
                self.division(child, section)
            elif _name(child) != "head" and not self.block(child):
                self.warn("unexpected_in_div", _name(child), section)
        return section

    def paragraph(self, p: ET.Element, section: int) -> None:
        paragraph = self.counts["paragraph"]
        self.counts["paragraph"] += 1
        for s in _all(p, "s"):
            refs = [{"type": r.get("type"), "target": r.get("target"), "text": _text(r)} for r in _below(s, "ref")]
            self.put("sentence", section=section, paragraph=paragraph, text="".join(s.itertext()), coords=s.get("coords"), refs=refs, others=[_name(c) for c in s if _name(c) != "ref"])

    def block(self, e: ET.Element) -> bool:
        """A formula, note, figure or table, which isn't part of the text; whether it is one."""
        of_sentences = lambda x: ";".join(c for s in _below(x, "s") if (c := s.get("coords")))
        match _name(e):
            case "formula":
                self.put("block", type="formula", text=_text(e), coords=e.get("coords"))
            case "note":
                self.put("block", type="footnote" if e.get("place") == "foot" else "other", text=_text(e), coords=of_sentences(e), detail=e.get("n"))
            case "figure":
                caption = _one(e, "figDesc")
                parts = [t for t in (_text(_one(e, "head")), _text(caption)) if t]
                self.put("block", type="table" if e.get("type") == "table" else "figure", text=" ".join(parts) or None, coords=e.get("coords"), detail=e.get(_ID))
                if caption is not None and of_sentences(caption):
                    self.put("block", type="caption", text=_text(caption), coords=of_sentences(caption), detail=e.get(_ID))
            case _:
                return False
        return True

    def back(self, e: ET.Element | None) -> None:
        for div in _all(e, "div"):
            inner = _all(div, "div")
            if div.get("type") == "references":
                for entry in _below(div, "biblStruct"):
                    self.reference(entry)
            elif inner and _one(div, "head") is None:
                for d in inner:
                    self.division(d, None)
            else:
                self.division(div, None)

    def reference(self, e: ET.Element) -> None:
        article, volume = _one(e, "analytic"), _one(e, "monogr")
        date, link = next(iter(_below(volume, "date")), None), next(iter(_below(e, "ptr")), None)
        self.put("block", type="bibliography", text=_text(e), coords=e.get("coords"), detail=e.get(_ID))
        self.put(
            "reference", text=_text(e), type=_title(article) or _title(volume), authors=_people(article) or _people(volume), year=None if date is None else _year(date),
            doi=_identifier(e, "DOI"), url=None if link is None else link.get("target"), xml_id=e.get(_ID),
        )


def _year(date: ET.Element) -> int | None:
    found = re.match(r"\d{4}", date.get("when") or "")
    return int(found[0]) if found else None


def _people(e: ET.Element | None) -> list[str]:
    names = [" ".join(t for part in _all(_one(a, "persName"), "forename", "surname") if (t := _text(part))) for a in _all(e, "author")]
    return [n for n in names if n]


def _title(e: ET.Element | None) -> str | None:
    titles = _all(e, "title")
    main = next((t for t in titles if t.get("type") == "main"), titles[0] if titles else None)
    return _text(main) or None


def _identifier(e: ET.Element | None, kind: str) -> str | None:
    return next((_text(i) for i in _below(e, "idno") if i.get("type") == kind), "") or None


def records(docs: DataFrame, key: str, xml: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """key and a row for each record of each document; every output below is made of these. kinds: those that are wanted, all if none are named."""
    schema = pa.schema(_FIELDS)

    def flat(batch: pa.RecordBatch, found: list[tuple[int, dict]]) -> pa.RecordBatch:
        keys = batch["doc_key"].take(pa.array([at for at, _ in found], pa.int64()))
        columns = [pa.array([r.get(c) for _, r in found], t) for c, t in _FIELDS]
        return pa.RecordBatch.from_arrays([keys, *columns], names=["doc_key", *schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, dict]] = []
            for at in range(batch.num_rows):
                found.extend((at, r) for r in Document(batch["xml"][at].as_py()).rows if not kinds or r["record"] in kinds)
                if len(found) >= ROWS:
                    yield flat(batch, found)
                    found = []
            yield flat(batch, found)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_key"), F.col(xml).alias("xml")).mapInArrow(run, f"doc_key {kind}, {_SCHEMA}").withColumnRenamed("doc_key", key)


def identifier(prefix: str, *parts: Column) -> Column:
    """16 digits of a digest of the parts with colons between them."""
    digest = F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 16)
    return F.when(parts[-1].isNotNull(), F.concat(F.lit(prefix), digest))


def _ids(key: str, revision: str) -> dict[str, Column]:
    own = lambda prefix, column, *kind: identifier(prefix, F.col(key), F.lit(revision), *map(F.lit, kind), F.col(column))
    return {
        "section": own("sec_", "position", "section"), "above": own("sec_", "section", "section"), "paragraph": own("p_", "paragraph", "paragraph"), "sentence": own("s_", "position"),
        "block": own("x_", "position", "excluded"), "reference": own("b_", "position", "bib"),
    }


def sections(found: DataFrame, key: str, revision: str) -> DataFrame:
    """key, section_id, parent_id, position, title."""
    ids = _ids(key, revision)
    return found.where("record = 'section'").select(key, ids["section"].alias("section_id"), ids["above"].alias("parent_id"), "position", F.col("text").alias("title"))


def sentences(found: DataFrame, key: str, revision: str) -> DataFrame:
    """key, sentence_id, section_id, paragraph_id, position, text, kind, page, pages, markers, targets and warnings. A sentence without a place is on the page of the one before."""
    ids, rects = _ids(key, revision), T.coordinates(F.coalesce("coords", F.lit("")))
    rows = found.where("record = 'sentence'").withColumn("own", T.pages_of(rects))
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    page = F.coalesce(F.last(F.try_element_at("own", F.lit(1)), ignorenulls=True).over(w), F.lit(0))
    of_type = lambda kind: F.filter("refs", lambda r: r["type"] == kind)
    warnings = F.concat(
        T.coordinate_warnings("coords"), T.sentence_warnings("text"), F.transform(of_type("foot"), lambda r: F.lit("inline_footnote_marker")), F.transform("others", lambda t: F.concat(F.lit("unexpected_child:"), t))
    )
    targets = F.transform(F.filter(of_type("bibr"), lambda r: r["target"].startswith("#")), lambda r: F.substring(r["target"], F.lit(2), F.length(r["target"])))
    return rows.withColumn("page", page).select(
        key, ids["sentence"].alias("sentence_id"), ids["above"].alias("section_id"), ids["paragraph"].alias("paragraph_id"), "position", "text", T.is_sentence("text").alias("kind"), "page",
        F.when(F.size("own") > 0, F.col("own")).otherwise(F.array("page")).alias("pages"), F.transform(of_type("bibr"), lambda r: r["text"]).alias("markers"), targets.alias("targets"), warnings.alias("warnings"),
    )


def blocks(found: DataFrame, key: str, revision: str) -> DataFrame:
    """key, block_id, position, type, text, label, pages, problems: what isn't part of the text."""
    rects = T.coordinates(F.coalesce("coords", F.lit("")))
    rows = found.where("record = 'block'")
    return rows.select(key, _ids(key, revision)["block"].alias("block_id"), "position", "type", "text", F.col("detail").alias("label"), T.pages_of(rects).alias("pages"), T.coordinate_warnings("coords").alias("problems"))


def references(found: DataFrame, key: str, revision: str) -> DataFrame:
    """key, reference_id, position, text, title, authors, year, doi, url, xml_id, and cited_by, the sentences that point to it, in order."""
    rows = found.where("record = 'reference'").select(key, _ids(key, revision)["reference"].alias("reference_id"), "position", "text", F.col("type").alias("title"), "authors", "year", "doi", "url", "xml_id")
    cited = sentences(found, key, revision).select(key, "position", "sentence_id", F.explode(F.array_distinct("targets")).alias("xml_id"))
    listed = cited.groupBy(key, "xml_id").agg(F.array_sort(F.collect_list(F.struct("position", "sentence_id"))).alias("by"))
    return rows.join(listed, [key, "xml_id"], "left").withColumn("cited_by", F.coalesce(F.col("by.sentence_id"), F.array().cast("array<string>"))).drop("by")


def warnings(found: DataFrame, key: str, revision: str) -> DataFrame:
    """key, code, detail: what is wrong with each document, and citations that point nowhere."""
    ids = _ids(key, revision)
    own = found.where("record = 'warning'").select(key, F.col("type").alias("code"), F.concat_ws(":", F.nullif("detail", F.lit("")), ids["above"]).alias("detail"))
    cited = sentences(found, key, revision).select(key, F.explode("targets").alias("xml_id")).distinct()
    known = found.where("record = 'reference'").select(key, "xml_id")
    return own.unionByName(cited.join(known, [key, "xml_id"], "left_anti").select(key, F.lit("citation_target_missing").alias("code"), F.col("xml_id").alias("detail")))
