"""Structured XML documents: every kind of record, and documents that aren't well formed."""

import hashlib

import pyarrow as pa
import pytest

from paperloom.functions import text as T
from paperloom.sources import tei as plain_tei
from paperloom.sources import tei_documents as tei

XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Short</title><title type="main">The  Title</title></titleStmt>
<publicationStmt><date when="2021-03-04"/></publicationStmt><sourceDesc><biblStruct><analytic><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author>
<author><persName/></author></analytic><monogr><imprint><date when="1999"/></imprint></monogr><idno type="arXiv">1</idno><idno type="DOI">10.1/x</idno></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><div><p><s coords="1,1,2,3,4;2,1,2,3,4">First one.</s><s>second</s></p></div></abstract></profileDesc></teiHeader>
<text><body><div><head n="1.">One</head><p><s coords="3,1,1,1,1">See <ref type="bibr" target="#b0">[1]</ref> and <ref type="bibr" target="#b9">[9]</ref><hi>x</hi>.</s><q/></p>
<formula coords="3,1,1,1,1">E = <hi>m</hi></formula><div><p><s coords="0,1,1,1,1">Deep.<ref type="foot">1</ref></s></p></div><table/></div>
<div><head n="1.1">Sub</head></div><figure xml:id="fig_0" coords="4,1,1,1,1"><head>Fig 1</head><figDesc><div><p><s coords="4,2,2,2,2">Caption.</s></p></div></figDesc></figure>
<note place="foot" n="7">Foot</note><note>Side</note><list/></body>
<back><div type="acknowledgement"><div><head>Thanks</head><p><s>To all.</s></p></div></div><div type="references"><listBibl><biblStruct xml:id="b0" coords="9,1,1,1,1"><analytic><title>Paper</title></analytic>
<monogr><title>Book</title><author><persName><surname>Roe</surname></persName></author><imprint><date when="20"/></imprint></monogr><ptr target="http://a.b"/></biblStruct></listBibl></div></back></text></TEI>"""


def hashed(prefix, *parts):
    return prefix + hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16]


@pytest.fixture(scope="module")
def found(spark):
    rows = [("k", XML), ("cut", XML[: XML.index("<table/>")] + "<broken"), ("null", None), ("blank", " "), ("html", "<html><body/></html>"), ("junk", "no markup"), ("control", XML.replace("Deep.", "De\x0bep\x02.")), ("bare", "<TEI><text/></TEI>")]
    return tei.records(spark.createDataFrame(rows, "doc string, xml string"), "doc", "xml").cache()


def test_sections(found):
    got = sorted((r.position, r.title, r.section_id, r.parent_id) for r in tei.sections(found, "doc", "r").where("doc = 'k'").collect())
    ids = [hashed("sec_", "k", "r", "section", n) for n in range(5)]
    assert got == [(0, "Abstract", ids[0], None), (1, "One", ids[1], None), (2, "", ids[2], ids[1]), (3, "Sub", ids[3], ids[1]), (4, "Thanks", ids[4], None)]


def test_sentences(found):
    got = sorted(tei.sentences(found, "doc", "r").where("doc = 'k'").collect(), key=lambda r: r.position)
    assert [r.text for r in got] == ["First one.", "second", "See [1] and [9]x.", "Deep.1", "To all."]
    assert [r.sentence_id for r in got] == [hashed("s_", "k", "r", n) for n in range(5)]
    assert [(r.page, r.pages) for r in got] == [(0, [0, 1]), (0, [0]), (2, [2]), (2, [2]), (2, [2])]
    assert [(r.markers, r.targets) for r in got][2:4] == [(["[1]", "[9]"], ["b0", "b9"]), ([], [])]
    assert [r.warnings for r in got] == [
        [], ["coords_missing", "boundary_no_terminal_punctuation", "boundary_lowercase_start"], ["unexpected_child:hi"], ["coords_page_invalid:0", "boundary_no_terminal_punctuation", "inline_footnote_marker"], ["coords_missing"],
    ]
    assert len({r.paragraph_id for r in got}) == 4


def test_blocks_and_references(found):
    got = sorted(tei.blocks(found, "doc", "r").where("doc = 'k'").collect(), key=lambda r: r.position)
    assert [(r.type, r.text, r.label, r.pages, r.problems) for r in got] == [
        ("formula", "E = m", None, [2], []), ("figure", "Fig 1 Caption.", "fig_0", [3], []), ("caption", "Caption.", "fig_0", [3], []), ("footnote", "Foot", "7", [], ["coords_missing"]),
        ("other", "Side", None, [], ["coords_missing"]), ("bibliography", "Paper BookRoe", "b0", [8], []),
    ]
    r = tei.references(found, "doc", "r").where("doc = 'k'").first()
    assert (r.reference_id, r.title, r.authors, r.year, r.doi, r.url, r.cited_by) == (hashed("b_", "k", "r", "bib", 0), "Paper", ["Roe"], None, None, "http://a.b", [hashed("s_", "k", "r", 2)])
    m = found.where("record = 'metadata' and doc = 'k'").first()
    assert (m.text, m.authors, m.year, m.doi) == ("The Title", ["Ann Lee"], 2021, "10.1/x")


def test_warnings(found):
    got = {}
    for r in tei.warnings(found, "doc", "r").collect():
        got.setdefault(r.doc, []).append((r.code, r.detail))
    one, inner = hashed("sec_", "k", "r", "section", 1), hashed("sec_", "k", "r", "section", 2)
    assert sorted(got["k"]) == sorted([("unexpected_in_p", f"q:{one}"), ("section_without_head", inner), ("unexpected_in_div", f"table:{one}"), ("unexpected_in_body", "list"), ("citation_target_missing", "b9")])
    assert {c for c, _ in got["cut"]} >= {"malformed_xml", "citation_target_missing"} and tei.sentences(found, "doc", "r").where("doc = 'cut'").count() == 4
    assert {k: {c for c, _ in got[k]} for k in ("null", "blank", "html", "bare")} == {"null": {"empty_document"}, "blank": {"empty_document"}, "html": {"no_tei_root"}, "bare": {"abstract_missing", "body_missing"}}
    assert {c for c, _ in got["junk"]} == {"malformed_xml", "unreadable"}
    assert ("forbidden_characters", "2") in got["control"] and tei.sentences(found, "doc", "r").where("doc = 'control' and text = 'Deep.1'").count() == 1
    assert found.where("record = 'metadata'").count() == 8


def test_coordinate_warnings(spark):
    rows = [(None, ["coords_missing"]), (" ; ", ["coords_missing"]), ("1,2,3,4,5", []), ("1,2,3,4;0,1,1,1,1;1.5,1,1,1,1;a,1,1,1,1", ["coords_malformed:1,2,3,4", "coords_page_invalid:0", "coords_page_invalid:1.5", "coords_malformed:a,1,1,1,1"])]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, "c string, want array<string>").select(T.coordinate_warnings("c").alias("got"), "want").collect())


def test_records_are_given_on_in_slices():
    """A batch of many documents isn't held as one list of records, and only the kinds that are asked for are given."""
    held = []

    class Frame:
        schema = {"k": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            held.append(run)
            return self

        def withColumnRenamed(self, *_):
            return self

    xml = "<TEI><text><body><div><head>H</head>" + "<p><s>a</s></p>" * 300 + "</div></body></text></TEI>"
    batch = pa.RecordBatch.from_pydict({"doc_key": list(range(20)), "xml": [xml] * 20})
    plain_tei.sentences(Frame(), "k", "xml")
    tei.records(Frame(), "k", "xml", ("sentence",))
    for run in held:
        sizes = [b.num_rows for b in run(iter([batch]))]
        assert sum(sizes) == 6000 and max(sizes) <= 1300
