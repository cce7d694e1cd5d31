import math

import pytest
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def each(spark, column, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", column.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.k)]


def test_quality(spark):
    texts = ["", "a " * 19, "a " * 20, "a" * 199, "a" * 200, "" * 7 + "a" * 14, "�" * 90 + "a" * 209]
    chars, valid = T.inked_chars("t"), T.valid_chars("t")
    assert each(spark, T.text_quality(chars, valid), texts) == ["needs_ocr", "needs_ocr", "sparse", "sparse", "ok", "garbled", "garbled"]


def test_sentences(spark):
    texts = ["It ends.", 'He said "so."', "no end", "See Fig.", "  ", "Émile et al. ", "Wait…"]
    assert each(spark, T.is_sentence("t"), texts) == ["sentence", "sentence", "fragment", "sentence", "fragment", "sentence", "sentence"]
    assert each(spark, T.sentence_warnings("t"), texts) == [[], [], ["boundary_no_terminal_punctuation", "boundary_lowercase_start"], ["boundary_abbreviation_end"], ["empty_text"], ["boundary_abbreviation_end"], []]


def test_numbers(spark):
    texts = ["400M and 400 and 1,200.5", "[EQ_3] [3, 4] 12 [7]", "10 k, 10 km", "1,234,567 1,23", "3.14 3.14", ""]
    assert each(spark, T.numbers_in("t"), texts) == [["400", "1200.5"], ["12"], ["10"], ["1234567", "1,23"], ["3.14"], []]


def test_numbers_behind_units(spark):
    texts = ["AKIA5M77KC5XJU", "5 M77, 4k 3", "1,000 km 7.5B.6"]
    assert each(spark, T.numbers_in("t"), texts) == [["77", "5"], ["77", "3"], ["1000", "6"]]
    assert each(spark, T.numbers_in("t", units_take=True), texts) == [["7", "5"], ["7", "3"], ["1000", "6"]]


def test_urls(spark):
    assert each(spark, T.urls_in("t"), ["See http://a.b/c. Or https://x.y/?q=1에서"]) == [["http://a.b/c", "https://x.y/?q=1"]]
    urls = ["HTTP://Ex.COM/A/#f", "https://ex.com", "https://ex.com/?q=1#x", "ftp://ex.com", "nonsense", None, "http://ex.com:80/a", "http://ex.com:81/a"]
    assert each(spark, T.normalized_url("t"), urls) == ["http://ex.com/A", "https://ex.com", "https://ex.com/?q=1", None, None, None, "http://ex.com/a", "http://ex.com:81/a"]


def test_mentions(spark):
    texts = ["The RAG model", "ragged", "x-RAG.", "ragé"]
    assert each(spark, T.mentions("t", " rag "), texts) == [True, False, True, False]
    assert each(spark, T.keeps_original("t", "RAG"), texts) == [True, False, True, True]
    assert each(spark, T.preferred_forms("t"), ["검색 (RAG)", "plain", ""]) == [["검색 (RAG)", "검색"], ["plain"], []]


def test_small_forms(spark):
    assert each(spark, T.collapse("t"), [" a \tb\n"]) == ["a b"]
    assert each(spark, T.without_tags("t"), ["<b>a</b> &LT;x&gt; &amp;amp;"]) == ["a <x> &amp;"]
    assert each(spark, T.utf16_length("t"), ["a\U0001f600"]) == [3]
    assert each(spark, T.paper_number("t"), ["arXiv:2005.11401v4", "12005.114019"]) == ["2005.11401", ""]
    assert each(spark, T.without_site("t"), ["[12] Title - Site"]) == ["Title"]
    assert each(spark, T.pages_of(T.coordinates("t")), ["2,1,2,3,4;1,1,2,3,4; 2,9,9,9,9;x;0,1,1,1,1;1.5,1,1,1,1"]) == [[0, 1]]
    assert one(spark, T.duration_label("m"), m=300) == "5 h" and one(spark, T.duration_label("m"), m=10080) == "7 d"
    assert one(spark, T.reset_time("v"), v=1_700_000_000) == one(spark, T.reset_time("v"), v=1_700_000_000_000)


@pytest.mark.parametrize("angle", [0, 90, 180, 270])
def test_viewport(spark, angle):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    m = G.viewport(*lit(10, 20, 300, 400), F.lit(angle), F.lit(2.0))
    box = one(spark, G.transformed(m, *lit(10, 20, 300, 400)))
    assert (box.x, box.y) == (0, 0) and (box.width, box.height) == ((600, 800) if angle % 180 == 0 else (800, 600))
    x, y = G.applied(m, *lit(33, 44))
    back = one(spark, F.array(*G.applied(G.inverse(m), x, y)))
    assert back == pytest.approx([33, 44])


def test_boxes(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x", "y", "width", "height"))))
    assert not one(spark, G.overlaps(box(0, 0, 1, 1), box(1, 0, 1, 1))) and one(spark, G.overlaps(box(0, 0, 2, 1), box(1, 0, 1, 1)))
    assert one(spark, G.contains(box(0, 0, 1, 1), F.lit(1.0), F.lit(0.0)))
    assert one(spark, G.degenerate(F.lit(0.0), F.lit(math.nan), F.lit(1.0), F.lit(1.0))) and one(spark, G.degenerate(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))))
    assert [one(spark, G.rotation(F.lit(x))) for x in (0, 44, 46, -90, 450)] == [0, 0, 90, 270, 90]


def test_normalized(spark):
    from tests.test_operators import CASES

    assert each(spark, T.normalized("t"), list(CASES)) == list(CASES.values())


def test_more_forms(spark):
    assert each(spark, T.decoded_all("t"), ["&#x41;&#66;&amp;#65; &#x1F600; &unknown; é"]) == ["AB&#65; \U0001f600 &unknown; é"]
    assert each(spark, T.parts_around_placeholders("t"), ["a [EQ_1] b\n[EQ_2][EQ_3]", ""]) == [["a ", "[EQ_1]", " b\n", "[EQ_2]", "[EQ_3]"], []]
    urls = ["ftp://a.b", "http://u:p@a.b", "http://x.localhost/", "http://10.0.0.1/", "https://www.youtube.com/c/x", "https://www.youtube.com/watch?v=1", "https://a.b/search?q=1", "https://a.b/"]
    assert each(spark, T.rejected_url("t"), urls) == ["not_http", "credentials", "private_host", "private_host", "not_a_video", None, "search_page", None]
    assert [tuple(x) for x in each(spark, T.span_list("t"), ["t_3_5:0-52 bad t_3_6:1-4"])[0]] == [("t_3_5", 0, 52), ("t_3_6", 1, 4)]
    values = F.create_map(F.lit("a"), F.lit("1"))
    assert each(spark, T.rendered("t", values), ["{{a}}{{ b }}{{a}}"]) == ["1{{ b }}1"]
    assert each(spark, T.template_variables("t"), ["{{a}}{{ b }}{{a}}"]) == [["a", "b"]]
    assert each(spark, T.explained("t", F.lit(None).cast("string")), [" ", "x", None]) == [False, True, False]


def test_tei():
    from paperloom.sources import tei

    xml = '<TEI xmlns="x"><text><body><div><head n="1.2.">A <b>B</b></head><p><s coords="1,2,3,4,5">One  <i>two</i>.</s><s>Three.</s></p><p><s/></p></div><div><p><s>Four</s></p></div></body></text></TEI>'
    assert tei.rows_of(xml) == [(0, "1.2", "A B", 0, 0, "One two.", "1,2,3,4,5"), (0, "1.2", "A B", 0, 1, "Three.", None), (0, "1.2", "A B", 1, 2, "", None), (1, None, "", 0, 3, "Four", None)]
    assert tei.rows_of(None) == tei.rows_of("<a>") == tei.rows_of("<a/>") == []


def test_key_count(spark):
    """As many as key_offsets() has, for spans that overlap, repeat, are empty or run backwards; a long span costs no more than a short one."""
    import random

    r = random.Random(3)
    texts = [" ".join(f"t_{r.randrange(3)}_1:{r.randrange(30)}-{r.randrange(30)}" for _ in range(r.randrange(9))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(T.key_offsets(T.span_list("t"))).alias("a"), T.key_count(T.span_list("t")).alias("b")).collect()
    assert len(rows) == 200 and all(x.a == x.b for x in rows)
    (long,) = spark.createDataFrame([("t_1_1:0-2000000000 t_1_1:5-9 t_2_1:0-2000000000",)], "t string").select(T.key_count(T.span_list("t")).alias("n")).collect()
    assert long.n == 4_000_000_000
