import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import alignment, checks, chunking, events, normalize, resolve, spatial
from paperloom.plans import relations
from paperloom.sources import documents, html
from paperloom.streaming import events as streams

CASES = {
    "plain text": "plain text", "ﬁne ﬄ": "fine ffl", "a \t b": "a b", "docu-\nment": "document", "COVID-\n19": "COVID- 19", "x­y": "xy", "a​b﻿": "ab", "": "", "docu­\n  ment": "document",
    "\t​\n": " ", "a-​\nb": "ab", "5-\nb": "5- b", "x²₃": "x²₃", "a - b": "a - b", "end-": "end-", "a-\n": "a- ", "a­": "a",
}


@pytest.mark.parametrize("raw", list(CASES))
def test_normalized(raw):
    text, found = normalize.segments(raw)
    assert text == CASES[raw]
    assert normalize.segments(text)[0] == text
    assert [s[0] for s in found[1:]] == [s[1] for s in found[:-1]] and (not found or (found[0][0], found[-1][1]) == (0, len(raw)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab-A1 \n\t­​ﬁ ", max_size=14))
def test_normalized_twice(raw):
    text, found = normalize.segments(raw)
    assert normalize.segments(text)[0] == text
    for a, b, c, d, kind in found:
        assert kind != "copy" or raw[a:b] == text[c:d]


def test_projection(spark):
    rows = spark.createDataFrame([("docu-\nment ﬁne­ly",)], "t string").select(normalize.normalized_with_map(F.col("t")).alias("n"))
    span = lambda f, a, b: tuple(rows.select(f(F.col("n.segments"), F.lit(a), F.lit(b)).alias("x")).first().x)
    assert rows.first().n.text == "document finely"
    assert span(normalize.raw_range, 0, 8) == (0, 10) and span(normalize.raw_range, 4, 8) == (6, 10)
    assert span(normalize.raw_range, 9, 10) == (11, 12) and span(normalize.raw_range, 15, 15) == (17, 17) and span(normalize.norm_range, 0, 5) == (0, 4)


def plain_fit(q, t):
    best = None
    for s in range(len(t) + 1):
        row = list(range(len(q) + 1))
        cells = [(row[-1], -s, s)]
        for e in range(s + 1, len(t) + 1):
            new = [row[0] + 1]
            for k in range(1, len(q) + 1):
                new.append(min(row[k - 1] + (q[k - 1] != t[e - 1]), row[k] + 1, new[-1] + 1))
            row = new
            cells.append((row[-1], -s, e))
        best = min([*cells, *([best] if best else [])], key=lambda c: (c[0], c[2], c[1]))
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("ab", min_size=1, max_size=6), st.text("abc", max_size=9))
def test_fit(q, t):
    distance, start, end = alignment.fit(q, t)
    least = min(plain_fit(q, t[:e])[0] for e in range(len(t) + 1))
    assert distance == least
    assert 0 <= start <= end <= len(t)
    row = plain_fit(q, t[start:end])
    assert row[0] == distance


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=4), st.text("abc", max_size=40))
def test_fit_long(q, t):
    assert alignment.fit_long(q, t, piece=3) == alignment.fit(q, t)


def test_long_documents(spark, tmp_path):
    """A passage with a changed word is found in a document of more than 20 million cells."""
    passage = " ".join(f"passage{k}" for k in range(40))
    text = "filler " * 10_000 + passage.replace("passage20", "other") + " filler" * 100
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(passage) * len(text) > 20_000_000
    r = relations.passage_alignment(spark, str(tmp_path)).first()
    assert (r.status, r.start, text[r.start : r.end]) == ("mapped", 70_000, text[70_000 : 70_000 + len(passage) - 4])


def test_alignment(spark):
    long = "the quick brown fox jumps over the lazy dog"
    rows = [(0, "brown fox", long), (1, "the", long), (2, "brwn fax jumps", long), (3, "zzzzzzzzzz", long), (4, "quick brown fxo jumps over", long), (5, "big" * 10, "y" * 10)]
    df = spark.createDataFrame(rows, "k int, q string, t string")
    got = {r.k: r for r in alignment.aligned(df, "q", "t", most_cells=299).collect()}
    assert [got[k].status for k in (0, 1, 3, 5)] == ["mapped", "uncertain", "too_large", "too_large"]
    got = {r.k: r for r in alignment.aligned(df, "q", "t").collect()}
    assert [got[k].status for k in range(5)] == ["mapped", "uncertain", "uncertain", "unmapped", "mapped"]
    assert (got[0].start, got[0].end) == (10, 19)


def test_chunks():
    assert chunking.chunk_numbers([5, 5, 5], [0, 0, 0], 10, 5) == [0, 0, 1]
    assert chunking.chunk_numbers([5, 5, 5], [0, 1, 1], 100, 5) == [0, 1, 1]
    assert chunking.chunk_numbers([50], [0], 10, 5) == [0] and chunking.chunk_numbers([], [], 10, 5) == []
    with pytest.raises(ValueError):
        chunking.chunks(F.lit(1), F.lit(1), 5, 6)


def test_box_join(spark):
    rng = random.Random(1)
    box = lambda: (rng.randrange(3), (float(rng.randrange(60)), float(rng.randrange(60)), float(rng.randrange(0, 30)), float(rng.randrange(0, 40))))
    kind = "page int, box struct<x: double, y: double, width: double, height: double>"
    left, right = [(k, *box()) for k in range(60)], [(k, *box()) for k in range(60)]
    got = spatial.box_join(spark.createDataFrame(left, f"a int, {kind}"), spark.createDataFrame(right, f"b int, {kind}"))
    over = lambda p, q, m: p[0] - m < q[0] + q[2] and q[0] < p[0] + p[2] + m and p[1] - m < q[1] + q[3] and q[1] < p[1] + p[3] + m
    want = [(a, b) for a, pa, x in left for b, pb, y in right if pa == pb and min(*x[2:], *y[2:]) > 0 and over(x, y, 2)]
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


def test_checks(spark):
    rows = [
        (1, "a [EQ_1] [EQ_1] b 12 [3]", "a [EQ_1] [EQ_2] http://x.y/.", ["[3]"], ["a neighbour text that is long enough"]),
        (2, "fine 1,200", "fein 1200", [], ["short"]), (3, "text", " ", [], []), (4, "x", "A  neighbour text that is LONG enough!", [], ["a neighbour text that is long enough"]),
    ]
    df = spark.createDataFrame(rows, "k int, s string, r string, m array<string>, n array<string>")
    issues = checks.all_issues(
        checks.not_empty(df, ["k"], "s", "r"), checks.placeholders_kept(df, ["k"], "s", "r"), checks.citations_kept(df, ["k"], "m", "r"), checks.urls_known(df, ["k"], "s", "r"),
        checks.numbers_kept(df, ["k"], "s", "r"), checks.neighbours_kept_out(df, ["k"], "s", "r", "n"),
    )
    assert Counter((r.k, r.code) for r in issues.collect()) == Counter({(1, "placeholder_lost"): 1, (1, "placeholder_added"): 1, (1, "citation_lost"): 1, (1, "invented_url"): 1, (1, "number_missing"): 1, (3, "empty_translation"): 1, (4, "neighbor_content"): 1})
    assert {r.k: r.ok for r in checks.verdicts(df, ["k"], issues).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_resolve(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, True), ("c", 9, True)], "k string, g int, done boolean")
    got = resolve.newest_complete(df, ["k"], "g", F.col("done"), F.lit(3)).collect()
    assert sorted((r.k, r.g, r.previous) for r in got) == [("a", 1, True), ("b", 3, False)]
    t = spark.createDataFrame([(1,), (2,)], "k int")
    r = spark.createDataFrame([(2,), (2,), (3,)], "k int")
    assert sorted(tuple(x) for x in resolve.differences(t, r, "k").collect()) == [(1, "missing"), (2, "duplicate"), (3, "unexpected")]
    v = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int").withColumn("k", F.lit("a"))
    assert resolve.upper_median(v, ["k"], "v").first().median == 3


def test_documents(spark):
    whole = '{"a": "x]", "results": [{"id": 1, "t": "}\\""}, {"id": 2}], "z": 1}'
    cuts = {whole: 2, whole[:-20]: 1, whole[:20]: 0, "": 0, "[]": 0, '{"results": 3}': 0, ' {"results" : [ {"a": [1, {}]} , {"b"': 1, '{"results": [{}, x': 1}
    df = spark.createDataFrame([(c,) for c in cuts], "raw string")
    assert {r.raw: len(r.x) for r in df.select("raw", documents.salvaged(F.col("raw"), "results").alias("x")).collect()} == cuts
    states = spark.createDataFrame([('{"k": 1}',), ('{"k": "x"}',), ("{",), (None,)], "raw string").select(documents.read_state(F.col("raw"), "k int").alias("x"))
    assert [r.x for r in states.collect()] == ["ok", "schema_mismatch", "invalid_json", "not_found"]
    both = spark.createDataFrame([('{"b": {"d": 1, "c": "é"}, "a": [1]}',)], "raw string").select(documents.canonical(F.col("raw")).alias("x")).first().x
    assert both == '{\n  "a": [\n    1\n  ],\n  "b": {\n    "c": "é",\n    "d": 1\n  }\n}'


def test_search_results(spark):
    page = (
        '<div class="result results_links web"><a rel="x" class="result__a" href="//find.example/l/?uddg=https%3A%2F%2Fa.b%2Fc&amp;rut=1">T <b>1</b></a><a class="result__snippet" href="#">S &amp; 1</a></div>'
        '<div class="result results_links result--ad"><a class="result__a" href="https://ad.example">Ad</a></div><div class="result results_links"><a class="result__a" href="https://d.e/">T2</a></div><div class="result results_links"><a class="result__a" href="javascript:x">no</a></div>'
    )
    df = spark.createDataFrame([(1, page), (2, "<p>No results found</p>"), (3, '<form id="challenge-form">')], "k int, html string")
    got = html.search_results(df, "k", "html", "find.example").orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, "https://a.b/c", "T 1", "S & 1"), (1, 2, "https://d.e/", "T2", "")]
    kinds = df.select(html.answer_kind(F.col("html"), "result__a", nothing="No results found").alias("x")).collect()
    assert [r.x for r in kinds] == ["results", "no_results", "blocked"]


def test_late_events(spark, tmp_path):
    schema = "user_id int, state string, at int"
    for k, rows in enumerate([[(1, "a", 5), (2, "x", 1)], [(1, "late", 3), (2, "y", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.drained(spark, streams.latest(stream, ["user_id"], ["at"]), ["user_id"], "update").collect()
    assert sorted((r.user_id, r.state) for r in got) == [(1, "a"), (2, "y")]


def test_granted(spark):
    df = spark.createDataFrame([(s, k) for s in "ab" for k in range(5)] + [("c", 0)], "s string, k int")
    assert Counter(r.s for r in events.granted(df, ["s"], ["k"], 3).collect()) == {"a": 3, "b": 3, "c": 1}


def test_formulas(spark):
    from paperloom.operators import formulas

    texts = {"where α + β = γ holds for x": "where [EQ_1] holds for x", "a <b> only": "a <b> only", "p_1 and q_2": "p_1 and q_2", "x^2 + y^2 , z and α∈Ω": "[EQ_1] , z and α∈Ω", "": "", "α β then γ δ": "[EQ_1] then [EQ_2]"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", formulas.replaced(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == texts


def test_numbered(spark):
    rows = [(k % 3 if k % 10 else None, k * 7 - 300) for k in range(400)]
    got = resolve.numbered(spark.createDataFrame(rows, "g int, n long").repartition(5), "g", "n", "at", width=50).collect()
    want = [(g, n, at) for g in (0, 1, 2, None) for at, n in enumerate(sorted(n for h, n in rows if h == g), 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_signs_as_terms(spark):
    """Terms without a word are found by their first character; one that is in no sentence, or only white space, is in none."""
    from paperloom.operators import glossary

    sentences = spark.createDataFrame([(1, "a -> b, c"), (2, "a - b"), (3, "→ x →"), (4, "")], "k int, text string")
    terms = spark.createDataFrame([(1, "->"), (2, "→"), (3, " "), (4, "A"), (5, "§")], "id int, term string")
    got = glossary.occurrences(sentences, ["k"], "text", terms, "term").select("k", "id").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 4), (2, 4), (3, 2)]


def test_box_counts(spark):
    """As counted from the pairs, of boxes of any size, degenerate ones, copies, and many that are the same."""
    rng = random.Random(5)
    box = lambda wide: (rng.choice([rng.uniform(-40, 90), float(rng.randrange(60))]), rng.uniform(-40, 90), rng.choice([0.0, 5.0, rng.uniform(0, wide)]), rng.choice([10.0, rng.uniform(0, wide)]))
    kind = "page int, box struct<x: double, y: double, width: double, height: double>"
    left = [(k, rng.randrange(3), box(60)) for k in range(150)] + [(200, 1, None), (201, None, box(9))]
    right = [(k, rng.randrange(3), box(20)) for k in range(300)]
    right += [(k + 1000, p, b) for k, p, b in right[:80]]
    a, b = spark.createDataFrame(left, f"k int, {kind}"), spark.createDataFrame(right, f"item long, {kind}")
    pairs = spatial.box_join(a, b).groupBy("k").agg(F.count("*").alias("candidates"), F.min("item").alias("first"))
    got, want = (sorted(map(tuple, x.collect())) for x in (spatial.box_counts(a, "k", b, "item"), pairs))
    assert got == want and len(got) > 50
    many = lambda key: spark.range(30_000).select(F.col("id").alias(key), F.lit(1).alias("page"), F.struct(*(F.lit(v).alias(c) for c, v in (("x", 1.0), ("y", 2.0), ("width", 9.0), ("height", 9.0)))).alias("box"))
    counted = spatial.box_counts(many("k"), "k", many("item"), "item")
    assert counted.groupBy("candidates", "first").count().collect() == [(30_000, 0, 30_000)]


def test_smallest_box_against_pairs(spark):
    """Against all pairs of points and boxes; and copies of one box and one point, of which the pairs would be 400 million."""
    rng = random.Random(4)
    points = [(k, k % 3, float(rng.randrange(60)), float(rng.randrange(60))) for k in range(300)]
    boxes = [(rng.randrange(3), rng.randrange(60), rng.randrange(60), rng.choice([3, 8, 20]), rng.choice([3, 8, 20]), k, k % 9 == 0) for k in range(160)]
    held = lambda p, b: p[1] == b[0] and b[1] <= p[2] <= b[1] + b[3] and b[2] <= p[3] <= b[2] + b[4]
    expected = {p[0]: min((b[3] * b[4], b[5]) for b in boxes if held(p, b) and not b[6])[1] for p in points if any(held(p, b) for b in boxes) and not any(held(p, b) for b in boxes if b[6])}
    df = spark.createDataFrame([(b[0], tuple(map(float, b[1:5])), *b[5:]) for b in boxes], "page int, box struct<x: double, y: double, width: double, height: double>, item long, no boolean")
    where = spark.createDataFrame(points, "k long, page int, x double, y double")
    got = spatial.smallest_box(where, "k", df.where("not no").drop("no"), df.where("no").select("page", "box"), "item").collect()
    assert {r.k: r.item for r in got} == expected and expected

    many = spark.range(20_000).selectExpr("id AS k", "1 AS page", "5d AS x", "5d AS y")
    copies = spark.range(20_000).selectExpr("1 AS page", "named_struct('x', 0d, 'y', 0d, 'width', 9d, 'height', 9d) AS box", "id + 7 AS item")
    before = time.monotonic()
    found = spatial.smallest_box(many, "k", copies, copies.where("false").select("page", "box"), "item").agg(F.count("*"), F.min("item"), F.max("item")).first()
    assert tuple(found) == (20_000, 7, 7)
    assert time.monotonic() - before < 15


def test_segments_are_held_as_arrow():
    """Places of a batch are numbers side by side, and are those of each text by itself."""
    texts = ["a  b", None, "", "ﬁn de-\nux ​ x", "x" * 5]
    found = normalize.mapped(pa.array(texts, pa.string())).to_pylist()
    plain = [(None, None) if t is None else normalize.segments(t) for t in texts]
    assert [(r["text"], r["segments"] and [tuple(s.values()) for s in r["segments"]]) for r in found] == [(t, s and list(s)) for t, s in plain]
    assert normalize.mapped(pa.array(["a  b"] * 10_000)).nbytes < 1_000_000
