"""Chunks, parts, glossaries, assembled items, versions and page geometry on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import geometry as G
from paperloom.functions import text as T
from paperloom.operators import assembly, chunking, glossary, resolve


def test_units():
    assert chunking.unit_numbers([5, 5, 50, 5], [0, 0, 0, 1], [0, 0, 1, 1], 20) == [0, 0, 1, 2]
    assert chunking.unit_numbers([9, 9, 9, 30, 3], [0] * 5, [0] * 5, 20) == [0, 0, 1, 2, 3]
    assert chunking.unit_numbers([], [], [], 20) == []
    assert chunking.planned_numbers([9, 9, 9, 30, 3, 4], [0] * 5 + [1], [0] * 5 + [1], 20, 3) == [0, 0, 1, 2, 3, 4]
    r = random.Random(1)
    for _ in range(50):
        n = r.randrange(1, 40)
        tokens, sections = [r.randrange(1, 30) for _ in range(n)], sorted(r.randrange(3) for _ in range(n))
        paragraphs = [k // r.choice((1, 2, 3)) for k in range(n)]
        units, chunks = chunking.unit_numbers(tokens, sections, paragraphs, 40), chunking.planned_numbers(tokens, sections, paragraphs, 40, 20)
        for numbers in (units, chunks):
            assert numbers[0] == 0 and all(b - a in (0, 1) for a, b in zip(numbers, numbers[1:]))
            assert all(sum(t for t, x in zip(tokens, numbers) if x == k) <= 40 for k in set(numbers))
        assert all(len({c for c, u in zip(chunks, units) if u == k}) == 1 for k in units)


def test_parts():
    assert chunking.part_numbers([0, 8, 8, 8, 100, 1], 4) == [0, 0, 0, 1, 2, 3] and chunking.part_numbers([], 4) == []


def test_occurrences(spark):
    lines = spark.createDataFrame([(0, "The RAG model, or C++ and x-y."), (1, "ragged; c+"), (2, None), (3, ""), (4, "a RAG?! (x-y) +++"), (5, "raG model")], "pos int, text string")
    terms = spark.createDataFrame([(0, " rag "), (1, "RAG Model"), (2, "C++"), (3, "x-y"), (4, "+++"), (5, " "), (6, None), (7, "(x-y)")], "id int, term string")
    got = sorted((r.pos, r.id) for r in glossary.occurrences(lines, ["pos"], "text", terms, "term").collect())
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (4, 0), (4, 3), (4, 4), (4, 7), (5, 0), (5, 1)]


def test_assembly(spark):
    rows = [(1, 0, 0, "ab", False), (1, 0, 1, "c", True), (1, 0, 2, "d", False), (1, 0, 4, "", False), (1, 1, 0, "é😀", False), (2, 0, 3, "x", True)]
    items = spark.createDataFrame(rows, "doc int, page int, index int, text string, eol boolean")
    assert {r.doc: r.raw for r in assembly.assembled(items, ["doc"]).collect()} == {1: "abc\nd \né😀", 2: "x"}
    ranges = spark.createDataFrame([(1, 1, 5), (1, 5, 5), (2, 0, 9)], "doc int, from int, to int")
    got = sorted(map(tuple, assembly.item_spans(ranges, assembly.placed(items, ["doc"]), ["doc"]).select("doc", "page", "index", "start", "end").collect()))
    assert got == [(1, 0, 0, 1, 2), (1, 0, 1, 0, 1), (1, 0, 2, 0, 1), (2, 0, 3, 0, 1)]


def test_resolved_chunks(spark):
    plan = spark.createDataFrame([(k, ["a", "b"], 5, "r1") for k in range(6)], "chunk int, targets array<string>, current int, revision string")
    saved = [(0, 5, "r1", "complete", ["a", "b"]), (0, 4, "r1", "complete", ["a", "b"]), (1, 5, "r1", "failed", ["a", "b"]), (1, 3, "r1", "complete", ["a", "b"]), (1, 2, "r1", "complete", ["a", "b"])]
    saved += [(2, 5, "r1", "complete", ["b", "a"]), (3, 4, "r2", "complete", ["a", "b"]), (4, 5, "r1", "failed", ["a", "b"]), (4, 6, "r1", "complete", ["a", "b"])]
    found = resolve.resolved_chunks(plan, spark.createDataFrame(saved, "chunk int, generation int, revision string, status string, targets array<string>"), ["chunk"])
    assert sorted((r.chunk, r.status, r.generation, r.previous) for r in found.collect()) == [(0, "complete", 5, False), (1, "failed", 3, True), (2, "pending", None, False), (3, "pending", None, False), (4, "failed", None, False), (5, "pending", None, False)]


def test_geometry(spark):
    row = spark.createDataFrame([(3.0, 4.0, 10.0, 5.0, "user")], "x double, y double, width double, height double, space string")
    box = F.struct("x", "y", "width", "height")
    m = F.array(*(F.lit(v) for v in (0.0, 2.0, -3.0, 0.0, 100.0, 50.0)))
    item, part = row.select(G.item_box(m, F.lit(8.0), F.lit(2.0)).alias("a"), G.part_of(box, F.lit(2), F.lit(6), F.lit(8)).alias("b")).first()
    assert tuple(item) == (98, 50, 2, 8) and tuple(part) == (5.5, 4, 5, 5)
    assert tuple(row.select(G.part_of(box, F.lit(0), F.lit(0), F.lit(0)).alias("b")).first().b) == (3, 4, 10, 5)
    assert tuple(row.select(G.in_space(box, "space", "user").alias("b")).first().b) == (3, 4, 10, 5)
    with pytest.raises(Exception, match="expected a box in parser"):
        row.select(G.in_space(box, "space", "parser")).collect()


def test_spaces(spark):
    """From user space to the viewport and to the parser's space, and back, at every turn; both ways are computed apart."""
    page = F.struct(*(F.col(f"p_{c}").alias(c) for c in ("x", "y", "width", "height", "rotation", "unit")))
    box = F.struct("x", "y", "width", "height")
    rows = [(13.0, 24.0, 10.0, 5.0, 3.0, 4.0, 500.0, 700.0, float(r), 2.0) for r in (0, 90, 180, 270, -90, 450)]
    df = spark.createDataFrame(rows, "x double, y double, width double, height double, p_x double, p_y double, p_width double, p_height double, p_rotation double, p_unit double")
    made = df.select("x", "y", "width", "height", page.alias("page"), G.viewport_from_user(box, page, F.col("p_rotation"), F.lit(1.5)).alias("v"), G.parser_from_user(box, page).alias("p"), G.page_size(page, F.col("p_rotation"), F.lit(1.5)).alias("s")).collect()
    assert [tuple(r.s) for r in made] == [(1500, 2100), (2100, 1500)] * 2 + [(2100, 1500)] * 2
    assert [tuple(r.v) for r in made[:2]] == [(30, 2025, 30, 15), (60, 30, 15, 30)] and tuple(made[1].p) == (20, 10, 5, 10)
    again = spark.createDataFrame([(r.page, r.v, r.p) for r in made], df.select(page.alias("page"), box.alias("v"), box.alias("p")).schema)
    back = again.select(G.user_from_viewport(F.col("v"), F.col("page"), F.col("page.rotation"), F.lit(1.5)).alias("a"), G.user_from_parser(F.col("p"), F.col("page")).alias("b")).collect()
    assert all(tuple(x) == pytest.approx((13, 24, 10, 5)) for r in back for x in (r.a, r.b))


def test_forms(spark):
    df = spark.createDataFrame([("a\t ",), ("  \n",)], "t string")
    assert [tuple(r) for r in df.select(T.is_sentence("t"), T.sentence_warnings("t"), T.trimmed("t")).collect()] == [("fragment", ["boundary_no_terminal_punctuation", "boundary_lowercase_start"], "a"), ("fragment", ["empty_text"], "")]
    halves = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "x array<int>").select(T.halves("x").alias("h")).collect()
    assert [r.h for r in halves] == [[[1, 2], [3]], [[1]], [[]]]


def test_mentions(spark):
    """Each row is judged by itself, also where keys repeat; an entry is mentioned once, by its first name in the row."""
    entries = spark.createDataFrame(
        [(1, "RAG model", ["rag", "RAG", " "], ["le modèle"]), (2, "C++", ["x-y", None], ["c"]), (3, " ", ["model"], []), (4, "none", ["void"], ["nul"])],
        "id int, term string, aliases array<string>, preferred array<string>",
    )
    rows = [(1, "The RAG model, or rag.", "lemodèle"), (1, "rag", None), (1, "ragged models", "x"), (2, "c++ x-y", "X-Y c"), (2, "C++, x-y", "(x-Y)"), (2, "x-y of C+", "c"), (3, "C++", "d"), (4, None, None)]
    texts = spark.createDataFrame(rows, "k int, text string, said string")
    got = glossary.mentions(texts, ["k"], "text", entries).select("k", "id", "main").collect()
    assert sorted(map(tuple, got)) == sorted([(1, 1, True), (1, 1, False), (1, 3, False), (2, 2, True), (2, 2, True), (2, 2, False), (3, 2, True)])
    got = glossary.statistics(texts, ["k"], "text", "said", entries).collect()
    assert sorted(map(tuple, got)) == [(1, "RAG model", 1, 1, 1, 0, 0), (2, "C++", 3, 1, 1, 1, 1), (3, " ", 0, 1, 0, 0, 0), (4, "none", 0, 0, 0, 0, 0)]
