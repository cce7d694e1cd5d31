import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import crossentropy as ce

ROWS = [
    (1, "The cat sat.\nThe cat", True), (2, "the dog é 北", False), (3, None, True), (4, "", None), (5, "ab", True), (5, "ab", True), (6, "cat the sat", None),
    (7, "x " * 300, False), (8, "!", True), (None, "The cat sat é 北\x00", None), (9, "the dog é 北", True), (10, " ".join(f"w{i * i % 977}" for i in range(20_000)), False),
]


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())


def plain_losses(rows, classes):
    """Of each row (text, in target) the losses in both models, counted from all other rows, word by word."""
    out = []
    for i, (t, x) in enumerate(rows):
        w = plain_words(t)
        each = []
        for others in ([u for j, (u, _) in enumerate(rows) if j != i], [u for j, (u, y) in enumerate(rows) if j != i and y]):
            words = [plain_words(u) for u in others]
            ones, twos, before = Counter(), Counter(), Counter()
            for v in words:
                ones.update(v)
                twos.update(zip([None, *v], v))
                before.update([None, *v][: len(v)])
            total = 0.0
            for a, b in zip([None, *w], w):
                p = (ones[b] + 1) / (ones.total() + classes)
                total -= math.log((twos[a, b] + ce.PRIOR * p) / (before[a] + ce.PRIOR))
            each.append(total / len(w) if w else None)
        out.append((len(w), *each, each[1] - each[0] if w else None))
    return out


def same(got, want):
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None), (a, b)
        assert a[2] is None or a[2:] == pytest.approx(b[2:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("frequent", [10**6, 3, 0])
def test_small(spark, frequent):
    """Whichever way pairs go, the losses are those of models without the text."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, background boolean").repartition(3)
    target = F.col("background")
    model = ce.counted(docs, target, frequent=frequent, sample=1)
    assert len(model.keys) == min(frequent, len(model.keys)) and (frequent == 0 or len(model.keys) > 2)
    got = ce.scored(docs, model, target, ["doc_id", "background"])
    assert got.columns == ["doc_id", "background", "n_tokens", "background", "target", "difference"]
    want = [(i, x, *r) for (i, _, x), r in zip(ROWS, plain_losses([(t, x) for _, t, x in ROWS], 1 << ce.VOCABULARY), strict=True)]
    key = lambda r: repr(r[:3])
    for a, b in zip(sorted((tuple(r) for r in got.collect()), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3]
        assert a[3:] == (pytest.approx(b[3:], rel=1e-9, abs=1e-9) if b[2] else (None,) * 3)


def test_report(spark):
    """Without a target document the target is uniform; more labels of a document count once."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in ROWS[:8]], "doc_id long, text string")
    for good in ([], [1, 1, None, 2]):
        labels = spark.createDataFrame([(i, 1) for i in good] + [(5, 0), (6, None)], "doc_id long, quality int")
        got = sorted((tuple(r) for r in ce.report(docs, labels).collect()), key=lambda r: r[0])
        same(got, [(i, *r) for (i, _, _), r in zip(ROWS, plain_losses([(t, i in good) for i, t, _ in ROWS[:8]], 1 << ce.VOCABULARY))])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert ce.report(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in ce.report(some, labels).collect()} == {1: 1, 2: 0}


def test_tables(spark):
    """Documents that are like the target's score lower than others, though the target doesn't hold them. Here it is half of those of one language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 300")
    labels = docs.where("lang = 'fr' and doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality"))
    rows = ce.report(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 2 = 1").collect()
    alike, others = ([r.difference for r in rows if (r.lang == "fr") == x] for x in (True, False))
    assert len(alike) > 30 and sum(a < b for a in alike for b in others) / (len(alike) * len(others)) > 0.95


def test_copies(spark):
    """A text of rare words that occurs twice is known to the background, one that occurs once isn't."""
    def text(k):
        return " ".join(f"q{k}w{i}" for i in range(60))

    rows = [(k, text(k)) for k in range(40)] + [(100 + k, text(k)) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(30, 40)], "doc_id long, quality int")
    for frequent in (10**6, 0):
        found = {r.doc_id: r.difference for r in ce.report(docs, labels, frequent=frequent, sample=1).collect()}
        twice = [d for i, d in found.items() if i < 10 or i >= 100]
        assert len(twice) == 20 and min(twice) > max(d for i, d in found.items() if 10 <= i < 100) + 1
