import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import fingerprints as fp

from ..test_plans import plan

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def keys(text):
    found = (p.strip(" ") for p in re.findall(fp.PARAGRAPH, text))
    digests = {int(hashlib.md5(p.encode()).hexdigest()[:10], 16) for p in found if p}
    return {(d << 20) + d % 1048573 * 48271 % 1048573 for d in digests}


def written(own):
    cells = [0] * 24
    for k in own:
        for t in range(3):
            cells[8 * t + (k >> 20 + 3 * t) % 8] ^= k
    return " ".join(f"{c:x}" for c in cells)


def brute(rows):
    def signed(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    docs = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for i, (doc, text) in enumerate(docs):
        other = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = map(keys, (text, edited, other))
        near = [2 * len(a & x) / (len(a) + len(x)) if a or x else 1.0 for x in (b, c)]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), *near))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def texts(rng, count):
    marks = [". ", "! ", "\n", "? ", "  ", "...", "\n\n", " é🙂 "]
    for _ in range(count):
        yield "".join(rng.choice("abcdefgh ") * rng.randrange(1, 5) + rng.choice(marks) for _ in range(rng.choice([0, 1, 3, 10, 30, 200])))


@pytest.mark.parametrize("range_rows", [1, 7, 1000])
def test_brute(spark, range_rows):
    rng = random.Random(range_rows)
    own = list(texts(rng, 60))
    rows = [(rng.choice([None, 5, 5, 5, 9, rng.randrange(1 << 40), -rng.randrange(50)]), t) for t in own]
    rows += [(5, own[0])] * 6 + [(3, None), (4, ""), (7, "x" * 1000), (8, ". " * 50), (None, None), (11, own[30]), (10, own[30])]
    docs = spark.createDataFrame([(d, t, 1, "h", True) for d, t in rows], "doc_id long, text string, range int, h string, guest boolean")
    assert rows_of(fp.report(docs, range_rows)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(3, "one. two.")], [(None, None)], [(2, "a"), (1, "a")]])
def test_few(spark, rows):
    assert rows_of(fp.report(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_given(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(fp.report(docs, 20)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_long(spark):
    """Texts of 20,000 paragraphs, unlike each other, are compared in blocks."""
    rng = random.Random(1)
    rows = [(k, " ".join(f"Line {rng.random()}\n" for _ in range(20_000))) for k in range(2)]
    assert rows_of(fp.report(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_peeling(spark):
    """What peels is exactly the keys that differ; what doesn't is null, not wrong, and larger sketches recover it."""
    rng = random.Random(3)

    def key(d):
        return (d << 20) + d % 1048573 * 48271 % 1048573

    rows = []
    for _ in range(200):
        shared = [key(rng.randrange(1 << 40)) for _ in range(rng.choice([0, 5, 300]))]
        mine = lambda: [key(rng.randrange(1 << 40)) for _ in range(rng.choice([0, 1, 4, 12]))]
        rows.append((shared + mine(), mine() + shared))
    rows.append(([key(5)], [key(5 + (1 << 20))]))  # the same three cells of a fingerprint
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    both = lambda cells, salt: fp.peeled(fp.subtracted(fp.sketch(F.col("a"), cells, salt), fp.sketch(F.col("b"), cells, salt)), cells, salt)
    missed = []
    for r in df.select("a", "b", both(8, 0).alias("small"), both(64, 9).alias("large")).collect():
        want = set(r.a) ^ set(r.b)
        assert r.small is None or set(r.small) == want and len(r.small) == len(want)
        assert set(r.large) == want
        missed.append(r.small is None)
    assert missed[-1] and sum(missed) < 100


def test_plan(spark, sf):
    """Built-in expressions only, and one shuffle of the texts."""
    p = plan(fp.report(spark.read.parquet(f"{sf}/documents.parquet")))
    assert "Python" not in p and "Arrow" not in p and "SinglePartition" not in p
