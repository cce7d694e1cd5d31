import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from paperloom.llm import periods
from paperloom.llm.text import Texts


def brute_runs(words):
    """Every stretch with smallest period q and length >= max(24, 3q) that can't grow, by comparing words at every lag."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(24, 3 * q) and (start, length) not in found:  # smaller periods come first
                found[start, length] = q
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), kept)]
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


def rows_of(df):
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def texts(rng, count):
    """Texts with runs of all kinds: nested, touching, of near periods, of periods that repeat parts of themselves."""
    for _ in range(count):
        kinds = rng.choice([1, 2, 3, 50])
        out = []
        for _ in range(rng.randrange(1, 5)):
            unit = [f"w{rng.randrange(kinds)}" for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 20, 33, 40]))]
            if rng.random() < 0.3:
                loops = [[f"x{k}"] + ["c"] * 17 for k in range(3)]  # every 16-gram occurs more than once in a period
                unit = sum((loops[k] for k in (0, 1, 2, 0, 2, 1)), [])
            part = (unit * rng.choice([1, 3, 4, 9]))[: rng.randrange(1, 400)]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "odd"
            out += part
        yield rng.choice([" ", "\n", "\t "]).join(out)


def test_brute(spark):
    rng = random.Random(13)
    rows = [(rng.choice([None, k, k]), t) for k, t in enumerate(texts(rng, 300))]
    rows += [(1, None), (2, ""), (3, " \n"), (None, None), (4, "a"), (4, "a"), (5, "a " * 23), (6, "a " * 24), (7, "a b " * 12), (8, "é ü " * 30 + "x"), (9, "a b c d e f g h i " * 2 + "a b c d e f g h"), (10, "a b c d e f g h i " * 3)]
    docs = spark.createDataFrame([(d, t, 5, "h") for d, t in rows], "doc_id long, text string, n_runs int, h string")
    assert rows_of(periods.report(docs)) == sorted((brute(*r) for r in rows), key=repr)


def test_given(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000")
    assert rows_of(periods.report(docs)) == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_empty(spark):
    assert rows_of(periods.report(spark.createDataFrame([], "doc_id long, text string"))) == []


@pytest.mark.parametrize("unit", [["a"], ["a", "b"], [f"w{k}" for k in range(1000)]])
def test_long(unit):
    """A text of 600,000 words that is one run, whatever its period; its k-grams occur very often."""
    n = 600_000
    found = periods.runs_of(Texts(pa.array([" ".join((unit * n)[:n])])))
    assert (found.start.tolist(), found.length.tolist(), found.period.tolist()) == ([0], [n], [len(unit)])
    assert found.collapsed() == [" ".join(unit).encode()]


def test_fibonacci():
    """Words of a Fibonacci string, with runs at every scale."""
    a, b = ["a"], ["a", "b"]
    while len(b) < 3000:
        a, b = b, b + a
    found = periods.runs_of(Texts(pa.array([" ".join(b)])))
    assert list(zip(found.start, found.length, found.period, strict=True)) == brute_runs(b) and len(found.start) > 300


def test_collapsed(spark):
    rows = [(1, "x " + "a b c " * 10 + "y", "p", 3), (2, None, "q", 4), (3, " one\n two ", None, 5), (None, "", "r", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, n_runs int")
    got = periods.collapsed(docs, n_runs="n_runs")
    assert got.columns == ["doc_id", "text", "n", "n_runs", "n_runs_"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "x a b c y", "p", 3, 1), (2, None, "q", 4, 0), (3, "one two", None, 5, 0), (None, "", "r", 6, 0)], key=repr)
    assert periods.collapsed(docs).columns == docs.columns
    assert periods.runs(docs).collect() == [(1, 1, 30, 3)]
