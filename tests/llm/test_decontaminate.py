import pickle
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    patterns = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns[n][tuple(w[k : k + n])].add(None if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, ids = [0] * len(w), set()
        for n, by in patterns.items():
            for k in range(len(w) - n + 1):
                if found := by.get(tuple(w[k : k + n])):
                    ids |= found - {None}
                    hit[k : k + n] = [1] * n
        out.append((doc, len(w), sum(hit), sorted(ids), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect()), key=repr)


PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
DOCS = [
    (1, f"x {PASSAGE.upper()}, y"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (3, None),
    (4, ""),
    (5, "short item! " * 3 + "été 北京 word " * 400),
    (5, "short item! " * 3 + "été 北京 word " * 400),
    (None, "a " * 30 + PASSAGE),
    (7, " ... \n"),
    (8, PASSAGE + " " + PASSAGE),
    (9, "short"),
    (10, "item"),
]
ITEMS = [(10, PASSAGE), (9, "Short item"), (11, "nu xi"), (12, None), (None, "alpha beta"), (13, "..."), (9, "Short item"), (14, "北京")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_small(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, "en") for i, t in DOCS], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.occurrences(docs, items, ["doc_id"], block_bytes=block_bytes).withColumn("contaminated", decontaminate.contaminated())
    assert result(found) == brute(DOCS, ITEMS)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in brute(DOCS, ITEMS) if not r[4])


def test_blocks(spark):
    """A block's tables take a bounded multiple of its bytes; equal windows of many items are one pattern; whatever the blocks, the result is the same."""
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 40))) for _ in range(4000)]
    block = decontaminate.block_of([str(k) for k in range(4000)], pa.array(pool))
    assert len(pickle.dumps(block)) < 25 * sum(map(len, pool))
    same = decontaminate.block_of([str(k % 50) for k in range(400)], pa.array([pool[0]] * 400))
    assert len(same.patterns[0].at) == max(1, len(pool[0].split()) - 12) and same.patterns[0].ids(same.items, 0) == sorted(map(str, range(50)))
    docs = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(4)))) for k in range(60)] + [(99, pool[5]), (99, pool[5])]
    items = list(enumerate(pool[:300]))
    for block_bytes in (1 << 20, 9000):
        got = decontaminate.occurrences(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_bytes=block_bytes)
        assert result(got.withColumn("contaminated", decontaminate.contaminated())) == brute(docs, items)


def test_long(spark):
    """Very long texts, with occurrences at their ends, and a very long item."""
    long = " ".join(f"v{k}" for k in range(150_000))
    docs = [(1, f"{PASSAGE} {long} {PASSAGE}"), (2, "x" * 3_000_000), (3, "alpha " * 400_000), (4, long)]
    for items in ([(1, PASSAGE)], [(1, PASSAGE), (2, long)]):
        got = result(decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).withColumn("items", F.filter(F.split("items", ","), lambda x: x != "")))
        assert got == brute(docs, items)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, items).count() == 0
    some = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert not any(r.contaminated for r in decontaminate.report(some, items).collect())


def test_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    found = result(decontaminate.report(docs, items).withColumn("items", F.filter(F.split("items", ","), lambda x: x != "")))
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[4] for r in found)
