import random
import re

import numpy as np
import pytest

from paperloom.llm import jaccard

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(id, links, group id) of every row, from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    alike = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    label = list(range(len(rows)))
    while any(label[j] < label[i] for i in range(len(rows)) for j in alike[i]):
        for i in range(len(rows)):
            label[i] = min([label[i], *(label[j] for j in alike[i])])
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(rows[i][0])
    least = {x: min((i for i in g if i is not None), default=None) for x, g in groups.items()}
    return sorted(((rows[i][0], len(alike[i]), least[label[i]]) for i in range(len(rows))), key=repr)


def result(df):
    return sorted(((r.id, r.n_links, r.group_id) for r in df.collect()), key=repr)


def corpus(seed, n=60, words=60):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(words)] for _ in range(6)]
    rows = []
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [jaccard.BLOCK, 700])
def test_all_links(spark, block):
    rows = corpus(1) + [(100, None), (101, ""), (102, "!"), (103, "One two"), (104, "one, TWO"), (105, "two one"), (106, "a b c d e"), (107, "a b c d"), (None, "one two"), (None, "lonely words"), (108, "a a a a a a a a a")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, group int")
    assert result(jaccard.joined(df, block=block)) == brute(rows)


def test_empty_blocks(spark):
    """Groups of three long near copies in three blocks, of which some stay empty."""
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(400)]
        for k in range(3):
            base[k * 150] = f"g{g}x{k}"
            rows.append((len(rows), " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(jaccard.joined(df, block=400))
    assert got == brute(rows) and all(n == 2 for _, n, _ in got)


def test_repeated_rows(spark):
    rows = corpus(2, 20)
    rows = rows + rows[:5] + [(300, rows[4][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, g_id string")
    assert result(jaccard.joined(df)) == brute(rows)
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for _, _, g in brute(rows)})


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.report(df).count() == 0
    assert jaccard.representatives(df).count() == 0


def test_common():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120))).astype(np.int64) for _ in range(70)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert np.array_equal(jaccard.common(sets), want)
    assert np.array_equal(jaccard.common(sets[:2]), np.array(want)[:2, :2])


def test_banding():
    bands, rows = jaccard.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL


def test_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    got = sorted(((r.doc_id, r.n_links, r.class_id) for r in jaccard.report(df).collect()), key=repr)
    assert got == want and any(n for _, n, _ in got)
    assert sorted(r.doc_id for r in jaccard.representatives(df).collect()) == sorted({g for *_, g in want})
