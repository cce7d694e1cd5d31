import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import packing


def assigned(plan, counts):
    """bin, offset and size of every piece, looked up one by one."""
    out = []
    for size, n in counts.items():
        for number in range(n):
            k = max(i for i in range(len(plan.size)) if plan.size[i] == size and plan.first[i] <= number)
            whole, rest = divmod(number - int(plan.first[k]), int(plan.per_bin[k]))
            out.append((int(plan.bin[k]) + whole, int(plan.offset[k]) + rest * size, size))
    return out


def sound(pieces, length_of):
    """Pieces of a bin fill it from the start without a gap, up to its length at most."""
    bins = defaultdict(list)
    for b, offset, size in pieces:
        bins[b].append((offset, size))
    for b, own in bins.items():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end <= length_of(b)
    return bins


def best_fit(sizes, capacity):
    """Best fit decreasing, one piece at a time: the number of bins."""
    room = []
    for s in sorted(sizes, reverse=True):
        fitting = [r for r in room if r >= s]
        if fitting:
            room.remove(min(fitting))
            room.append(min(fitting) - s)
        else:
            room.append(capacity - s)
    return len(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan(sizes):
    counts = Counter(sizes)
    plan = packing.planned(counts, (8, 16, 32))
    length = dict(zip(plan.bins.tolist(), plan.length.tolist()))
    pieces = assigned(plan, counts)
    lengths = sorted(plan.bins.tolist() + [10**9])
    of = lambda b: length[max(x for x in lengths if x <= b)]
    bins = sound(pieces, of)
    assert Counter(s for *_, s in pieces) == counts
    assert plan.cost == sum(of(b) for b in bins)
    for b, own in bins.items():  # cut down to the contents
        assert of(b) == min(x for x in (8, 16, 32) if x >= sum(s for _, s in own))
    single = packing._one_plan(counts, [32], ((32,), None), packing.cost_of)
    assert len(set(b for b, *_ in assigned(single, counts))) == best_fit(sizes, 32)
    assert plan.cost <= 32 * best_fit(sizes, 32)


def test_small(spark):
    random.seed(2)
    texts = [None, "", " ", "w " * 20, "w " * 8, "w " * 8] + ["w " * random.randint(1, 12) for _ in range(200)]
    rows = [(k // 2, t, 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = packing.packed(packing.counted(docs, ["doc_id", "size"]), ["doc_id", "size"], F.col("n_tokens"), (4, 8))
    assert got.columns[:2] == ["doc_id", "size"]
    got = got.toDF("doc_id", "own_size", "piece", "start", "size", "bin", "bin_length", "offset").collect()
    assert sum(r.bin is None for r in got) == 3
    length = {r.bin: r.bin_length for r in got}
    sound([(r.bin, r.offset, r.size) for r in got if r.bin is not None], length.get)
    assert sum(r.size or 0 for r in got) == sum(len((t or "").split()) for t in texts)
    assert sorted((r.piece, r.start, r.size) for r in got if r.doc_id == 1 and r.piece is not None) == [(0, 0, 8), (1, 8, 8), (2, 16, 4)]


def test_empty(spark):
    assert packing.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.report(docs).collect()
    length = {r.bin: r.bin_length for r in got}
    sound([(r.bin, r.offset, r.size) for r in got if r.bin is not None], length.get)
    own = Counter()
    for r in got:
        own[r.doc_id] += r.size or 0
    want = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert set(own) == set(want)
    assert sum(own.values()) >= 0.97 * sum(length.values())
    assert np.array_equal([own[k] for k in want], list(want.values()))
