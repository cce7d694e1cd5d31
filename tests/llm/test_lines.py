import random

import numpy as np

from paperloom.llm import lines


def trimmed(line):
    return line.strip(" \t\n\r\x0b\x0c")


def brute(rows, least):
    """Lines to delete of each (id, text): every run of `least` words that is found, line by line, at an earlier place. Equal runs have one number, made line by line."""
    docs = []
    for doc, text in rows:
        own = [trimmed(x) for x in (text or "").split("\n")]
        docs.append((doc, len(own), [(k, x) for k, x in enumerate(own) if x]))
    number, seen, runs = {}, {}, []
    for d, (doc, total, own) in enumerate(docs):
        sizes = [len(x.split()) for _, x in own]
        for a in range(len(own)):
            key, n = 0, 0
            for b in range(a, len(own)):
                key = number.setdefault((key, own[b][1]), len(number) + 1)
                n += sizes[b]
                if n >= least:
                    place = ((-1 if doc is None else doc), a)
                    seen[key] = min(seen.get(key, place), place)
                    runs.append((d, own[a][0], own[b + 1][0] if b + 1 < len(own) else total, key, place))
    out = [set() for _ in docs]
    for d, a, end, key, place in runs:
        if seen[key] < place:
            out[d] |= set(range(a, end))
    return out


def check(spark, rows, least):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_lines int, run_id string")
    got = lines.deduplicated(df, least=least, counts=("all", "gone"))
    assert got.columns == ["doc_id", "text", "n_lines", "run_id", "all", "gone"]
    want = []
    for (doc, text), gone in zip(rows, brute(rows, least)):
        rest = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        want.append((doc, rest, 0 if text is None else text.count("\n") + 1, len(gone)))
    assert sorted(map(repr, ((r.doc_id, r.text, r["all"], r.gone) for r in got.collect()))) == sorted(map(repr, want))


def test_cases(spark):
    a, b, c = "a b c d", "e f", "g h i j k l"
    rows = [
        (1, f"{a}\n{b}\n{c}\nend"), (2, f"x\n{a}\n{b}\n{c}"), (3, f"{b}\n{c}"), (4, a), (5, a), (6, f"{c}\n\n{c}\n \n{c}"), (7, None), (8, ""), (9, "\n\n"),
        (10, f"  {a} \n{b}\t\n{c}\r"), (None, f"{a}\n{b}"), (11, f"{c}\n{a}"), (11, f"{c}\n{a}"), (12, "w " * 50), (13, "w " * 50 + "\n" + "w " * 49), (14, f"{b}\n\n{b}\n\n{b}\n{b}\n\n{b}"),
    ]
    for least in (1, 4, 6, 10):
        unique = {}
        for d, t in rows:
            unique.setdefault((d, t), (d, t))
        check(spark, list(unique.values()), least)


def test_random(spark):
    rng = random.Random(4)
    for trial in range(3):
        pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 6))) for _ in range(9)]
        rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
        check(spark, rows, (3, 6, 9)[trial])


def test_repeated_rows(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_deleted) for r in lines.deduplicated(df, least=3).collect())
    assert got == [(1, "a b c d", 0), (2, "", 1), (2, "", 1)]


def test_long(spark):
    """Very long texts, of one line and of many, and many short runs in one text."""
    long = "\n".join(f"line {k} of the long text" for k in range(60_000))
    copies = "\n".join(f"own {k}\n{' '.join(f'w{k}x{j}' for j in range(50))}" for k in range(3000))
    rows = [(1, long), (2, "x" * 2_000_000), (3, "w " * 500_000), (4, f"first\n{long}\nlast"), (5, copies), (6, copies.replace("own", "other"))]
    got = {r.doc_id: r for r in lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4].text == "first\nlast" and got[4].n_deleted == 60_000
    assert all(got[k].text == t for k, t in rows if k not in (4, 6))
    assert got[6].text == "\n".join(f"other {k}" for k in range(3000)) and got[6].n_deleted == 3000


def test_names(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, "x"), (2, "a b c d", 6, "y")], "doc_id long, text string, n_lines long, N_DELETED string")
    got = lines.deduplicated(df, least=3)
    assert got.columns == ["doc_id", "text", "n_lines", "N_DELETED", "n_lines_", "n_deleted_"]
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d", 5, "x", 1, 0), (2, "", 6, "y", 1, 1)]


def test_empty(spark):
    assert lines.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_window_has_shared_fingerprint():
    rng = np.random.default_rng(3)
    h, w = rng.integers(0, 1 << 62, 40).astype(np.uint64), rng.integers(1, 9, 40)
    first = np.array([0, 40])
    start, end, fp = lines.windows(h, w, first, 20)
    for a, b, f in zip(start, end, fp):
        assert w[a : b + 1].sum() >= 20 and f == h[a : b + 1].min()


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, rows, lines.MIN_WORDS)
