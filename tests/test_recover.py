"""Lists and files, recent results and first resources, against plain versions; repeated and late requests of a stream."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperloom.operators import recover, resources
from paperloom.streaming import events as streams

START = datetime(2024, 1, 1)


def test_reconciled(spark):
    rng = random.Random(3)
    listed = [("p", k, rng.choice(["a", "b", None])) for k in range(60) if rng.random() < 0.6]
    files = [("p", k, rng.choice("abc"), at, rng.random() < 0.5) for k in range(80) if rng.random() < 0.7 for at in rng.sample(range(9), rng.choice([1, 1, 1, 2, 3]))]
    want, after = [], []
    found = {}
    for f in files:
        found.setdefault(f[1], []).append(f)
    hashes = {k: h for _, k, h in listed}
    for k in sorted(set(found) | set(hashes)):
        own = sorted(found.get(k, []), key=lambda f: (f[3], f[2]))
        new = own.pop() if own else None
        want += [("p", k, "superseded", f[2], f[3]) for f in own]
        if k in hashes and not new:
            want.append(("p", k, "missing", hashes[k], None))
        elif k in hashes:
            state = "no_hash" if hashes[k] is None else "kept" if hashes[k] == new[2] else "hash_mismatch"
            want.append(("p", k, state, new[2], new[3]))
        else:
            want.append(("p", k, "adopted" if new[4] else "discarded", new[2], new[3]))
        after += [("p", k, w[3]) for w in want[-1:] if w[2] in ("kept", "adopted")]
    lists = spark.createDataFrame(listed, "paper string, path int, hash string")
    got = recover.reconciled(lists, spark.createDataFrame(files, "paper string, path int, hash string, written_at int, whole boolean"), ["paper", "path"], F.col("whole")).cache()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"kept", "missing", "hash_mismatch", "no_hash", "adopted", "discarded", "superseded"}
    assert sorted(map(tuple, recover.as_listed(got, ["paper", "path"]).collect())) == sorted(after)
    states = spark.createDataFrame([("p", "researching"), ("q", "translated"), ("r", "researching")], "paper string, state string")
    rows = {r.paper: r for r in recover.report(got, ["paper"], states).collect()}
    assert [(r.state_after, r.changed, r.missing) for r in (rows["p"], rows["q"], rows["r"])] == [("context_pending", True, sum(w[2] == "missing" for w in want)), ("translated", False, 0), ("context_pending", True, 0)]


def test_latest_within(spark):
    rng = random.Random(5)
    at = lambda: START + timedelta(seconds=rng.randrange(20_000), microseconds=rng.choice([0, 1, 999_999]))
    requests = [(k, rng.choice([1, 1, 2, None]), at()) for k in range(200)]
    results = [(rng.choice([1, 1, 2, None]), at(), k) for k in range(150)] + [(1, r[2], 900 + r[0]) for r in requests[:5]] + [(1, r[2] - timedelta(seconds=700), 990 + r[0]) for r in requests[:5]]
    want = {}
    for k, user, t in requests:
        near = [(b, n) for u, b, n in results if u == user and user is not None and t - timedelta(seconds=700) < b <= t]
        want[k] = max(near)[1] if near else None
    got = resources.latest_within(spark.createDataFrame(requests, "id int, user int, ts timestamp"), spark.createDataFrame(results, "user int, ts timestamp, n int"), ["user"], "ts", 700)
    assert {r.id: r.result and r.result.n for r in got.collect()} == want and len({v is None for v in want.values()}) == 2


def test_chosen(spark):
    bad = ["http://localhost/a", "http://x.localhost/a", "http://127.0.0.1/a", "http://10.1.1.1/a", "http://192.168.0.4/a", "https://u:p@a.org/x", "https://www.youtube.com/shorts/1", "https://www.youtube.com/watch", "https://a.org/search", "https://a.org/results?q=1", None]
    good = ["https://youtu.be/abc", "https://www.youtube.com/watch?v=1", "https://youtube.com/watch?a=2&v=1", "https://a.org/searching", "https://b.org", "https://c.org/watch", "https://d.org/1", "https://d.org/2"]
    rows = [(1, u, n, True) for n, u in enumerate([*bad, *good, *good])] + [(2, "https://b.org", 5, False), (2, "https://b.org", 6, True)]
    got = resources.chosen(spark.createDataFrame(rows, "g int, url string, n int, ok boolean"), ["g"], "url", ["n"], F.col("ok")).collect()
    assert [(r.url, r.n, r.place) for r in sorted(got, key=lambda r: (r.g, r.place)) if r.g == 1] == [(u, len(bad) + k, k + 1) for k, u in enumerate(good[:6])]
    assert [(r.n, r.place) for r in got if r.g == 2] == [(6, 1)]


def test_requests_of_a_stream(spark, tmp_path):
    """Requests that come again in later files, and late, are given once, with the answer there is."""
    files = [[(1, "a", 0), (1, "a", 1), (2, "b", 2)], [(1, "a", 60), (3, "c", 61), (2, "b", 1)], [(3, "c", 3), (4, None, 62), (4, None, 63)]]
    for rows in files:
        df = spark.createDataFrame([(u, w, START + timedelta(minutes=m)) for u, w, m in rows], "user int, what string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user int, what string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.drained(spark, streams.first_requests(stream, "ts", ["user", "what"], "1 day"), ["user", "what"], "append")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a"), (2, "b"), (3, "c"), (4, None)], key=repr)
    answers = spark.createDataFrame([(1, "a", 1, "old"), (1, "a", 2, "new"), (2, "z", 1, "other")], "user int, what string, n int, text string")
    asked = streams.answered(got, answers, ["user", "what"], ["n"]).collect()
    assert {(r.user, r.what): (r.cached, r.answer and r.answer.text) for r in asked} == {(1, "a"): (True, "new"), (2, "b"): (False, None), (3, "c"): (False, None), (4, None): (False, None)}
