"""Ledgers, in batch and as a stream, against a plain fold."""

import random
from datetime import datetime, timedelta

import pytest

import pandas as pd

from paperloom.operators import ledger, progress
from paperloom.streaming import events as streams
from paperloom.streaming import ledger as streamed
from paperloom.streaming import progress as streamed_progress

START = datetime(2024, 1, 1)


def operations(rng, count):
    """Operations on three ledgers, one of which has most of them; scopes overlap, are named twice, or are unknown."""
    rows = []
    for k in range(count):
        who = rng.choice([1, 1, 1, 1, 2, 3])
        op = rng.choice(["reserve", "reserve", "reserve", "reserve", "tool", "sent", "sent", "sent", "succeeded", "failed", "open"] if rng.random() < 0.9 else ["open"])
        scopes = [(f"chunk{k // 15}", [1, 2, 3]), ("paper", [4, 9, 9]), ("pass", [50, 12, 20])][rng.randrange(3) :]
        if rng.random() < 0.1:
            scopes.append(rng.choice([("paper", [99, 99, 99]), ("unheard", None)]))
        if rng.random() < 0.05:
            scopes = rng.choice([[], None])
        request = f"rq{k}" if op == "reserve" else f"rq{rng.randrange(max(0, k - 12), k + 1)}"
        rows.append((who, START + timedelta(minutes=k // 3), k, op, rng.choice(["search", "fetch"]), request, scopes))
    again = [(4, START + timedelta(days=1), count + k, op, "fetch", "one", [("paper", [1, 1, 1])]) for k, op in enumerate(["reserve", "sent", "sent", "reserve", "open", "succeeded"])]
    return rows + again


def plain(rows):
    """The same rules, written down as they are stated: all scopes or none, counted once granted, open until closed."""
    used, limits, state, out = {}, {}, {}, []
    for who, _, seq, op, kind, request, scopes in sorted(rows, key=lambda r: (r[1], r[2])):
        if op == "open":
            for r in sorted(r for (w, r), s in state.items() if w == who and s in ("reserved", "sent")):
                state[who, r] = "unknown"
                out.append((who, seq, r, "recovered", None, "unknown"))
        elif op in ("reserve", "tool"):
            names = []
            for name, _ in scopes or []:
                if name not in names:
                    names.append(name)
            first = {name: next(x for n, x in scopes if n == name) for name in names}
            strange = [n for n in names if (who, n) not in limits and first[n] is None]
            which = {"search": 0, "fetch": 1}[kind] if op == "reserve" else 2
            if strange or not names:
                out.append((who, seq, request, "unknown_scope", strange[0] if strange else None, None))
                continue
            for n in names:
                limits.setdefault((who, n), first[n])
                used.setdefault((who, n), [0, 0, 0])
            full = [n for n in names if used[who, n][which] >= limits[who, n][which]]
            if full:
                out.append((who, seq, request, "tool_calls_exhausted" if op == "tool" else "budget_exhausted", full[0], None))
                continue
            for n in names:
                used[who, n][which] += 1
            if op == "reserve":
                state[who, request] = "reserved"
            out.append((who, seq, request, "granted", names[0], "reserved" if op == "reserve" else None))
        else:
            now = state.get((who, request))
            if now not in ("reserved", "sent"):
                out.append((who, seq, request, "not_open", None, None))
            else:
                state[who, request] = op
                out.append((who, seq, request, ("sent" if now == "reserved" else "unchanged") if op == "sent" else "closed", None, op))
    return sorted(out, key=repr), used


def rows_of(df):
    return sorted(map(tuple, df.select("ledger", "seq", "request", "code", "scope", "state").collect()), key=repr)


@pytest.fixture(scope="module")
def given():
    return operations(random.Random(4), 400)


def test_batch(spark, given):
    want, used = plain(given)
    df = spark.createDataFrame(given, ledger.OPERATIONS).repartition(7)
    assert rows_of(ledger.folded(df)) == want
    assert {c for *_, c, _, _ in want} == {"recovered", "unknown_scope", "tool_calls_exhausted", "budget_exhausted", "granted", "not_open", "sent", "unchanged", "closed"}
    got = {(r.ledger, r.scope): [r.search, r.fetch, r.tool] for r in ledger.usage(df).collect()}
    assert got == {k: n for k, n in used.items() if any(n)}
    assert all(n <= m for k, limits in [((1, "paper"), [4, 9, 9])] for n, m in zip(got[k], limits, strict=True))


def test_stream(spark, given, tmp_path):
    """Files that come one after the other, each over several partitions, give the ledger of the batch."""
    for at in range(0, len(given), 100):
        spark.createDataFrame(given[at : at + 100], ledger.OPERATIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with streams.state_in_rocksdb(spark):
        got = streams.drained(spark, streamed.folded(stream.repartition(3)), ["ledger", "seq", "request"], "append")
    assert rows_of(got) == plain(given)[0]


def test_empty(spark):
    assert ledger.folded(spark.createDataFrame([], ledger.OPERATIONS)).collect() == []


def test_progress(spark, tmp_path):
    """The batch and a stream of several files give the progress that a plain fold gives; units without chunks or a phase have none."""
    rng = random.Random(9)
    rows = []
    for k in range(300):
        kind = rng.choice(["phase", "note", "chunk_started", "chunk_finished", "chunk_failed", "other"])
        chunk = rng.choice([None, 1, 2, 3]) if kind.startswith("chunk") else None
        rows.append((rng.choice([1, 1, 1, 2]), START + timedelta(minutes=k // 4), k, kind, chunk, rng.choice([None, "", f"text {k}"])))
    rows.append((3, START, 300, "note", None, None))
    want = {}
    for unit in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == unit), key=lambda r: (r[1], r[2]))
        phase = next((r[5] for r in reversed(own) if r[3] == "phase"), None)
        chunks = {r[4]: progress.STATES[r[3]] for r in own if r[3] in progress.STATES and r[4] is not None}
        counts = [list(chunks.values()).count(s) for s in ("running", "done", "failed")]
        want[unit] = (unit, phase, *counts, len(own), [r[3] + (f": {r[5]}" if r[5] else "") for r in reversed(own)][:20])
    df = spark.createDataFrame(rows, progress.EVENTS)
    assert {r.unit: tuple(r) for r in progress.tracked(df.repartition(5)).collect()} == want
    for at in range(0, len(rows), 100):
        spark.createDataFrame(rows[at : at + 100], progress.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(progress.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with streams.state_in_rocksdb(spark):
        got = streams.drained(spark, streamed_progress.tracked(stream), ["unit"], "update")
    assert {r.unit: tuple(r[c] for c in ("unit", "phase", "running", "done", "failed", "events", "history")) for r in got.collect()} == want


class CountedState:
    """A value or map of keyed state that counts how often it is asked."""

    def __init__(self):
        self.held, self.asked = {}, 0

    def __getattr__(self, name):
        ways = {
            "exists": lambda: bool(self.held), "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k], "updateValue": lambda k, v: self.held.update({k: v}), "removeKey": lambda k: self.held.pop(k),
            "keys": lambda: iter(list(self.held)), "get": lambda: self.held.get(None), "update": lambda v: self.held.update({None: v}),
        }

        def run(*values):
            self.asked += 1
            return ways[name](*values)

        return run


class Handle:
    def __init__(self):
        self.states = {}

    def state(self, name, *_):
        return self.states.setdefault(name, CountedState())

    getMapState = getValueState = state


def test_state_is_asked_once_a_batch():
    """However many rows a key has, what is known of it is read and written once, and is what row by row would leave."""
    at = pd.Timestamp("2024-01-01")
    limits = [{"id": "w1", "limits": [40, 40, 40]}, {"id": "always", "limits": [60, 60, 60]}]
    kinds = ["reserve", "sent", "tool", "reserve", "failed", "open", "reserve"]
    ops = [{"ledger": 1, "at": at, "seq": n, "op": kinds[n * n % 7], "kind": "search" if n % 3 else "fetch", "request": f"r{n % 4}", "scopes": limits} for n in range(300)]
    scopes, open_ = {}, {}
    expected = [d for op in ops for d in ledger.decided(op, scopes, open_)]
    handle, processor, got = Handle(), streamed.LedgerProcessor(), []
    processor.init(handle)
    for part in (ops[:130], ops[130:131], ops[131:]):
        got += [r for frame in processor.handleInputRows((1,), iter([pd.DataFrame(part)]), None) for r in frame.to_dict("records")]
    assert [tuple(r.values()) for r in got] == [tuple(r.values()) for r in expected]
    assert {k: tuple(v) for (k,), v in handle.states["scopes"].held.items()} == scopes
    assert {k: v for (k,), (v,) in handle.states["open"].held.items()} == open_
    assert sum(s.asked for s in handle.states.values()) < 90

    handle, work = Handle(), streamed_progress.ProgressProcessor()
    work.init(handle)
    events = [{"unit": 1, "at": at, "seq": n, "kind": ["phase", "chunk_started", "chunk_finished", "chunk_failed", "note"][n * n % 5], "chunk": n % 3, "text": f"t{n}"} for n in range(200)]
    for part in (events[:90], events[90:]):
        (row,) = (r for frame in work.handleInputRows((1,), iter([pd.DataFrame(part)]), None) for r in frame.to_dict("records"))
    last = {e["chunk"]: e["kind"] for e in events if e["kind"].startswith("chunk")}
    assert [row[s] for s in ("running", "done", "failed")] == [sum(k == x for k in last.values()) for x in ("chunk_started", "chunk_finished", "chunk_failed")]
    assert row["events"] == 200 and row["history"] == [f"{e['kind']}: {e['text']}" for e in events[:-21:-1]] and row["phase"] == [e["text"] for e in events if e["kind"] == "phase"][-1]
    assert sum(s.asked for s in handle.states.values()) < 40
