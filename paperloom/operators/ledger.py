"""A ledger of budgets: requests are granted by all the scopes that they name, or by none.

An operation names a ledger and scopes, the narrowest first, each with limits for every kind of request.
A scope comes into being with the limits that it is first named with; later ones don't refill it. What
is granted counts at once and is never given back. A granted reservation is open, reserved or sent,
until it succeeds or fails; when a ledger is opened anew, what is open becomes unknown.

Rows of a ledger follow each other, so they are folded in order: in batch one task streams through the
sorted rows of its ledgers and holds one ledger's scopes and open reservations at a time; in a stream
these are keyed state. Closed reservations aren't held, so the state doesn't grow with the history.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, MutableMapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of requests that limits are given for, in order; verdicts; states of a reservation.
KINDS = ("search", "fetch", "tool")
GRANTED, EXHAUSTED, TOOLS_EXHAUSTED, UNKNOWN_SCOPE, NOT_OPEN = "granted", "budget_exhausted", "tool_calls_exhausted", "unknown_scope", "not_open"
RESERVED, SENT, UNKNOWN = "reserved", "sent", "unknown"

OPERATIONS = "ledger long, at timestamp, seq long, op string, kind string, request string, scopes array<struct<id: string, limits: array<bigint>>>"
DECISIONS = "ledger long, seq long, request string, code string, scope string, state string"

#: (limits, used) of a scope.
Counters = tuple[list[int], list[int]]


def decided(op: dict, scopes: MutableMapping[str, Counters], open_: MutableMapping[str, str]) -> Iterator[dict]:
    """What an operation leads to; scopes and open reservations follow. Operations: reserve and tool, sent, succeeded and failed, and open."""
    own = {"ledger": op["ledger"], "seq": op["seq"], "request": op["request"], "code": None, "scope": None, "state": None}
    if op["op"] == "open":
        for request in sorted(open_):
            del open_[request]
            yield own | {"request": request, "code": "recovered", "state": UNKNOWN}
    elif op["op"] in ("reserve", "tool"):
        named = {s["id"]: s["limits"] for s in reversed(op["scopes"] or [])}  # of a scope named twice the first counts
        found: dict[str, Counters] = {}
        for name in dict.fromkeys(s["id"] for s in op["scopes"] or []):
            counters = scopes.get(name) or (named[name] is not None and ([int(n) for n in named[name]], [0] * len(KINDS)))
            if not counters:
                yield own | {"code": UNKNOWN_SCOPE, "scope": name}
                return
            found[name] = counters
        if not found:
            yield own | {"code": UNKNOWN_SCOPE}
            return
        kind = KINDS.index("tool" if op["op"] == "tool" else op["kind"])
        full = next((name for name, (limits, used) in found.items() if used[kind] >= limits[kind]), None)
        for name, (limits, used) in found.items():
            scopes[name] = (limits, [n + (full is None and k == kind) for k, n in enumerate(used)])
        if full is not None:
            yield own | {"code": TOOLS_EXHAUSTED if op["op"] == "tool" else EXHAUSTED, "scope": full}
        elif op["op"] == "tool":
            yield own | {"code": GRANTED, "scope": next(iter(found))}
        else:
            open_[op["request"]] = RESERVED
            yield own | {"code": GRANTED, "scope": next(iter(found)), "state": RESERVED}
    else:
        state = open_.get(op["request"])
        if state is None:
            yield own | {"code": NOT_OPEN}
        elif op["op"] == "sent":
            open_[op["request"]] = SENT
            yield own | {"code": "sent" if state == RESERVED else "unchanged", "state": SENT}
        else:
            del open_[op["request"]]
            yield own | {"code": "closed", "state": op["op"]}


def in_order(rows: Iterable[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (r["at"], r["seq"]))


def folded(operations: DataFrame) -> DataFrame:
    """A row for each operation, and for each reservation that an opening recovers: its code, the scope that refused or that keeps it, its state then."""
    schema = pa.schema([("ledger", pa.int64()), ("seq", pa.int64()), *((c, pa.string()) for c in ("request", "code", "scope", "state"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, scopes, open_ = None, {}, {}
        for batch in batches:
            out = []
            for op in batch.to_pylist():
                if op["ledger"] != current:
                    current, scopes, open_ = op["ledger"], {}, {}
                out.extend(decided(op, scopes, open_))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    names = [f.split()[0] for f in OPERATIONS.split(", ")[:6]] + ["scopes"]
    return operations.select(*names).repartition("ledger").sortWithinPartitions("ledger", "at", "seq").mapInArrow(run, DECISIONS)


def usage(operations: DataFrame) -> DataFrame:
    """ledger, scope, and how much of each kind the scope has granted; a scope that granted nothing has no row."""
    granted = folded(operations).where(F.col("code") == GRANTED).select("ledger", "seq")
    kind = F.when(F.col("op") == "tool", "tool").otherwise(F.col("kind")).alias("of")
    each = operations.join(granted, ["ledger", "seq"]).select("ledger", F.explode(F.array_distinct(F.col("scopes.id"))).alias("scope"), kind)
    return each.groupBy("ledger", "scope").agg(*(F.count_if(F.col("of") == k).alias(k) for k in KINDS))
