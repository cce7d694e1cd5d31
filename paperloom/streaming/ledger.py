"""The budget ledger over a stream of operations: scopes and open reservations are state of the ledger's key."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import ledger


class _Mapping(MutableMapping):
    """A map of keyed state as a mapping, held while a ledger's rows are handled: what is asked for is read once, and written back once by save()."""

    def __init__(self, state, read, write):
        self.state, self.read, self.write = state, read, write
        self.load()

    def load(self) -> None:
        """Forgets the ledger before. What is new has nothing to read."""
        self.known: dict[str, object] = {}  # None: isn't there
        self.changed: dict[str, bool] = {}  # whether it is there in the state
        self.stored: bool | None = None

    def _look(self, key: str):
        if key not in self.known:
            if self.stored is None:
                self.stored = self.state.exists()
            there = self.stored and self.state.containsKey((key,))
            self.known[key] = self.read(self.state.getValue((key,))) if there else None
        return self.known[key]

    def _put(self, key: str, value) -> None:
        self.changed.setdefault(key, self._look(key) is not None)
        self.known[key] = value

    def __getitem__(self, key: str):
        if (value := self._look(key)) is None:
            raise KeyError(key)
        return value

    def __setitem__(self, key: str, value) -> None:
        self._put(key, value)

    def __delitem__(self, key: str) -> None:
        self[key]
        self._put(key, None)

    def __iter__(self) -> Iterator[str]:
        if self.stored is None:
            self.stored = self.state.exists()
        for key in [k[0] for k in self.state.keys()] if self.stored else []:
            self._look(key)
        return iter([k for k, v in self.known.items() if v is not None])

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def save(self) -> None:
        for key, there in self.changed.items():
            if (value := self.known[key]) is not None:
                self.state.updateValue((key,), self.write(value))
            elif there:
                self.state.removeKey((key,))


class LedgerProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scopes = _Mapping(handle.getMapState("scopes", "id string", "limits array<bigint>, used array<bigint>"), lambda v: ([int(n) for n in v[0]], [int(n) for n in v[1]]), tuple)
        self.open = _Mapping(handle.getMapState("open", "request string", "state string"), lambda v: v[0], lambda v: (v,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.scopes.load()
        self.open.load()
        ops = [r | {"scopes": [] if r["scopes"] is None else list(r["scopes"])} for frame in rows for r in frame.to_dict("records")]
        out = [d for op in ledger.in_order(ops) for d in ledger.decided(op, self.scopes, self.open)]
        self.scopes.save()
        self.open.save()
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def folded(operations: DataFrame) -> DataFrame:
    """As the batch version gives them, if what arrives together is in order with what came before. State is kept in RocksDB; see `state_in_rocksdb`."""
    return operations.groupBy("ledger").transformWithStateInPandas(statefulProcessor=LedgerProcessor(), outputStructType=ledger.DECISIONS, outputMode="append", timeMode="none")
