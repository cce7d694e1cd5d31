"""Progress of work over a stream of events: what is known of a unit is keyed state, and each trigger publishes a unit's progress once, however many events it brought."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import progress


class ProgressProcessor(StatefulProcessor):
    """State: the phase and the numbers of events and of chunks by state, each chunk's state, and the last entries of the history."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "phase string, running long, done long, failed long, events long")
        self.chunks = handle.getMapState("chunks", "chunk long", "state string")
        self.history = handle.getValueState("history", "entries array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((r for frame in rows for r in frame.to_dict("records")), key=lambda r: (r["at"], r["seq"]))
        names = list(progress.STATES.values())
        sums = self.sums.get() if self.sums.exists() else None
        phase, *counts = sums or (None, 0, 0, 0, 0)
        counts = dict(zip([*names, "events"], map(int, counts), strict=True))
        recent = list(self.history.get()[0])[::-1] if sums else []
        states: dict[int, str | None] = {}  # of the chunks that these events are about, read and written once
        for e in events:
            counts["events"] += 1
            recent.append(progress.entry(e["kind"], e["text"]))
            if e["kind"] == progress.PHASE:
                phase = e["text"]
            elif e["kind"] in progress.STATES and not pd.isna(e["chunk"]):
                chunk = int(e["chunk"])
                if chunk not in states:
                    states[chunk] = self.chunks.getValue((chunk,))[0] if sums and self.chunks.containsKey((chunk,)) else None
                if states[chunk]:
                    counts[states[chunk]] -= 1
                states[chunk] = progress.STATES[e["kind"]]
                counts[states[chunk]] += 1
        for chunk, state in states.items():
            self.chunks.updateValue((chunk,), (state,))
        recent = recent[: -progress.HISTORY - 1 : -1]
        self.sums.update((phase, *(counts[n] for n in names), counts["events"]))
        self.history.update((recent,))
        yield pd.DataFrame([{"unit": key[0], "phase": phase, **counts, "history": recent}])

    def close(self) -> None:
        pass


def tracked(events: DataFrame) -> DataFrame:
    """As the batch version gives them, if what arrives together is in order with what came before. The last row of a unit counts; state is kept in RocksDB."""
    return events.groupBy("unit").transformWithStateInPandas(statefulProcessor=ProgressProcessor(), outputStructType=progress.PROGRESS, outputMode="update", timeMode="none")
