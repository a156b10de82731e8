"""Structured Streaming forms of the folds: limits, frame reassembly, and the event queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.operators.codecs import FrameParser


class _Limiter(StatefulProcessor):
    def __init__(self, step: Callable, ttl_ms: int | None):
        self.step, self.ttl_ms = step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "expires long, used long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        for part in [pd.concat(list(rows)).sort_values(["at_ms", "request_id"])]:
            got = []
            for at, n in zip(part["at_ms"].tolist(), part["bytes"].tolist(), strict=True):
                state, ok = self.step(state, at, n)
                got.append(ok)
            yield pd.DataFrame({"user_id": part["user_id"], "request_id": part["request_id"], "allowed": got})
        if state is not None:
            self.state.update(state)

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, limit, ttl_ms: int | None = None) -> DataFrame:
    """``requests(user_id, request_id, at_ms, bytes)`` -> user_id, request_id, allowed, by a limit of ``limits``.

    ``ttl_ms``: state of users that are idle for so long goes; it should exceed the limit's window.
    """
    kind = "user_id long, request_id long, allowed boolean"
    return requests.groupBy("user_id").transformWithStateInPandas(_Limiter(limit.step, ttl_ms), kind, "append", "None" if ttl_ms is None else "ProcessingTime")


class _Frames(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        parser = FrameParser(bytes(self.pending.get()[0]) if self.pending.exists() else b"")
        out = []
        part = pd.concat(list(rows)).sort_values("seq")
        for data in part["data"]:
            out += [(key[0], *f) for f in parser.push(bytes(data))]
        self.pending.update((parser.pending,))
        yield pd.DataFrame(out, columns=["connection", "kind", "hash", "payload"])

    def close(self) -> None:
        pass


def parse_frames(fragments: DataFrame) -> DataFrame:
    """``fragments(connection, seq, data)`` -> connection, kind, hash, payload of complete frames."""
    return fragments.groupBy("connection").transformWithStateInPandas(_Frames(), "connection string, kind int, hash string, payload binary", "append", "None")


def dispatch(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds", once: bool = False):
    """Feeds unprocessed events of a stream to ``handle(batch, id)``; returns the query."""
    live = events.where(F.col("processed_at").isNull() & (F.col("attempts") <= 5))
    w = live.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
