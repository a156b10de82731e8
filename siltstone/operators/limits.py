"""Sequential folds for each key: request windows, byte quotas, token buckets, upload concurrency.

Keys are dealt over tasks and sorted there; rows stream through, so a key of any length needs the state of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Requests:
    """A window opens at the first request after the last one ended (strictly); denials don't count."""

    def __init__(self, most: int, window_ms: int = 60_000):
        self.most, self.window = most, window_ms

    def start(self):
        return None

    def step(self, state, at: int, n: int):
        if state is None or state[0] < at:
            state = (at + self.window, 0)
        if state[1] < self.most:
            return (state[0], state[1] + 1), True
        return state, False


class Bytes(Requests):
    """Bytes in a window; its first request passes whatever its size."""

    def step(self, state, at, n):
        if state is None or state[0] < at:
            return (at + self.window, n), True
        if state[1] + n <= self.most:
            return (state[0], state[1] + n), True
        return state, False


class TokenBucket:
    """Departure in ms: a bucket of twice the rate, full at first. None: larger than the bucket, never leaves."""

    def __init__(self, rate: float):
        self.rate = rate

    def start(self):
        return None

    def step(self, state, at, n):
        if self.rate <= 0 or n <= 0:
            return state, at
        cap = 2 * self.rate
        tokens, last = state or (cap, at)
        if n > cap:
            return state, None
        at = max(at, last)
        tokens = min(cap, tokens + (at - last) * self.rate / 1000)
        if tokens < n:
            wait = (n - tokens) * 1000 / self.rate
            wait = int(wait) + (wait > int(wait))
            tokens, at = min(cap, tokens + wait * self.rate / 1000), at + wait
        return (tokens - n, at), at


class Concurrency:
    """Uploads at once: one less on 429 or 503, one more after five quick answers; a slow one starts anew."""

    def __init__(self, cap: int, quick_ms: int = 400):
        self.cap, self.quick = cap, quick_ms

    def start(self):
        return (self.cap, 0)

    def step(self, state, at, n):
        """``at`` is the latency in ms, ``n`` the status."""
        level, streak = state or (self.cap, 0)
        if n in (429, 503):
            level, streak = max(1, level - 1), 0
        elif at < self.quick:
            streak += 1
            if streak >= 5:
                level, streak = min(self.cap, level + 1), 0
        else:
            streak = 0
        return (level, streak), level


def fold(df: DataFrame, key: str, order: list[str], at: str, amount: str, make: Callable[[], object], out: str, kind: str) -> DataFrame:
    """Adds a column with each row's outcome of ``make()``'s steps over its key's rows in order."""
    df = df.repartition(key).sortWithinPartitions(key, *order)
    names = df.columns
    k, a, n = names.index(key), names.index(at), names.index(amount)
    arrow = pa.bool_() if kind == "boolean" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, state, now = make(), None, object()
        for batch in batches:
            got = []
            for own, t, m in zip(batch.column(k).to_pylist(), batch.column(a).to_pylist(), batch.column(n).to_pylist(), strict=True):
                if own != now:
                    now, state = own, f.start()
                state, x = f.step(state, t, m)
                got.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {out} {kind}")


def by_time(df: DataFrame, ts: str, name: str = "at_ms") -> DataFrame:
    return df.withColumn(name, F.unix_millis(ts))
