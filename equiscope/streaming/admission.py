"""ST1 — admission audit: allow an event unless ``limit`` *allowed* events of
the same key lie within the last ``window_s`` seconds (denials do not count).

The rule is sequential within a key, so each key's events are processed in
time order with a bounded state (at most ``limit`` timestamps):

* batch: ``repartition(key)`` + ``sortWithinPartitions(key, ts)`` +
  ``mapInPandas``; the per-key deque is carried across Arrow batches, so a
  task's memory is O(keys·limit) however many events a hot key has;
* stream: ``applyInPandasWithState`` with the same deque as group state and
  an event-time timeout that drops the state of idle keys.

Both share ``_admit`` so batch = stream by construction (tested).
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT_SCHEMA = "key long, event_id long, ts timestamp, allowed boolean, allowed_in_window int"


def _admit(ts_us, dq: deque, limit: int, window_us: int):
    """Decide one event; ``dq`` holds allowed timestamps (µs) of the window."""
    while dq and ts_us - dq[0] >= window_us:  # keep now - t < window
        dq.popleft()
    ok = len(dq) < limit
    if ok:
        dq.append(ts_us)
    return ok, len(dq)


def _to_us(s: pd.Series):
    return s.astype("datetime64[us]").astype("int64")


def admission_batch(events: DataFrame, key: str = "user_id", ts: str = "ts", eid: str = "event_id",
                    limit: int = 60, window_s: int = 60, partitions: int | None = None) -> DataFrame:
    window_us = window_s * 1_000_000
    # a timestamp_ntz column is kept as is (no session-time-zone dependence);
    # anything else is read as a timestamp
    ntz = events.schema[ts].dataType.simpleString() == "timestamp_ntz"
    df = events.select(F.col(key).cast("long").alias("key"), F.col(eid).cast("long").alias("event_id"),
                       F.col(ts).cast("timestamp_ntz" if ntz else "timestamp").alias("ts"))
    df = (df.repartition(partitions, "key") if partitions else df.repartition("key")) \
        .sortWithinPartitions("key", "ts", "event_id")

    def run(batches):
        state: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            us = _to_us(pdf["ts"]).to_numpy()
            keys = pdf["key"].to_numpy()
            allowed, counts = [], []
            for k, t in zip(keys, us):
                dq = state.setdefault(int(k), deque())
                ok, n = _admit(int(t), dq, limit, window_us)
                allowed.append(ok)
                counts.append(n)
            yield pdf.assign(allowed=allowed, allowed_in_window=pd.Series(counts, dtype="int32"))

    return df.mapInPandas(run, OUT_SCHEMA.replace("ts timestamp", "ts timestamp_ntz") if ntz else OUT_SCHEMA)


def admission_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", eid: str = "event_id",
                     limit: int = 60, window_s: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """Streaming twin; ``events`` is a streaming DataFrame."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    window_us = window_s * 1_000_000
    df = (events.select(F.col(key).cast("long").alias("key"), F.col(eid).cast("long").alias("event_id"),
                        F.col(ts).cast("timestamp").alias("ts"))
          .withWatermark("ts", watermark))

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        dq = deque(state.get[0]) if state.exists else deque()
        out = []
        for pdf in pdfs:
            out.append(pdf)
        pdf = pd.concat(out).sort_values(["ts", "event_id"])  # one micro-batch of one key
        us = _to_us(pdf["ts"]).to_numpy()
        allowed, counts = [], []
        for t in us:
            ok, n = _admit(int(t), dq, limit, window_us)
            allowed.append(ok)
            counts.append(n)
        state.update((list(dq),))
        if dq:
            wm = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(int(dq[-1] // 1000) + window_s * 1000, wm + 1))
        yield pdf.assign(allowed=allowed, allowed_in_window=pd.Series(counts, dtype="int32").values)

    return df.groupBy("key").applyInPandasWithState(
        fn, OUT_SCHEMA, "allowed array<long>", "append", GroupStateTimeout.EventTimeTimeout)
