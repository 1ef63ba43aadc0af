"""Keyed headway state on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from railtempo.functions.scalar import SECOND

STATE = "seen array<bigint>, arrived array<bigint>"


def stream_headway(positions: DataFrame, horizon_minutes: int = 30, watermark: str | None = "30 minutes",
                   out: str = "headway_seconds") -> DataFrame:
    """Headway in processing order per station and direction, with state across batches.

    The state of a key is the list of rows processed within the horizon that no later row outdoes (a later report with a
    later arrival always wins), so it stays short however busy the key is. It expires by event time. Within a batch rows
    count in (timestamp, id) order; ``timestamp`` must be of type timestamp. A key's share of one micro-batch is handled
    by one task: bound the batch at the source. Pass ``watermark=None`` where the stream already has one.
    """
    horizon = horizon_minutes * 60 * SECOND
    payload = [c for c in positions.columns if c != out]
    source = positions.select(*payload)
    if watermark:
        source = source.withWatermark("timestamp", watermark)
    schema = T.StructType(source.schema.fields + [T.StructField(out, T.IntegerType())])

    def to_micros(s: pd.Series) -> np.ndarray:
        return s.astype("datetime64[us]").astype("int64").to_numpy()

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, arrived = (list(v) for v in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["timestamp", "id"], kind="stable")
        at = to_micros(rows["timestamp"])
        known = rows["arrival_time"].notna().to_numpy()
        arrival = np.where(known, to_micros(rows["arrival_time"].fillna(pd.Timestamp(0))), 0)
        headway: list[int | None] = []
        for now, here, has in zip(at.tolist(), arrival.tolist(), known.tolist()):
            while seen and seen[0] <= now - horizon:
                seen.pop(0)
                arrived.pop(0)
            gap = None
            if has:
                # kept rows have falling arrivals, so the newest one inside the horizon is found from the end
                for j in range(len(arrived) - 1, -1, -1):
                    if here - arrived[j] < horizon:
                        gap = int((here - arrived[j]) / SECOND)
                        break
                while arrived and arrived[-1] <= here:
                    seen.pop()
                    arrived.pop()
                seen.append(now)
                arrived.append(here)
            headway.append(gap)
        if seen:
            state.update((seen, arrived))
            due = max(seen[-1] + horizon, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1
            state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()
        yield rows.assign(**{out: pd.array(headway, dtype="Int32")})[[*payload, out]]

    return source.groupBy("current_station", "direction").applyInPandasWithState(
        follow, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
