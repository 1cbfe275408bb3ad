"""Structured Streaming forms of the time-series operators: sampling, aggregation, control thresholds.

The state of a window ends with the watermark, so it follows the keys and the lateness allowed, not the input.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_first(stream: DataFrame, key: str, ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """The first value of each hour per key."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), key).agg(F.min_by(value, ts).alias("first_value")).select(key, F.col("window.start").alias("hour"), "first_value")


def window_totals(stream: DataFrame, key: str, ts: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, sum and extremes per tumbling window and key."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")
    ).select(key, F.col("window.start").alias("begin"), "n", "total", "least", "most")


def control_changes(stream: DataFrame, key: str, ts: str, value: str, table: list[tuple[float, float]], late: str = "2 hours", idle: str = "7 days") -> DataFrame:
    """A table control per key: emits (key, ts, action) when the measured value's row of the table changes.

    table: (from value, action), ascending; under the first value its action holds too. Readings are taken in order of
    time, whatever batches they came in: a reading waits until the watermark has passed it, and one that comes later than
    that is dropped. State: the last action and the readings that wait. A key without readings for `idle` is forgotten, so the
    state follows the keys in use; its next reading counts as a change.
    """
    keep = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, "[]")
        held = json.loads(waiting)
        if not state.hasTimedOut:
            for rows in batches:
                known = rows[rows[value].notna() & rows[ts].notna()]
                held += list(zip(known[ts].astype("datetime64[us]").astype("int64").tolist(), known[value].tolist(), strict=True))
        passed = state.getCurrentWatermarkMs() * 1000
        out = []
        for at, measured in sorted(r for r in held if r[0] <= passed):
            action = next((a for v, a in reversed(table) if measured >= v), table[0][1])
            if action != last:
                out.append((keys[0], pd.Timestamp(at, unit="us"), action))
                last = action
        held = [r for r in held if r[0] > passed]
        if state.hasTimedOut and not held and not out:
            state.remove()
        else:
            state.update((last, json.dumps(held)))
            state.setTimeoutTimestamp(max(min(r[0] for r in held) // 1000, passed // 1000) + 1 if held else passed // 1000 + keep)
        yield pd.DataFrame(out, columns=[key, ts, "action"])

    kind = dict(stream.dtypes)
    rows = stream.select(key, ts, value).withWatermark(ts, late).groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} {kind[key]}, {ts} {kind[ts]}, action double", "action double, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
