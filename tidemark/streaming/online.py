"""The window and session operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding(events: DataFrame, keys: list[str], ts: str, value: str, window: str = "5 seconds", step: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """``keys, start, end, n, total`` of sliding windows, each emitted once the watermark has passed it."""
    timed = events.withWatermark(ts, late)
    grouped = timed.groupBy(*keys, F.window(ts, window, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling(events: DataFrame, keys: list[str], ts: str, value: str, window: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    return sliding(events, keys, ts, value, window, window, late)


def close_gaps(intervals: DataFrame, keys: list[str], collar_micros: int, late: str = "5 seconds") -> DataFrame:
    """Intervals of timestamps (``start, end``) merged where the gap is under the collar.

    A session window lasts from each start to its end plus the collar.  Sessions merge at
    equality too, which a strict collar doesn't, so a microsecond is taken off.  A window
    of no length stands for an interval shorter than that.
    """
    length = (F.unix_micros("end") - F.unix_micros("start") + collar_micros - 1).cast("bigint")
    gap = F.concat(F.greatest(length, F.lit(1)).cast("string"), F.lit(" microseconds"))
    timed = intervals.withWatermark("start", late)
    merged = timed.groupBy(*keys, F.session_window("start", gap).alias("w")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(*keys, "start", "end")


def active_runs(events: DataFrame, key: str, ts: str, score: str, onset: float, offset: float, late: str = "5 seconds") -> DataFrame:
    """``key, start, end`` of the runs of a hysteresis over each key's scores.

    Rows wait in the state of their key until the watermark has passed them and are
    then taken in the order of time, so that the result depends neither on the borders
    of micro-batches nor on the order of rows within the watermark.  A run is emitted
    once its end has been passed; one that is still open is not.  Rows behind the
    watermark, and those without a time, are left out.
    """
    kinds = dict(events.dtypes)

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, since, times, scores = state.get if state.exists else (False, -1, [], [])
        rows = list(zip(times, scores))
        if not state.hasTimedOut:
            for part in parts:
                rows += zip(part["__ts"].to_numpy("datetime64[us]").astype("int64").tolist(), part["__s"].tolist())
        rows.sort()
        passed, out, waiting = state.getCurrentWatermarkMs() * 1000, [], []
        for t, x in rows:
            if t > passed:
                waiting.append((t, x))
            elif on and x < offset:
                out.append((since, t))
                on = False
            elif not on and x > onset:
                on, since = True, t
        if on or waiting:
            state.update((on, since, [t for t, _ in waiting], [x for _, x in waiting]))
            if waiting:
                state.setTimeoutTimestamp(waiting[0][0] // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({key: [name[0]] * len(out), "start": pd.to_datetime([a for a, _ in out], unit="us"), "end": pd.to_datetime([b for _, b in out], unit="us")})

    timed = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(key, F.col(ts).alias("__ts"), F.col(score).cast("double").alias("__s"))
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, start timestamp, end timestamp", "on boolean, since bigint, times array<bigint>, scores array<double>", "append", GroupStateTimeout.EventTimeTimeout)
