"""Structured Streaming counterparts of the forward-only operators.

Late rows are dropped by watermarks; state is bounded by it (windows, sessions) or by the
number of series (rate control, causal smoothing).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, t: str, by: list[str], value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(window start and end, by, n, total) of tumbling or sliding windows."""
    rows = events.withWatermark(t, late)
    return rows.groupBy(F.window(t, width, slide) if slide else F.window(t, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, t: str, by: list[str], gap: str, late: str) -> DataFrame:
    """(by, first, last, n) of sessions; rows exactly a gap apart are one session."""
    rows = events.withWatermark(t, late).groupBy(F.session_window(t, gap), *by)
    return rows.agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n")).drop("session_window")


def _in_order(parts: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """All of a series' rows of a batch: they come in several pieces, and shuffled blocks in any order."""
    return pd.concat(list(parts), ignore_index=True).sort_values(list(order), kind="stable")


def causal_ema(events: DataFrame, by: str, t: str, value: str, alpha: float, seq: str | None = None) -> DataFrame:
    """(by, t, ema): state is one number for each series; rows are taken in order of time (then of ``seq``)
    within a batch, so batches must not overlap in time, and a series' rows of one batch must fit a task."""
    kinds = dict(events.dtypes)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q = state.get[0] if state.exists else None
        pdf = _in_order(parts, t, *([seq] if seq else []))
        out = []
        for x in pdf[value]:
            q = x if q is None else (1 - alpha) * q + alpha * x
            out.append(q)
        yield pd.DataFrame({by: key[0], t: pdf[t].to_numpy(), "ema": out})
        if q is not None:
            state.update((q,))

    return events.groupBy(by).applyInPandasWithState(step, f"`{by}` {kinds[by]}, `{t}` {kinds[t]}, ema double", "q double", "append", GroupStateTimeout.NoTimeout)


def rate_control(events: DataFrame, by: str, t_us: str, speed: str, fps: float) -> DataFrame:
    """(by, t_us, copies): how often each row shows at an output rate; 0 drops it."""
    interval = round(1e6 / fps)
    kinds = dict(events.dtypes)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, ramp, done = state.get if state.exists else (0.0, 0.0, 0.0)
        pdf = _in_order(parts, t_us)
        out = []
        for at, s in zip(pdf[t_us], pdf[speed], strict=True):
            d = (at - before) / (s if s > 0 else 1.0)
            ramp, before, n = ramp + d, float(at), 0
            if ramp >= done + interval / 2:
                n = max(1, round(d / interval)) if d / interval >= 1.5 else 1
                done += interval * n
            out.append(n)
        yield pd.DataFrame({by: key[0], t_us: pdf[t_us].to_numpy(), "copies": out})
        state.update((before, ramp, done))

    return events.groupBy(by).applyInPandasWithState(step, f"`{by}` {kinds[by]}, `{t_us}` long, copies long", "before double, ramp double, done double", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is available into an in-memory table, for tests and small jobs."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
