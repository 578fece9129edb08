"""Sequential recurrences as associative scans, so a long series is worked on by many tasks.

A row's step is q -> min(c, m q + d) with m >= 0 (c infinite: affine). Such steps compose into one of
their own kind, so a series is cut into time blocks: every block is reduced to one step, blocks' steps
are run through in order (one row a block), and each block is then run with its true start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.windows import Series
from chronoweave.runtime import ensure_shipped

#: Width of a block: 30 days in microseconds.
BLOCK_US = 30 * 86_400_000_000


Parts = Iterator[pa.RecordBatch]


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def _reduce(batches: Parts) -> Parts:
    """One step for each run of rows of one block."""
    run, names = None, ["_k", "_b", "_s", "M", "D", "C"]

    def made(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        done = []
        for g, k, b, s, m, d, c in zip(*_columns(batch, "_g", "_k", "_b", "_s", "_m", "_d", "_c"), strict=True):
            if run is None or run[0] != g:
                if run:
                    done.append(run[1:])
                run = [g, k, b, s, 1.0, 0.0, inf]
            # c' = min(c, m c' + d), and m' q + d' likewise
            run[6] = min(c, (m * run[6] if run[6] < inf else inf if m > 0 else 0.0) + d)
            run[4], run[5] = m * run[4], m * run[5] + d
        yield made(done)
    if run:
        yield made([run[1:]])


def _carry(batches: Parts) -> Parts:
    """The state before each block, of rows sorted by series and block."""
    key = q = None
    for batch in batches:
        before = []
        for k, s, M, D, C in zip(*_columns(batch, "_k", "_s", "M", "D", "C"), strict=True):
            if k != key:
                key, q = k, s
            before.append(q)
            q = min(C, M * q + D)
        yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_b"), pa.array(before, pa.float64())], names=["_k", "_b", "_q"])


def _apply(columns: list[str], out: str) -> Callable[[Parts], Parts]:
    def fn(batches: Parts) -> Parts:
        run = q = None
        for batch in batches:
            states = []
            for g, start, m, d, c in zip(*_columns(batch, "_g", "_q", "_m", "_d", "_c"), strict=True):
                if g != run:
                    run, q = g, start
                q = min(c, m * q + d)
                states.append(q)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(states, pa.float64())], names=[*columns, out])

    return fn


def scan(df: DataFrame, s: Series, m: Column, d: Column, c: Column | None = None, start: Column | None = None, out: str = "q", reverse: bool = False, block_us: int = BLOCK_US) -> DataFrame:
    """``df`` with ``out``: the state after each row's step. The state before the first row is ``start``
    there (0 if None). Rows with a null time or step are not supported."""
    ensure_shipped(df.sparkSession)
    block = F.floor(F.col(s.t) / block_us)
    limit = F.lit(inf) if c is None else c
    given = {"_m": m, "_d": d, "_c": limit, "_s": F.lit(0.0) if start is None else start}
    rows = df.withColumns({k: v.cast("double") for k, v in given.items()} | {"_b": block, "_k": F.xxhash64(*s.by), "_g": F.xxhash64(*s.by, block)})
    order = [F.desc(x) if reverse else F.asc(x) for x in (s.t, s.seq)]
    dealt = lambda x: x.repartition("_g").sortWithinPartitions("_g", *order)
    steps = dealt(rows.select(s.t, s.seq, "_g", "_k", "_b", "_s", "_m", "_d", "_c")).mapInArrow(_reduce, "_k long, _b long, _s double, M double, D double, C double")
    starts = steps.repartition("_k").sortWithinPartitions("_k", F.desc("_b") if reverse else F.asc("_b")).mapInArrow(_carry, "_k long, _b long, _q double")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"
    return dealt(rows.join(starts, ["_k", "_b"])).mapInArrow(_apply(df.columns, out), schema)


def ema(df: DataFrame, s: Series, value: str, alpha: float, out: str = "ema", reverse: bool = False) -> DataFrame:
    """q = (1 - alpha) q + alpha x, from the first row's own value."""
    return scan(df, s, F.lit(1 - alpha), F.col(value) * alpha, start=F.col(value), out=out, reverse=reverse)


def ema_both(df: DataFrame, s: Series, value: str, alpha: float, out: str = "ema") -> DataFrame:
    """Forward, then backward over the result."""
    return ema(ema(df, s, value, alpha, "_forward"), s, "_forward", alpha, out, reverse=True).drop("_forward")


def envelope(df: DataFrame, s: Series, value: str, alpha: float, out: str = "envelope") -> DataFrame:
    """q = min(x, alpha x + (1 - alpha) q), backward, then forward over the result."""
    def one(rows: DataFrame, x: str, to: str, reverse: bool) -> DataFrame:
        return scan(rows, s, F.lit(1 - alpha), F.col(x) * alpha, F.col(x), F.col(x), to, reverse)

    return one(one(df, value, "_back", True), "_back", out, False).drop("_back")


def per_series(df: DataFrame, s: Series, fn: Callable[[pd.DataFrame], dict[str, np.ndarray]], outs: dict[str, str]) -> DataFrame:
    """For strictly sequential algorithms: one call for each series, in time order.

    ``outs`` maps new columns to types. A series must fit a task; those that a window or a
    scan can express should be written as one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    columns = list(df.columns)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([s.t, s.seq]).reset_index(drop=True)
        for name, values in fn(pdf).items():
            pdf[name] = values
        return pdf[[*columns, *outs]]

    ensure_shipped(df.sparkSession)
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in columns), *(f"`{n}` {k}" for n, k in outs.items())])
    return df.groupBy(*s.by).applyInPandas(apply, schema)
