"""Natural cubic splines: through long series as two associative scans, and over small meshes in numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import scans
from chronoweave.operators.windows import Series

#: The elimination's factors run from 0 to 1 / _ROOT.
_ROOT = 2 + math.sqrt(3)


def natural(df: DataFrame, s: Series, value: str) -> DataFrame:
    """``df`` with ``b``, ``c`` and ``d``: behind each row the curve is value + b x + c x^2 + d x^3, x from 0 to 1 at the next
    row. Rows are evenly spaced knots; the last row of a series has null ``b`` and ``d``.

    Elimination's factor of row i depends on i alone, so both sweeps are affine recurrences. With every other row's sign turned
    their factors are positive, as ``scans`` asks for."""
    w = s.window()
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(s.whole()), "_up": F.lead(value).over(w), "_bend": F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)})
    inner = (F.col("_i") > 0) & (F.col("_i") < F.col("_n") - 1)
    # 1 / (4 - factor of the row before), in closed form
    factor = (1 - F.pow(F.lit(_ROOT), -2.0 * F.col("_i"))) / (1 - F.pow(F.lit(_ROOT), -2.0 * (F.col("_i") + 1))) / _ROOT
    rows = rows.withColumns({"_f": F.when(inner, factor).otherwise(0.0), "_sign": F.when(F.col("_i") % 2 == 0, 1.0).otherwise(-1.0)})
    down = scans.scan(rows, s, F.col("_f"), F.when(inner, F.col("_sign") * 3 * F.col("_bend") * F.col("_f")).otherwise(0.0), out="_y")
    back = scans.scan(down, s, F.col("_f"), F.col("_y"), out="_e", reverse=True)
    curved = back.withColumn("c", F.col("_sign") * F.col("_e") + F.lit(0.0))
    curved = curved.withColumn("_c", F.lead("c").over(w))
    return curved.withColumns({"b": F.col("_up") - F.col(value) - (F.col("_c") + 2 * F.col("c")) / 3, "d": (F.col("_c") - F.col("c")) / 3}).select(*df.columns, "b", "c", "d")


def knots(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural splines along the last axis of ``values`` (knots 0, 1, ..), each at its position ``at``; ends go on."""
    n = values.shape[-1]
    bend = np.zeros(values.shape)
    if n > 2:
        system = 4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1)
        bend[..., 1:-1] = np.linalg.solve(system, 3 * np.diff(values, 2)[..., None])[..., 0]
    k = np.clip(at.astype(int), 0, n - 2)
    x = at - k
    pick = lambda v, i: np.take_along_axis(v, i[..., None], -1)[..., 0]
    a, up, c, over = pick(values, k), pick(values, k + 1), pick(bend, k), pick(bend, k + 1)
    return a + (up - a - (over + 2 * c) / 3) * x + c * x**2 + (over - c) / 3 * x**3


def mesh(values: np.ndarray, x: float, y: float, width: float, height: float) -> float:
    """A mesh (rows by columns, 2 or more of each) over width x height, at (x, y): along the rows, then down the results."""
    v = np.asarray(values, float)
    along = knots(v, np.full(len(v), x / width * (v.shape[1] - 1)))
    return float(knots(along, np.array(y / height * (len(v) - 1))))


def mesh_at(values: Column, x: Column, y: Column, width: float, height: float) -> Column:
    """``mesh`` on columns: array<array<double>>, x, y; null for null."""

    def each(m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or np.isnan(p) or np.isnan(q) else mesh(np.stack(list(v)), p, q, width, height) for v, p, q in zip(m, a, b, strict=True)], dtype=float)

    return F.pandas_udf(each, "double")(values, x, y)
