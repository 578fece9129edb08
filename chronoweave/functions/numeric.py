"""Small numeric helpers as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def jacobian(f: Callable[[Column, Column], Column], x: Column, y: Column, step: float) -> tuple[Column, Column]:
    """Central differences of f in x and y."""
    return (f(x + step, y) - f(x - step, y)) / (2 * step), (f(x, y + step) - f(x, y - step)) / (2 * step)


def zoomed(window: Column, fovs: Column, moving: Column) -> Column:
    """Frames' zoom (arrays) by the window's length: below -0.9 the least for all, above 0.0001 the
    ``moving`` one, else 1."""
    return F.when(window < -0.9, F.transform(fovs, lambda _: F.array_min(fovs))).when(window > 0.0001, moving).otherwise(F.transform(fovs, lambda _: F.lit(1.0)))


def densified(xs: Column, ys: Column, steps: int) -> Column:
    """Points on the sides of a closed polygon (arrays of its corners): ``steps`` to a side, corners first."""
    n = F.size(xs)
    at = F.sequence(F.lit(0), n * steps - 1)

    def point(k: Column) -> Column:
        i, share = F.floor(k / steps).cast("int"), (k % steps) / steps
        j = ((i + 1) % n).cast("int")
        return F.struct((F.get(xs, i) + (F.get(xs, j) - F.get(xs, i)) * share).alias("x"), (F.get(ys, i) + (F.get(ys, j) - F.get(ys, i)) * share).alias("y"))

    return F.transform(at, point)
