"""Lens distortion models as Column expressions.

Forward forms are closed; inverses run a fixed number of unrolled steps as a fold over a
sequence, so a plan's size doesn't grow with the steps, and give null where they
don't converge. Coefficients are plain floats; points are in normalised coordinates, or
pixels for the digital lenses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    """c0 + c1 x + c2 x^2 ..."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + c
    return out


def _newton(target: Column, start: Column, f: Callable[[Column], Column], slope: Callable[[Column], Column], eps: float, steps: int = 10, clamp: float | None = None) -> tuple[Column, Column]:
    """(root, converged) of f(t) = target; stops moving once a step is below ``eps``."""

    def step(s: Column, _: Column) -> Column:
        move = (f(s["t"]) - target) / slope(s["t"])
        if clamp:
            move = F.greatest(F.least(move, F.lit(clamp)), F.lit(-clamp))
        done = s["done"] | (F.abs(move) < eps)
        return F.struct(F.when(s["done"], s["t"]).otherwise(s["t"] - move).alias("t"), done.alias("done"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(start.cast("double").alias("t"), F.lit(False).alias("done")), step)
    return found["t"], found["done"]


@dataclass(frozen=True)
class Radial:
    """A model that scales a point by a function of its radius (or angle, with ``angular``).

    ``powers``: (power, coefficient) of the distorted radius as a polynomial."""

    powers: tuple[tuple[int, float], ...]
    angular: bool = False
    scale: tuple[float, float] = (1.0, 1.0)

    def _value(self, t: Column) -> Column:
        top = max(p for p, _ in self.powers)
        by = dict(self.powers)
        return _poly(t, tuple(by.get(p, 0.0) for p in range(top + 1)))

    def _slope(self, t: Column) -> Column:
        top = max(p for p, _ in self.powers)
        by = dict(self.powers)
        return _poly(t, tuple((p + 1) * by.get(p + 1, 0.0) for p in range(top)))

    def distort(self, x: Column, y: Column) -> Point:
        r = F.sqrt(x * x + y * y)
        t = F.atan(r) if self.angular else r
        k = F.when(r == 0, 1.0).otherwise(self._value(t) / F.when(r == 0, 1.0).otherwise(r))
        return x * k * self.scale[0], y * k * self.scale[1]

    def undistort(self, x: Column, y: Column) -> Point:
        x, y = x / self.scale[0], y / self.scale[1]
        r = F.sqrt(x * x + y * y)
        safe = F.when(r == 0, 1.0).otherwise(r)
        if self.angular:
            t, ok = _newton(r, F.lit(0.0), self._value, self._slope, 1e-6, clamp=0.9)
            k = F.when(r <= 1e-6, 0.0).when(ok & (t >= 0), F.tan(t) / safe)
        else:
            t, ok = _newton(r, r, self._value, self._slope, 1e-9, steps=10)
            k = F.when((r > 0) & ok & (t >= 0), t / safe)
        return x * k, y * k

    def limit(self) -> float | None:
        """The tangent of the angle up to which the model grows, or None if it always does."""
        import math

        low, high = 0.0, math.pi / 2
        while high - low > 1e-4:
            mid = (low + high) / 2
            low, high = (mid, high) if sum(p * c * mid ** (p - 1) for p, c in self.powers) > 0 else (low, mid)
        at = (low + high) / 2
        return math.tan(at) if abs(at - math.pi / 2) > 1e-3 else None


def fisheye(k: tuple[float, float, float, float]) -> Radial:
    """Kannala-Brandt: theta (1 + k1 theta^2 + ... + k4 theta^8)."""
    return Radial(((1, 1.0), *((3 + 2 * i, c) for i, c in enumerate(k))), angular=True)


def poly3(k1: float) -> Radial:
    return Radial(((1, 1.0), (3, k1)))


def poly5(k1: float, k2: float) -> Radial:
    return Radial(((1, 1.0), (3, k1), (5, k2)))


def ptlens(a: float, b: float, c: float) -> Radial:
    return Radial(((1, 1.0), (2, c), (3, b), (4, a)))


def sony(k: tuple[float, ...], scale: tuple[float, float] = (1.0, 1.0)) -> Radial:
    """Six coefficients of theta to theta^6, then a scale of both axes."""
    return Radial(tuple((i + 1, c) for i, c in enumerate(k)), angular=True, scale=scale)


def _fixed_point(forward: Callable[[Column, Column], Point], x: Column, y: Column, steps: int, eps: float = 1e-6) -> Point:
    """Move by the forward form's error until it is below ``eps``."""

    def step(s: Column, _: Column) -> Column:
        fx, fy = forward(s["x"], s["y"])
        dx, dy = fx - x, fy - y
        done = s["done"] | (F.abs(dx) < eps) & (F.abs(dy) < eps)
        return F.struct(F.when(done, s["x"]).otherwise(s["x"] - dx).alias("x"), F.when(done, s["y"]).otherwise(s["y"] - dy).alias("y"), done.alias("done"))

    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return found["x"], found["y"]


@dataclass(frozen=True)
class BrownConrady:
    """Rational radial (k1..k6), tangential (p1, p2) and thin-prism (s1..s4) terms."""

    k: tuple[float, float, float, float, float, float]
    p: tuple[float, float]
    s: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    def _parts(self, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
        k, (p1, p2), s = self.k, self.p, self.s
        r2 = x * x + y * y
        ratio = _poly(r2, (1.0, *k[:3])), _poly(r2, (1.0, *k[3:]))
        dx = 2 * p1 * x * y + p2 * (r2 + 2 * x * x) + s[0] * r2 + s[1] * r2 * r2
        dy = p1 * (r2 + 2 * y * y) + 2 * p2 * x * y + s[2] * r2 + s[3] * r2 * r2
        return ratio[0], ratio[1], dx, dy

    def distort(self, x: Column, y: Column) -> Point:
        over, under, dx, dy = self._parts(x, y)
        return x * over / under + dx, y * over / under + dy

    def undistort(self, x: Column, y: Column, steps: int = 20) -> Point:
        def step(s: Column, _: Column) -> Column:
            over, under, dx, dy = self._parts(s["x"], s["y"])
            inverse = under / over
            bad = s["bad"] | (inverse < 0)
            return F.struct(((x - dx) * inverse).alias("x"), ((y - dy) * inverse).alias("y"), bad.alias("bad"))

        start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(False).alias("bad"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
        return F.when(~found["bad"], found["x"]), F.when(~found["bad"], found["y"])


@dataclass(frozen=True)
class UnifiedCamera:
    """Projection through a shifted sphere (xi), then radial and tangential terms."""

    k: tuple[float, float, float]
    p: tuple[float, float]
    xi: float

    def distort(self, x: Column, y: Column) -> Point:
        length = F.sqrt(x * x + y * y + 1.0)
        down = 1.0 / length + self.xi
        x, y = x / length / down, y / length / down
        r2, (p1, p2) = x * x + y * y, self.p
        radial = _poly(r2, (1.0, *self.k))
        return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + 2 * p2 * x * y + p1 * (r2 + 2 * y * y)

    def undistort(self, x: Column, y: Column) -> Point:
        return _fixed_point(self.distort, x, y, 200)


#: Polynomials of the digital lenses on [-0.5, 0.5].
SUPERVIEW_X = (1.2100393, -1.2758402, 1.7751845)
SUPERVIEW_Y = ((0.9364505, 0.4465308, -0.7683315), (-0.3574087, 1.1584653), (0.3529348,))
HYPERVIEW_X = (1.5805143, -8.1668825, 74.5198746, -451.5002441, 1551.2922363, -2735.5422363, 1923.1572266)
HYPERVIEW_XY = -0.1086027
HYPERVIEW_Y = ((1.0238225, -0.1025671), (-0.263993,), (0.2979266,))


def superview(x: Column, y: Column) -> Point:
    x2, y2 = x * x, y * y
    return x * _poly(x2, SUPERVIEW_X), y * sum((_poly(y2, c) * (x2 ** i if i else 1.0) for i, c in enumerate(SUPERVIEW_Y)), F.lit(0.0))


def hyperview(x: Column, y: Column) -> Point:
    x2, y2 = x * x, y * y
    return x * (_poly(x2, HYPERVIEW_X) + y2 * HYPERVIEW_XY), y * sum((_poly(y2, c) * (x2 ** i if i else 1.0) for i, c in enumerate(HYPERVIEW_Y)), F.lit(0.0))


def superview6(x: Column, y: Column) -> Point:
    x = x * (1 - 0.48 * F.abs(x))
    return x * 0.943396 * (1 + 0.157895 * F.abs(x)), y * 0.943396 * (1 + 0.06 * F.abs(y * 2))


@dataclass(frozen=True)
class DigitalLens:
    """A polynomial view whose forward form undistorts pixels of a width and height."""

    view: Callable[[Column, Column], Point]
    width: float
    height: float
    aspect: float = 1.0
    bound: float | None = None

    def undistort(self, x: Column, y: Column) -> Point:
        u, v = self.view(x / self.width - 0.5, y / self.height - 0.5)
        return (u / self.aspect + 0.5) * self.width, (v + 0.5) * self.height

    def distort(self, x: Column, y: Column) -> Point:
        u, v = _fixed_point(self.view, (x / self.width - 0.5) * self.aspect, y / self.height - 0.5, 12)
        return (u + 0.5) * self.width, (v + 0.5) * self.height


@dataclass(frozen=True)
class Stretch:
    """Each axis by its own factor; a zero factor can't be undone."""

    sx: float
    sy: float

    def distort(self, x: Column, y: Column) -> Point:
        return x * self.sx, y * self.sy

    def undistort(self, x: Column, y: Column) -> Point:
        if self.sx == 0 or self.sy == 0:
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        return x / self.sx, y / self.sy
