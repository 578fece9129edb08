"""3x3 matrices as nine double columns, row by row, in generated code."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions.quaternion import Quat

Vector = tuple[Column, Column, Column]


@dataclass(frozen=True)
class Matrix:
    m: tuple[Column, ...]

    def __matmul__(self, o: Matrix) -> Matrix:
        return Matrix(tuple(sum((self.m[3 * i + k] * o.m[3 * k + j] for k in range(1, 3)), self.m[3 * i] * o.m[j]) for i in range(3) for j in range(3)))

    def __call__(self, v: Vector) -> Vector:
        return tuple(self.m[3 * i] * v[0] + self.m[3 * i + 1] * v[1] + self.m[3 * i + 2] * v[2] for i in range(3))

    @property
    def transposed(self) -> Matrix:
        return Matrix(tuple(self.m[3 * j + i] for i in range(3) for j in range(3)))

    def inverse(self) -> Matrix:
        """By cofactors; null where the matrix is singular."""
        a, b, c, d, e, f, g, h, i = self.m
        cofactors = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
        det = a * cofactors[0] + b * cofactors[3] + c * cofactors[6]
        return Matrix(tuple(F.when(det != 0, x / det) for x in cofactors))

    def rotation_vector(self, near: Vector | None = None) -> Vector:
        """Axis times angle of a rotation, for angles below half a turn; with ``near`` the one of all vectors
        that give this rotation which is nearest to it, whatever the angle."""
        twice = tuple(self.m[a] - self.m[b] for a, b in ((7, 5), (2, 6), (3, 1)))
        sine = F.sqrt(twice[0] * twice[0] + twice[1] * twice[1] + twice[2] * twice[2])
        trace = self.m[0] + self.m[4] + self.m[8]
        angle = F.atan2(sine, trace - 1)
        if near is None:
            scale = F.when(sine > 2e-9, angle / sine).otherwise(0.5)
            return tuple(c * scale for c in twice)
        length = F.sqrt(near[0] * near[0] + near[1] * near[1] + near[2] * near[2])
        # half turns have their axis in the symmetric part's largest column, whole turns any axis
        m = self.m
        columns = ((m[0] + 1, m[3], m[6]), (m[1], m[4] + 1, m[7]), (m[2], m[5], m[8] + 1))
        largest = [F.when((m[0] >= m[4]) & (m[0] >= m[8]), a).when(m[4] >= m[8], b).otherwise(c) for a, b, c in zip(*columns, strict=True)]
        size = F.sqrt(largest[0] * largest[0] + largest[1] * largest[1] + largest[2] * largest[2])
        axis = tuple(F.when(sine > 2e-9, c / sine).when(trace < 1, x / size).when(length > 0, v / length).otherwise(0.0) for c, x, v in zip(twice, largest, near, strict=True))
        along = near[0] * axis[0] + near[1] * axis[1] + near[2] * axis[2]
        whole = angle + 2 * math.pi * F.rint((along - angle) / (2 * math.pi))
        return tuple(a * whole for a in axis)


def from_quat(q: Quat) -> Matrix:
    w, x, y, z = q.parts
    return Matrix((1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)))


def euler_zyx(yaw: Column, pitch: Column, roll: Column) -> Matrix:
    """Turns about z, then the new y, then the new x; angles in degrees."""
    cy, sy, cp, sp, cr, sr = (f(F.radians(a)) for a in (yaw, pitch, roll) for f in (F.cos, F.sin))
    return Matrix((cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr))


def camera(fx: Column, fy: Column, cx: Column, cy: Column) -> Matrix:
    """An intrinsic matrix."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return Matrix((fx, zero, cx, zero, fy, cy, zero, zero, one))
