"""Column algebra of 3-vectors held in three columns, and the geometry of triangles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    """The columns <prefix>x, <prefix>y, <prefix>z as doubles."""
    return tuple(F.col(prefix + c).cast("double") for c in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, fallback: tuple[float, float, float] = (0.0, 0.0, 1.0), least: float = 1e-12) -> Vec:
    """a / |a|, or the fallback where |a| is not above ``least``."""
    n = norm(a)
    return tuple(F.when(n > least, p / n).otherwise(float(f)) for p, f in zip(a, fallback))


def named(a: Vec, names: tuple[str, str, str] = ("nx", "ny", "nz")) -> list[Column]:
    return [p.alias(n) for p, n in zip(a, names)]


def triangle_cross() -> Vec:
    """(b - a) x (c - a) of rows with ax .. cz."""
    a = vec("a")
    return cross(sub(vec("b"), a), sub(vec("c"), a))


def solid_angle(p: Vec) -> Column:
    """Signed solid angle of a triangle (ax .. cz) seen from p; 0 where a corner is within 1e-12 of p."""
    a, b, c = (sub(vec(k), p) for k in "abc")
    la, lb, lc = norm(a), norm(b), norm(c)
    over = dot(a, cross(b, c))
    under = la * lb * lc + dot(a, b) * lc + dot(b, c) * la + dot(c, a) * lb
    return F.when((la > 1e-12) & (lb > 1e-12) & (lc > 1e-12), 2 * F.atan2(over, under)).otherwise(0.0)


def fibonacci_directions(n: int) -> list[tuple[float, float, float]]:
    """n directions spread over the sphere along a golden-angle spiral."""
    out = []
    for i in range(n):
        y = 1 - 2 * i / max(1, n - 1)
        r, t = math.sqrt(max(0.0, 1 - y * y)), math.pi * (3 - math.sqrt(5)) * i
        out.append((math.cos(t) * r, y, math.sin(t) * r))
    return out
