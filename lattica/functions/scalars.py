"""Column helpers: vectors, interpolation, boxes and triangles, colours, annealing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def column(value: Column | str | float) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def vector(*parts: Column | str | float) -> Vector:
    return tuple(column(p) for p in parts)


def plus(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b))


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def times(a: Vector, s: Column | float) -> Vector:
    return tuple(x * s for x in a)


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Vector) -> Vector:
    """The vector over its length; null for a zero one."""
    return tuple(x / F.nullif(length(a), F.lit(0.0)) for x in a)


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def reflect(a: Vector, normal: Vector) -> Vector:
    return minus(a, times(normal, 2 * dot(normal, a)))


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    return a + (b - a) * t


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def fraction(x: Column) -> Column:
    return x - F.floor(x)


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def rsqrt(x: Column) -> Column:
    return 1 / F.sqrt(x)


def round_up_div(a: Column, b: int) -> Column:
    """a / b, rounded up."""
    return F.floor((a + (b - 1)) / b)


def triangle_normal(a: Vector, b: Vector, c: Vector) -> Vector:
    return normalize(cross(minus(b, a), minus(c, a)))


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    return 0.5 * length(cross(minus(b, a), minus(c, a)))


def box_meets(low_a: Vector, high_a: Vector, low_b: Vector, high_b: Vector) -> Column:
    out = F.lit(True)
    for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b):
        out = out & (la <= hb) & (lb <= ha)
    return out


def box_contains(low_a: Vector, high_a: Vector, low_b: Vector, high_b: Vector) -> Column:
    out = F.lit(True)
    for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b):
        out = out & (la <= lb) & (hb <= ha)
    return out


def box_volume(low: Vector, high: Vector) -> Column:
    out = F.lit(1.0)
    for l, h in zip(low, high):
        out = out * F.greatest(h - l, F.lit(0.0))
    return out


def box_centre(low: Vector, high: Vector) -> Vector:
    return tuple((l + h) / 2 for l, h in zip(low, high))


def push_inside(low: Vector, high: Vector, box_low: Vector, box_high: Vector) -> Vector:
    """How far to move a box along each axis so that it lies within another."""
    return tuple(F.greatest(bl - l, F.lit(0.0)) - F.greatest(h - bh, F.lit(0.0)) for l, h, bl, bh in zip(low, high, box_low, box_high))


def jet(t: Column) -> Vector:
    """Red, green and blue of the jet map for t from 0 to 1: ramps of width a quarter around 3/4, 1/2 and 1/4."""
    return tuple(clamp(1.5 - F.abs(4 * t - centre), 0.0, 1.0) for centre in (3, 2, 1))


def acceptance(score: Column, fresh: Column, temperature: Column) -> Column:
    """The probability of taking a fresh score: 1 if it is lower, else exp(-difference / temperature)."""
    return F.when(fresh < score, 1.0).when(temperature > 0, F.exp(-(fresh - score) / temperature)).otherwise(0.0)


def sphere_volume(r: Column) -> Column:
    return 4 / 3 * math.pi * r * r * r


def explode_text(text: Column, mark: str) -> Column:
    """The parts of a text between marks, empty ones left out."""
    return F.filter(F.split(text, "\\Q" + mark + "\\E"), lambda x: x != "")


def fill_in(template: str, *values: Column) -> Column:
    """A template with each % replaced in turn."""
    parts = template.split("%")
    out = [F.lit(parts[0])]
    for part, value in zip(parts[1:], values):
        out += [value.cast("string"), F.lit(part)]
    return F.concat(*out)


def random_sign(seed: int) -> Column:
    return F.when(F.rand(seed) < 0.5, -1).otherwise(1)


def log_normal(mean: float, deviation: float, seed: int) -> Column:
    return F.exp(mean + deviation * F.randn(seed))
