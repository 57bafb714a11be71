"""Scaling, turning and moving of points, as columns."""

from __future__ import annotations

from .scalars import Vector, cross, plus, times, vector

Triple = tuple[float, float, float]
Quaternion = tuple[float, float, float, float]


def rotate(p: Vector, q: Quaternion) -> Vector:
    """p turned by a unit quaternion (x, y, z, w)."""
    axis = vector(*q[:3])
    t = times(cross(axis, p), 2.0)
    return plus(plus(p, times(t, q[3])), cross(axis, t))


def transform(p: Vector, move: Triple = (0.0, 0.0, 0.0), turn: Quaternion = (0.0, 0.0, 0.0, 1.0), scale: Triple = (1.0, 1.0, 1.0)) -> Vector:
    """Scaled, then turned, then moved."""
    return plus(rotate(tuple(x * s for x, s in zip(p, scale)), turn), vector(*move))


def direction(v: Vector, turn: Quaternion = (0.0, 0.0, 0.0, 1.0), scale: Triple = (1.0, 1.0, 1.0)) -> Vector:
    """transform without the move."""
    return rotate(tuple(x * s for x, s in zip(v, scale)), turn)


def inverse(p: Vector, move: Triple, turn: Quaternion, scale: Triple) -> Vector:
    """What transform takes to p."""
    back = rotate(tuple(x - m for x, m in zip(p, move)), (-turn[0], -turn[1], -turn[2], turn[3]))
    return tuple(x / s for x, s in zip(back, scale))
