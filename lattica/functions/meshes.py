"""Small meshes, such as particle templates, as arrays: vertices (n, 3) and faces as lists of vertex numbers."""

from __future__ import annotations

import numpy as np

from ..operators.sdf import rotation

Faces = list[list[int]]


def sphere_point(theta: float, phi: float, r: float = 1.0) -> np.ndarray:
    """Cartesian coordinates of an angle from the z axis and one around it."""
    return r * np.array([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)])


def normals(vertices: np.ndarray, faces: Faces) -> np.ndarray:
    """Unit normals of the faces by their first three vertices; zero for faces without area."""
    a, b, c = (vertices[[f[k] for f in faces]] for k in range(3))
    out = np.cross(b - a, c - a)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def bounds(vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return vertices.min(axis=0), vertices.max(axis=0)


def normalized(vertices: np.ndarray) -> np.ndarray:
    """Centred on the middle of the bounds, the longest side being 1."""
    low, high = bounds(vertices)
    return (vertices - (low + high) / 2) / max(1e-300, float((high - low).max()))


def transformed(vertices: np.ndarray, move=(0.0, 0.0, 0.0), turn=(0.0, 0.0, 0.0, 1.0), scale=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Scaled, then turned by a quaternion (x, y, z, w), then moved."""
    return (vertices * np.asarray(scale)) @ rotation(np.asarray(turn, float)).T + np.asarray(move)


def triangle_array(vertices: np.ndarray, faces: Faces) -> np.ndarray:
    """(m, 3, 3) corners; faces that are no triangles raise."""
    if any(len(f) != 3 for f in faces):
        raise ValueError("a face is no triangle")
    return vertices[np.array(faces, int).reshape(-1, 3)]


def flipped(faces: Faces) -> Faces:
    return [f[::-1] for f in faces]


def area(vertices: np.ndarray, faces: Faces) -> float:
    """The sum of the faces' areas, each cut into a fan."""
    total = 0.0
    for f in faces:
        p = vertices[f]
        total += 0.5 * np.linalg.norm(np.cross(p[1:-1] - p[0], p[2:] - p[0]), axis=1).sum()
    return float(total)
