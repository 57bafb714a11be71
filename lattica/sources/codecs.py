"""Bytes and texts of the file formats: volumes, TIFF slices, PNG, spheres, packed particles, meshes."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from ..volumes import KINDS

NUMBERS = {kind: number for number, (kind, _) in KINDS.items()}


def encode_volume(values: np.ndarray) -> bytes:
    """A .bin file of values (dz, dy, dx): type, dims and a zero byte, then x fastest."""
    kind = values.dtype.newbyteorder("<").str.replace("|", "<")
    dz, dy, dx = values.shape
    return struct.pack("<4i?", NUMBERS[kind], dx, dy, dz, False) + np.ascontiguousarray(values, kind).tobytes()


def decode_volume(data: bytes) -> tuple[str, tuple[int, int, int], bytes]:
    """(kind, (dx, dy, dz), values) of a .bin file."""
    number, dx, dy, dz, _ = struct.unpack_from("<4i?", data)
    if number not in KINDS or min(dx, dy, dz) <= 0:
        raise ValueError(f"no volume: type {number}, dims {dx}, {dy}, {dz}")
    kind, width = KINDS[number]
    values = data[17 : 17 + dx * dy * dz * width]
    if len(values) < dx * dy * dz * width:
        raise ValueError("the volume's values are cut off")
    return kind, (dx, dy, dz), values


def encode_tiff(plane: np.ndarray) -> bytes:
    """An uncompressed 8-bit gray TIFF of one strip."""
    height, width = plane.shape
    tags = [(256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, width * height)]
    entries = b"".join(struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", v, 0) if kind == 3 else struct.pack("<I", v)) for tag, kind, v in tags)
    pixels = np.ascontiguousarray(plane, np.uint8).tobytes()
    pixels += b"\0" * (len(pixels) % 2)
    return struct.pack("<2sHI", b"II", 42, 8 + len(pixels)) + pixels + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def decode_tiff(data: bytes) -> np.ndarray:
    """(height, width) of the first image of a baseline TIFF: 8-bit, one sample, uncompressed or PackBits strips."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (count,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple[int, ...]] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            width = struct.calcsize(code) * n
            place = at + 2 + 12 * k + 8 if width <= 4 else struct.unpack_from(order + "I", data, at + 2 + 12 * k + 8)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, place)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(258, 1) != 8 or one(277, 1) != 1 or one(339, 1) != 1:
        raise ValueError("only 8-bit unsigned TIFF files of one sample are read")
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279])]
    if one(259, 1) == 32773:
        strips = [unpack_bits(s) for s in strips]
    elif one(259, 1) != 1:
        raise ValueError("compressed TIFF files other than PackBits are not read")
    height, width = one(257, 0), one(256, 0)
    return np.frombuffer(b"".join(strips)[: width * height], np.uint8).reshape(height, width)


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def encode_png(plane: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    height, width = plane.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(plane, np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_spheres(text: str) -> list[tuple[float, float, float, float]]:
    """(x, y, z, r) of a .sph file: the number, then four figures for each."""
    figures = text.split()
    n = int(figures[0])
    values = list(map(float, figures[1 : 1 + 4 * n]))
    if len(values) < 4 * n:
        raise ValueError("spheres are missing")
    return [tuple(values[k : k + 4]) for k in range(0, 4 * n, 4)]


def encode_spheres(spheres: list[tuple[float, float, float, float]]) -> str:
    return "\n".join([str(len(spheres)), *(" ".join(map(repr, s)) for s in spheres)]) + "\n"


def frames(text: str) -> list[str]:
    """The frames of a .pos file, each beginning with its box."""
    starts = [m.start() for m in re.finditer(r"^boxMatrix\b", text, re.M)]
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def decode_frame(text: str, order: str = "xyzw") -> tuple[np.ndarray, dict[str, np.ndarray], list[tuple[str, np.ndarray, np.ndarray]]]:
    """(box, vertices by name, (name, position, quaternion (x, y, z, w)) of each instance) of a frame.

    Vertices are divided by the box, positions too and moved by a half. Shapes other than poly3d are
    left out with their instances. order: which component each of the file's four figures is.
    """
    box, shapes, instances = np.ones(3), {}, []
    for line in text.splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] == "eof":
            break
        if words[0] == "boxMatrix":
            box = np.array([float(w) for w in words[1:10]]).reshape(3, 3).diagonal().copy()
        elif words[0] == "def":
            body = line.split('"')[1].split() if '"' in line else words[2:]
            if body and body[0] == "poly3d":
                n = int(body[1])
                shapes[words[1]] = np.array([float(w) for w in body[2 : 2 + 3 * n]]).reshape(n, 3) / box
        elif words[0] in shapes and len(words) >= 9:
            figures = [float(w) for w in words[2:9]]
            q = dict(zip(order, figures[3:]))
            instances.append((words[0], np.array(figures[:3]) / box + 0.5, np.array([q[c] for c in "xyzw"])))
    return box, shapes, instances


def decode_mesh(text: str) -> tuple[np.ndarray, list[list[int]], list[tuple[int, int]], np.ndarray]:
    """(vertices, faces, edges, normals) of a particle mesh; an edge comes once, its smaller vertex first."""
    words: Iterator[str] = iter(text.split())
    vertices = np.array([[float(next(words)) for _ in range(3)] for _ in range(int(next(words)))])
    faces = [[int(next(words)) for _ in range(int(next(words)))] for _ in range(int(next(words)))]
    edges = sorted({tuple(sorted((f[k], f[(k + 1) % len(f)]))) for f in faces for k in range(len(f))})
    normals = np.array([np.cross(vertices[f[1]] - vertices[f[0]], vertices[f[2]] - vertices[f[0]]) for f in faces])
    return vertices, faces, edges, normals / np.maximum(np.linalg.norm(normals, axis=1, keepdims=True), 1e-300)


def encode_mesh(vertices: np.ndarray, faces: list[list[int]]) -> str:
    lines = [str(len(vertices)), *(" ".join(map(repr, map(float, v))) for v in vertices), str(len(faces)), *(" ".join(map(str, [len(f), *f])) for f in faces)]
    return "\n".join(lines) + "\n"
