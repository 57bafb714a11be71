"""Iso-surface area and meshes by marching cubes.

Lattice corner (i, j, k) of a volume has the mean of the eight voxels around it, clamped at the
border, and cell (i, j, k) spans the corners (i..i+1, j..j+1, k..k+1), those beyond the last
being clamped too. Area is measured in the unit cube: a cell has the extent 1 / dims along each
axis, so that surfaces of volumes with unequal dims are squashed; isotropic=True measures
voxels as cubes with the longest side of the volume as unit.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import numbered
from ..volumes import AXES, XYZ, Dims, per_batch, stacks
from . import segment

# Corners of a cell and the pairs of corners that its edges join, in the usual order.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
EDGES = ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7))
ISO = 0.5


def _faces() -> list[list[int]]:
    """Each face's corners in turn, counter-clockwise seen from outside."""
    out = []
    for axis in range(3):
        u, w = (axis + 1) % 3, (axis + 2) % 3
        for side in (0, 1):
            ring = [(0, 0), (1, 0), (1, 1), (0, 1)] if side else [(0, 0), (0, 1), (1, 1), (1, 0)]
            corners = []
            for cu, cw in ring:
                at = [0, 0, 0]
                at[axis], at[u], at[w] = side, cu, cw
                corners.append(CORNERS.index(tuple(at)))
            out.append(corners)
    return out


@functools.cache
def cases() -> list[list[tuple[int, int, int]]]:
    """For each of the 256 sets of corners under the level, triangles of edge numbers.

    Made from a rule: on each face the surface runs so that corners under the level are cut off
    singly where two lie opposite; the segments of all faces close to loops, and a loop is cut into
    a fan from the edge before its smallest one.
    """
    number = {frozenset(e): k for k, e in enumerate(EDGES)}
    out = []
    for case in range(256):
        under = [bool(case >> c & 1) for c in range(8)]
        after: dict[int, int] = {}
        for ring in _faces():
            # From the edge where the boundary of a run of corners under the level is left to where it is entered.
            for k in range(4):
                if under[ring[k]] and not under[ring[k - 1]]:
                    stop = k
                    while under[ring[(stop + 1) % 4]]:
                        stop += 1
                    enter = number[frozenset((ring[k - 1], ring[k]))]
                    leave = number[frozenset((ring[stop % 4], ring[(stop + 1) % 4]))]
                    after[enter] = leave
        triangles = []
        while after:
            start = min(after)
            loop, edge = [start], after.pop(start)
            while edge != start:
                loop.append(edge)
                edge = after.pop(edge)
            triangles += [(loop[-1], loop[k], loop[k + 1]) for k in range(len(loop) - 2)]
        out.append(triangles)
    return out


def case_table(spark: SparkSession) -> DataFrame:
    """(cubeindex, nverts, triangles): a row for each of the 256 cases."""
    rows = [(k, 3 * len(t), [list(x) for x in t]) for k, t in enumerate(cases())]
    return spark.createDataFrame(rows, "cubeindex int, nverts int, triangles array<array<int>>")


def corners(mask: DataFrame, dims: Dims) -> DataFrame:
    """(volume_id, x, y, z, f): the value at each lattice corner but the last of each axis, as a fraction of 255.

    The mean of eight voxels is three means of two, one window for each axis.
    """
    out = mask.select("volume_id", *XYZ, (F.col("v") / 255.0).alias("f"))
    for axis in AXES:
        line = Window.partitionBy("volume_id", *[a for a in AXES if a != axis]).orderBy(axis)
        out = out.withColumn("f", (F.coalesce(F.lag("f").over(line), F.col("f")) + F.col("f")) / 2)
    return out


def cells(mask: DataFrame, dims: Dims, iso: float = ISO) -> DataFrame:
    """(volume_id, x, y, z, f0 .. f7, cubeindex) of each cell.

    A corner beyond the last lies on the border, where all voxels around it are those of the last
    layer: it has the mean that the voxels, and not the corners, of that layer give.
    """
    names = ["v"]
    out = mask.select("volume_id", *XYZ, (F.col("v") / 255.0).alias("v"))
    for axis in AXES:
        line = Window.partitionBy("volume_id", *[a for a in AXES if a != axis]).orderBy(axis)
        made = {}
        for n in names:
            made[f"{n}0"] = (F.coalesce(F.lag(n).over(line), F.col(n)) + F.col(n)) / 2
            made[f"{n}1"] = (F.col(n) + F.coalesce(F.lead(n).over(line), F.col(n))) / 2
        out = out.select("volume_id", *XYZ, *[value.alias(name) for name, value in made.items()])
        names = list(made)
    at = ["v" + "".join(str(c) for c in corner) for corner in CORNERS]
    index = F.lit(0)
    for k, n in enumerate(at):
        index = index + F.when(F.col(n) < iso, 1 << k).otherwise(0)
    return out.select("volume_id", *XYZ, *[F.col(n).alias(f"f{k}") for k, n in enumerate(at)], index.cast("int").alias("cubeindex"))


def case_histogram(mask: DataFrame, dims: Dims, iso: float = ISO) -> DataFrame:
    return cells(mask, dims, iso).groupBy("volume_id", "cubeindex").agg(F.count("*").alias("n"))


def _scale(dims: Dims, isotropic: bool) -> tuple[float, float, float]:
    return tuple(1.0 / (max(dims) if isotropic else d) for d in dims)


def triangles(mask: DataFrame, dims: Dims, iso: float = ISO, isotropic: bool = False) -> DataFrame:
    """(volume_id, x, y, z, a, b, c): the surface's triangles, vertices as structs (x, y, z).

    Cells that the surface doesn't cross are filtered out before anything is joined.
    """
    active = cells(mask, dims, iso).where("cubeindex NOT IN (0, 255)")
    scale = _scale(dims, isotropic)
    made: dict[str, list] = {a: [] for a in AXES}
    for p, q in EDGES:
        f0, f1 = F.col(f"f{p}"), F.col(f"f{q}")
        t = F.when(f0 == f1, 0.0).otherwise((iso - f0) / F.nullif(f1 - f0, F.lit(0.0)))
        for k, a in enumerate(AXES):
            made[a].append((F.col(a) + CORNERS[p][k] + t * (CORNERS[q][k] - CORNERS[p][k])) * scale[k])
    joined = active.join(F.broadcast(case_table(mask.sparkSession)), "cubeindex")  # 256 rows
    out = joined.select("volume_id", *XYZ, *[F.array(*points).alias(f"p{a}") for a, points in made.items()], F.explode("triangles").alias("t"))
    corner = lambda k: F.struct(*[F.col(f"p{a}")[F.col("t")[k]].alias(a) for a in AXES])
    return out.select("volume_id", *XYZ, *[corner(k).alias(n) for k, n in enumerate("abc")])


def triangle_area():
    """Half the length of the cross product of the sides of a, b, c."""
    u = {a: F.col(f"b.{a}") - F.col(f"a.{a}") for a in AXES}
    w = {a: F.col(f"c.{a}") - F.col(f"a.{a}") for a in AXES}
    cross = [u["y"] * w["z"] - u["z"] * w["y"], u["z"] * w["x"] - u["x"] * w["z"], u["x"] * w["y"] - u["y"] * w["x"]]
    return 0.5 * F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])


def area(mask: DataFrame, dims: Dims, iso: float = ISO, isotropic: bool = False) -> DataFrame:
    """(volume_id, area) of each volume, 0 without a surface."""
    found = triangles(mask, dims, iso, isotropic).groupBy("volume_id").agg(F.sum(triangle_area()).alias("area"))
    return mask.select("volume_id").distinct().join(found, "volume_id", "left").select("volume_id", F.coalesce("area", F.lit(0.0)).alias("area"))


def area_by_direction(labels: DataFrame, dims: Dims, names: list[str], iso: float = ISO) -> DataFrame:
    """(volume_id, dir, area): the area of the pores that are connected to each face."""
    spark = labels.sparkSession
    faces = segment.face_rows(segment.label_faces(labels, dims)).where("touches")
    wanted = spark.createDataFrame([(segment.DIRECTIONS.index(n), n) for n in names], "dir_id int, dir string")
    faces = faces.join(F.broadcast(wanted), "dir_id").groupBy("volume_id", "label").agg(F.collect_set("dir").alias("dirs"))
    every = F.array(*[F.lit(n) for n in names])
    marked = labels.join(faces, ["volume_id", "label"], "left")
    key = F.struct("volume_id", F.col("dir")).alias("volume_id")
    masks = marked.select("volume_id", *XYZ, "dirs", F.explode(every).alias("dir"))
    masks = masks.select(key, *XYZ, F.when(F.array_contains("dirs", F.col("dir")), 255).otherwise(0).alias("v"))
    return area(masks, dims, iso).select("volume_id.volume_id", "volume_id.dir", "area")


# The same for stacks of whole volumes in numpy.


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(256, most) x 3 edges of each case's triangles, and their number."""
    made = cases()
    most = max(map(len, made))
    edges = np.zeros((256, most, 3), np.int64)
    for k, t in enumerate(made):
        edges[k, : len(t)] = np.array(t, np.int64).reshape(-1, 3)
    return edges, np.array([len(t) for t in made])


def stack_triangles(values: np.ndarray, iso: float = ISO, isotropic: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(volume in the stack, (n, 3, 3) vertices) of the surfaces of masks (n, dz, dy, dx)."""
    f = values.astype(np.float64) / 255.0
    for axis in (1, 2, 3):
        padded = np.pad(f, [(1, 1) if k == axis else (0, 0) for k in range(4)], mode="edge")
        low = tuple(slice(None, -1) if k == axis else slice(None) for k in range(4))
        high = tuple(slice(1, None) if k == axis else slice(None) for k in range(4))
        f = (padded[low] + padded[high]) / 2
    _, dz, dy, dx = values.shape
    at = [f[:, c[2] : c[2] + dz, c[1] : c[1] + dy, c[0] : c[0] + dx] for c in CORNERS]
    index = sum((v < iso).astype(np.int64) << k for k, v in enumerate(at))
    active = np.nonzero((index > 0) & (index < 255))
    case = index[active]
    v = np.stack([x[active] for x in at], axis=1)
    corner = np.array(CORNERS, np.float64)
    base = np.stack([active[3], active[2], active[1]], axis=1).astype(np.float64)
    edges, counts = _tables()
    cell = np.repeat(np.arange(len(case)), counts[case])
    nth = np.arange(len(cell)) - np.repeat(np.cumsum(counts[case]) - counts[case], counts[case])
    edge = edges[case[cell], nth]
    p, q = np.array(EDGES).T
    f0, f1 = v[cell[:, None], p[edge]], v[cell[:, None], q[edge]]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(f0 == f1, 0.0, (iso - f0) / (f1 - f0))
    points = base[cell][:, None, :] + corner[p[edge]] + t[..., None] * (corner[q[edge]] - corner[p[edge]])
    return active[0][cell], points * np.array(_scale((dx, dy, dz), isotropic))


def stack_area(values: np.ndarray, iso: float = ISO, isotropic: bool = False) -> np.ndarray:
    """The surface area of each mask of a stack."""
    which, points = stack_triangles(values, iso, isotropic)
    cross = np.cross(points[:, 1] - points[:, 0], points[:, 2] - points[:, 0])
    return np.bincount(which, 0.5 * np.sqrt((cross * cross).sum(axis=1)), minlength=len(values))


def area_bricks(bricks: DataFrame, iso: float = ISO, isotropic: bool = False) -> DataFrame:
    """(volume_id, area) of whole-volume masks; no shuffle."""

    def run(rows: pa.RecordBatch) -> dict:
        out = np.zeros(rows.num_rows)
        for at, values in stacks(rows, 1 << 20):
            out[at] = stack_area(values, iso, isotropic)
        return {"volume_id": rows.column("volume_id"), "area": out}

    return per_batch(bricks, run, "volume_id long, area double")


def mesh(mask: DataFrame, dims: Dims, iso: float = ISO) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of each volume's surface, centred, with the longest side as unit.

    vertices: (volume_id, vertex, x, y, z, nx, ny, nz), equal positions merged and numbered from 1
    in order of position, normals summed and normalised. faces: (volume_id, a, b, c) by vertex.
    """
    found = triangles(mask, dims, iso, isotropic=True)
    centre = [d / max(dims) / 2 for d in dims]
    u = {a: F.col(f"b.{a}") - F.col(f"a.{a}") for a in AXES}
    w = {a: F.col(f"c.{a}") - F.col(f"a.{a}") for a in AXES}
    normal = F.struct((u["y"] * w["z"] - u["z"] * w["y"]).alias("x"), (u["z"] * w["x"] - u["x"] * w["z"]).alias("y"), (u["x"] * w["y"] - u["y"] * w["x"]).alias("z"))
    place = lambda n: F.struct(*[(F.round(F.col(f"{n}.{a}") - c, 9) + 0.0).alias(a) for a, c in zip(AXES, centre)])
    placed = found.select("volume_id", *[place(n).alias(n) for n in "abc"], normal.alias("n"))
    split = placed.select("volume_id", F.explode(F.array(*[F.col(n) for n in "abc"])).alias("p"), "n")
    summed = split.groupBy("volume_id", "p").agg(*[F.sum(f"n.{a}").alias(f"n{a}") for a in AXES])
    length = F.sqrt(sum((F.col(f"n{a}") * F.col(f"n{a}") for a in AXES), F.lit(0.0)))
    vertices = numbered(summed, "volume_id", ["p"], "vertex").select(
        "volume_id", "vertex", "p", *[F.when(length > 1e-9, F.col(f"n{a}") / length).otherwise(0.0).alias(f"n{a}") for a in AXES]  # those that cancel out give none
    )
    faces = placed.select("volume_id", *"abc")
    for n in "abc":
        faces = faces.join(vertices.select("volume_id", F.col("p").alias(n), F.col("vertex").alias(f"{n}_")), ["volume_id", n])
    faces = faces.select("volume_id", *[F.col(f"{n}_").alias(n) for n in "abc"])
    return vertices.select("volume_id", "vertex", "p.x", "p.y", "p.z", "nx", "ny", "nz"), faces


def shape_factor(mean_area: float, mean_volume: float) -> float:
    """(3 / 4 pi) ** (1/3) * area / volume ** (2/3)."""
    return (3 / (4 * np.pi)) ** (1 / 3) * mean_area / mean_volume ** (2 / 3)
