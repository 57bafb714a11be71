"""What the command line measures: tau, alpha, slice and pack, as tables of results."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffusion, sdf, segment, surface
from ..operators.particles import particles_for
from ..operators.reshape import pad, window_origins
from ..volumes import BRICK, Dims, direction, per_batch, stacks, to_voxels

#: Bytes that a task's solver may take.
MEMORY = 1 << 30
#: Exit codes of the command line: done, wrong arguments or input, packing that stays above its target.
DONE, FAILED, ABOVE_TARGET = 0, 1, 77


def porosity(bricks: DataFrame) -> DataFrame:
    """The porosity of each brick, beside all columns that say which it is; no shuffle."""
    kept = [f for f in bricks.schema.fields if f.name not in ("dx", "dy", "dz", "kind", "data", "porosity")]

    def run(rows: pa.RecordBatch) -> dict:
        out = np.empty(rows.num_rows)
        for at, values in stacks(rows):
            out[at] = (values == 0).mean(axis=(1, 2, 3))
        return {f.name: rows.column(f.name) for f in kept} | {"porosity": out}

    return per_batch(bricks, run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "porosity double"]))


def tau(
    bricks: DataFrame, names: list[str], solver: str = "CG", tolerance: float = 1e-6, max_iter: int = 10000, precision: str = "double", non_uniform: bool = False, oversubscribe: bool = False
) -> DataFrame:
    """A row for each volume and direction: ID, dims, dir, porosity, precision, tau, tauIter, tauNU, tauSolver, tauTolerance.

    Volumes whose solver would need more than MEMORY in a task are solved by joins, a row for each
    voxel, unless oversubscribed; these are always solved by CG in double precision.
    """
    kind = np.float32 if precision in ("float", "single", "f", "s") else np.float64
    solver = solver if solver in diffusion.SOLVERS else "CG"
    size = F.col("dx").cast("long") * F.col("dy") * F.col("dz")
    solved = None
    if not oversubscribe:
        fits = size * diffusion.memory_needed(1, solver, kind) <= MEMORY
        # One round of joins for each size of large volumes, of which there are few; the sizes alone reach the driver.
        for dims in map(tuple, bricks.where(~fits).select("dx", "dy", "dz").distinct().collect()):
            same = [F.col(f"d{a}") == d for a, d in zip("xyz", dims)]
            large = to_voxels(bricks.where(same[0] & same[1] & same[2]))
            for name in names:
                found = diffusion.tortuosity_relational(large, dims, name, tolerance, max_iter, non_uniform=non_uniform)
                solved = found if solved is None else solved.unionByName(found)
        bricks_in_tasks = bricks.where(fits)
    else:
        bricks_in_tasks = bricks
    small = diffusion.tortuosity(bricks_in_tasks, names, solver, tolerance, max_iter, precision=precision, non_uniform=non_uniform).drop("residual_ok")
    solved = small if solved is None else small.unionByName(solved)
    shape = bricks.select("volume_id", F.col("dx").alias("dimx"), F.col("dy").alias("dimy"), F.col("dz").alias("dimz"))
    rows = shape.join(solved, "volume_id")
    return rows.select(
        F.col("volume_id").cast("string").alias("ID"), F.lit("cpu").alias("device"), "dimx", "dimy", "dimz", "dir", F.col("porosity").cast("float").cast("double").alias("porosity"),
        F.lit("float" if kind is np.float32 else "double").alias("precision"), F.when(F.col("converged").isNull(), 0.0).otherwise(F.col("tau")).alias("tau"),
        F.coalesce("iterations", F.lit(0)).alias("tauIter"), F.lit(non_uniform).alias("tauNU"), F.lit(solver).alias("tauSolver"), F.lit(float(tolerance)).alias("tauTolerance"),
    )


def alpha(bricks: DataFrame, names: list[str], segments: bool = False) -> DataFrame:
    """(ID, dimx, dimy, dimz, dir, porosity, rad[, segmentVolumeRatio]): the area of the pores connected to each face.

    A row DIR_NONE has the area of the whole mask. segmentVolumeRatio: the share of the volume in
    pores that don't touch all six faces. Volumes of a batch are labelled and measured together.
    """
    fields = "volume_id long, dimx int, dimy int, dimz int, dir string, porosity double, rad double, segmentVolumeRatio double"

    def run(rows: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.split()[0]: [] for f in fields.split(", ")}
        ids = np.array(rows.column("volume_id").to_pylist(), dtype=object)
        for at, masks in stacks(rows, 1 << 20):
            n, dz, dy, dx = masks.shape
            labels = segment.label_stack(masks)
            faces = faces_of(labels)
            cut = np.array([(~faces[k].all(axis=0)[labels[k]] & (labels[k] > 0)).mean() for k in range(n)])
            for name in [*names, "DIR_NONE"]:
                number = direction(name)[0]
                if name == "DIR_NONE":
                    area = surface.stack_area(masks)
                else:
                    area = surface.stack_area(np.stack([np.where(faces[k][number][labels[k]], 255, 0) for k in range(n)]))
                for c, v in zip(out, (ids[at], [dx] * n, [dy] * n, [dz] * n, [name] * n, (masks == 0).mean(axis=(1, 2, 3)), area, cut)):
                    out[c] += list(v)
        return out

    made = per_batch(bricks, run, fields).withColumn("ID", F.col("volume_id").cast("string")).drop("volume_id")
    columns = ["ID", "dimx", "dimy", "dimz", "dir", "porosity", "rad"] + ["segmentVolumeRatio"] * segments
    return made.select(*columns)


def faces_of(labels: np.ndarray) -> list[np.ndarray]:
    """For each volume of a stack (6, labels + 1) booleans: which label touches which face; the background none."""
    out = []
    for volume in labels:
        touches = np.zeros((6, int(volume.max()) + 1), bool)
        for axis in range(3):
            at = 2 - axis
            touches[2 * axis, np.unique(np.take(volume, -1, axis=at))] = True
            touches[2 * axis + 1, np.unique(np.take(volume, 0, axis=at))] = True
        touches[:, 0] = False
        out.append(touches)
    return out


def alpha_basic(bricks: DataFrame) -> DataFrame:
    """(ID, dimx, dimy, dimz, porosity, radBasic) of whole masks."""
    rows = bricks.select("volume_id", F.col("dx").alias("dimx"), F.col("dy").alias("dimy"), F.col("dz").alias("dimz"))
    rows = rows.join(surface.area_bricks(bricks), "volume_id").join(porosity(bricks), "volume_id")
    return rows.select(F.col("volume_id").cast("string").alias("ID"), "dimx", "dimy", "dimz", "porosity", F.col("area").alias("radBasic"))


def unreachable_segments(bricks: DataFrame) -> DataFrame:
    """(ID, label, min_*, max_*, voxel_num, at_boundary) of components that don't touch all six faces."""
    kinds = "volume_id long, label long, " + ", ".join(f"{m}_{a} int" for m in ("min", "max") for a in "xyz") + ", voxel_num long, at_boundary boolean"

    def run(rows: pa.RecordBatch) -> dict:
        names = [k.split()[0] for k in kinds.split(", ")]
        out: dict[str, list] = {n: [] for n in names}
        ids = rows.column("volume_id").to_pylist()
        for at, masks in stacks(rows, 1 << 20):
            labels = segment.label_stack(masks)
            for row, volume, touches in zip(at, labels, faces_of(labels)):
                n, reach = touches.shape[1], []
                z, y, x = np.nonzero(volume)
                which = volume[z, y, x]
                for c in (x, y, z):
                    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                    np.minimum.at(low, which, c)
                    np.maximum.at(high, which, c)
                    reach.append((low, high + 1))
                for k in np.flatnonzero(~touches.all(axis=0))[1:]:
                    values = [ids[row], k, *[r[0][k] for r in reach], *[r[1][k] for r in reach], int((which == k).sum()), bool(touches[:, k].any())]
                    for c, v in zip(names, values):
                        out[c].append(v)
        return out

    return per_batch(bricks, run, kinds).withColumn("ID", F.col("volume_id").cast("string")).drop("volume_id")


def partition_meshes(labels: DataFrame, dims: Dims, axis: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Meshes, as (vertices, faces), of the pores that touch the far end of an axis only, the near end only, and both; each padded by a voxel."""
    parts = segment.face_partition(labels, dims, axis)
    out = {}
    for name in ("pos", "neg", "mid"):
        mask = segment.selected_mask(labels, parts.where(F.col("part") == name))
        out[name] = surface.mesh(pad(mask, dims, (1, 1, 1), (1, 1, 1)), tuple(d + 2 for d in dims))
    return out


def cut_windows(bricks: DataFrame, size: Dims, stride: Dims, begin: Dims = (0, 0, 0), end: Dims | None = None, inclusive_end: bool = False) -> DataFrame:
    """(volume_id, originx, originy, originz, dx, dy, dz, kind, data): each window of each volume as a brick.

    A volume is cut by the task that holds it, window after window.
    """
    schema = "volume_id long, originx int, originy int, originz int, dx int, dy int, dz int, kind string, data binary"

    def run(parts):
        for part in parts:
            for row in part.to_pylist():
                whole = np.frombuffer(row["data"], row["kind"]).reshape(row["dz"], row["dy"], row["dx"])
                xs, ys, zs = window_origins((row["dx"], row["dy"], row["dz"]), size, stride, begin, end, inclusive_end)
                for z in zs:
                    made = [(x, y, whole[z : z + size[2], y : y + size[1], x : x + size[0]].tobytes()) for y in ys for x in xs]
                    if made:
                        n = len(made)
                        one = lambda v: pa.array([v] * n, pa.int32())
                        columns = [pa.array([row["volume_id"]] * n, pa.int64()), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int32()), one(z), *map(one, size)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([row["kind"]] * n), pa.array([m[2] for m in made], pa.binary())], names=[f.split()[0] for f in schema.split(", ")])

    return bricks.select("volume_id", "dx", "dy", "dz", "kind", "data").mapInArrow(run, schema)


def slices(bricks: DataFrame, size: Dims = (32, 32, 32), stride: Dims = (1, 1, 1), tolerance: float = 1e-5, **bounds) -> DataFrame:
    """(ID, alpha, porosity, tau, size*, origin*, dir) of each window along X_POS, Y_POS and Z_POS, in single precision.

    Windows are spread over all tasks before they are measured.
    """
    names = ["X_POS", "Y_POS", "Z_POS"]
    found = cut_windows(bricks, size, stride, **bounds)
    key = F.struct("volume_id", "originx", "originy", "originz")
    spread = found.repartition(key).withColumn("window", F.xxhash64(key))
    fields = "volume_id long, originx int, originy int, originz int, dir string, alpha double, porosity double, tau double"

    def run(rows: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.split()[0]: [] for f in fields.split(", ")}
        places = [np.array(rows.column(c).to_pylist(), dtype=object) for c in ("volume_id", "originx", "originy", "originz")]
        for at, masks in stacks(rows, 1 << 18):
            area, empty = surface.stack_area(masks), (masks == 0).mean(axis=(1, 2, 3))
            for name in names:
                s = diffusion.Stack(masks, name, kind=np.float32)
                x, good, _ = diffusion.cg(s, tolerance)
                values = (*[p[at] for p in places], [name] * len(at), area, empty, diffusion.stack_tortuosity(masks, s, x, good))
                for c, v in zip(out, values):
                    out[c] += list(v)
        return out

    rows = per_batch(spread.drop("window"), run, fields)
    sizes = [F.lit(s).alias(f"size{a}") for a, s in zip("xyz", size)]
    return rows.select(F.col("volume_id").cast("string").alias("ID"), "alpha", "porosity", "tau", *sizes, "originx", "originy", "originz", "dir")


def measure(bricks: DataFrame, names: list[str] = ("X_POS",)) -> DataFrame:
    """(volume_id, porosity, n_components, area, tau_* for each direction) of whole-volume masks, in one pass without a shuffle."""
    fields = ", ".join(["volume_id long", "porosity double", "n_components long", "area double", *(f"tau_{n.lower()} double" for n in names)])

    def run(rows: pa.RecordBatch) -> dict:
        n = rows.num_rows
        out = {f.split()[0]: np.zeros(n) for f in fields.split(", ")[1:]} | {"n_components": np.zeros(n, np.int64)}
        for at, masks in stacks(rows, 1 << 18):
            out["porosity"][at] = (masks == 0).mean(axis=(1, 2, 3))
            out["n_components"][at] = segment.label_stack(masks).max(axis=(1, 2, 3))
            out["area"][at] = surface.stack_area(masks)
            for name in names:
                s = diffusion.Stack(masks, name)
                x, good, _ = diffusion.cg(s)
                out[f"tau_{name.lower()}"][at] = diffusion.stack_tortuosity(masks, s, x, good)
        return {"volume_id": rows.column("volume_id")} | out

    return per_batch(bricks, run, fields)


@dataclass(frozen=True)
class PackResult:
    rows: DataFrame
    particles: DataFrame
    code: int


def pack(spark: SparkSession, n: int = 8, size: tuple[float, float, float] = (0.5, 0.5, 0.5), target_porosity: float | None = None, tolerance: float = 0.03, max_iter: int = 2000, schedule: float = 0.99, raster: int = 0, seed: int = 1) -> PackResult:
    """One packing: a row (px, py, pz, pN, porosityAchievable, porosity, overlap, schedule, iterations, radBasic) and its particles.

    target_porosity, if given, sets n. porosity and radBasic are 0 without a raster.
    """
    volume = 4 / 3 * np.pi * float(np.prod(size)) / 8
    n = particles_for(target_porosity, volume) if target_porosity is not None else n
    sets = spark.createDataFrame([(0, n, *map(float, size), seed, max_iter, schedule, tolerance)], "set_id long, n int, sx double, sy double, sz double, seed long, max_iter int, schedule double, target double")
    particles = sdf.pack_sets(sets).persist()
    state = particles.select("score", "steps", "porosity").first()
    score, steps, achieved = state if state else (0.0, 0, 1.0)
    empty, area = 0.0, 0.0
    if raster and n:
        bricks = sdf.rasterize_sets(particles, (raster,) * 3).persist()
        empty, area = porosity(bricks).first()["porosity"], surface.area_bricks(bricks).first()["area"]
        bricks.unpersist()
    names = "px double, py double, pz double, pN int, porosityAchievable double, porosity double, overlap double, schedule double, iterations int, radBasic double"
    rows = spark.createDataFrame([(*map(float, size), n, achieved, empty, score, schedule, steps, area)], names)
    return PackResult(rows, particles, DONE if score < tolerance else ABOVE_TARGET)
