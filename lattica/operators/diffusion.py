"""Steady diffusion through masks: the linear system, its solvers, and tortuosity.

Pores (0) have the coefficient d0, solid d1, both rounded to single precision. Along the main axis
the concentration is held at 1 before the first and 0 beyond the last plane, or the other way
round for a negative direction; other faces let nothing through. Between two voxels the mean of
their coefficients counts, and half the distance to the held planes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import durable
from ..volumes import AXES, KEY, XYZ, Dims, direction, per_batch, stacks
from .elementwise import diffusivity
from .stencil import neighbours

D0, D1 = 1.0, float(np.float32(0.001))
#: Squared residual from which on a solution is given up.
LOST = 1e11
SIDES = ("xn", "xp", "yn", "yp", "zn", "zp")


# The relational form: one row per voxel.


def system(mask: DataFrame, dims: Dims, name: str, d0: float = 1.0, d1: float = 0.001) -> DataFrame:
    """(volume_id, x, y, z, c_xp .. c_zn, c_diag, rhs, x0): the seven-point system of each volume.

    Coefficients beyond the border are 0 but count in the diagonal along the main axis.
    """
    _, axis, sign = direction(name)
    h = float(np.float32(1.0) / np.float32(max(dims)))
    joined = neighbours(diffusivity(mask, d0, d1), dims, "none")
    begin, end = (1.0, 0.0) if sign > 0 else (0.0, 1.0)
    columns, diagonal, rhs = {}, F.lit(0.0), F.lit(0.0)
    for k, a in enumerate(AXES):
        for side, short in (("pos", "p"), ("neg", "n")):
            other = F.col(f"{a}_{side}")
            inner = (F.col("v") + other) / 2 * h
            columns[f"c_{a}{short}"] = F.coalesce(inner, F.lit(0.0))
            outer = F.col("v") * h * 2 if k == axis else F.lit(0.0)
            diagonal = diagonal - F.coalesce(inner, outer)
    held, last = F.col("v") * h * 2, dims[axis] - 1
    rhs = F.when(F.col(AXES[axis]) == 0, -held * begin).when(F.col(AXES[axis]) == last, -held * end).otherwise(0.0)
    at = F.col(AXES[axis]) / float(dims[axis] + 1)
    start = 1.0 - at if sign > 0 else at
    return joined.select(*KEY, *[v.alias(c) for c, v in columns.items()], diagonal.alias("c_diag"), rhs.alias("rhs"), start.alias("x0"))


def spmv(system_: DataFrame, dims: Dims, column: str = "x0") -> DataFrame:
    """system with ax: the matrix times a column."""
    out = neighbours(system_, dims, "none", column, "_")
    total = F.col("c_diag") * F.col(column)
    for a in AXES:
        for side, short in (("pos", "p"), ("neg", "n")):
            total = total + F.col(f"c_{a}{short}") * F.coalesce(F.col(f"_{a}_{side}"), F.lit(0.0))
    return out.withColumn("ax", total).drop(*[f"_{a}_{s}" for a in AXES for s in ("pos", "neg")])


def residual(system_: DataFrame, dims: Dims, column: str = "x0") -> DataFrame:
    """(volume_id, rr, bb): squared norms of rhs - A x and rhs."""
    r = F.col("rhs") - F.col("ax")
    return spmv(system_, dims, column).groupBy("volume_id").agg(F.sum(r * r).alias("rr"), F.sum(F.col("rhs") * F.col("rhs")).alias("bb"))


def solve_relational(system_: DataFrame, dims: Dims, tolerance: float = 1e-6, max_iter: int = 10000) -> tuple[DataFrame, int]:
    """(volume_id, x, y, z, c) by conjugate gradients with one row per voxel, and the iterations.

    For volumes that don't fit into a task. Sums by volume are joined back; what reaches the driver
    is whether a volume is left that has not converged. Each iteration is checkpointed.
    """
    state = spmv(system_, dims).withColumn("r", F.col("rhs") - F.col("ax")).withColumn("z_", F.col("r") / F.col("c_diag"))
    state = state.select(*KEY, *[f"c_{a}{s}" for a in AXES for s in "pn"], "c_diag", "rhs", F.col("x0").alias("c"), "r", F.col("z_").alias("p"))
    state = durable(state)
    for done in range(max_iter + 1):
        sums = durable(state.groupBy("volume_id").agg(
            F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("rhs") * F.col("rhs")).alias("bb"), F.sum(F.col("r") * F.col("r") / F.col("c_diag")).alias("rz")
        ))
        left = sums.where((F.col("rr") > tolerance**2 * F.col("bb")) & (F.col("rr") <= LOST))
        if done == max_iter or left.isEmpty():
            return state.select(*KEY, "c"), done
        moved = spmv(state, dims, "p")
        curved = moved.groupBy("volume_id").agg(F.sum(F.col("p") * F.col("ax")).alias("pap"))
        step = moved.join(sums.join(curved, "volume_id").withColumn("alpha", F.col("rz") / F.nullif("pap", F.lit(0.0))), "volume_id")
        alpha = F.coalesce("alpha", F.lit(0.0))
        step = step.withColumns({"c": F.col("c") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("ax")})
        step = durable(step.drop("ax", "alpha", "pap", "rr", "bb").withColumnRenamed("rz", "rz_old"))
        fresh = step.groupBy("volume_id").agg(F.sum(F.col("r") * F.col("r") / F.col("c_diag")).alias("rz"))
        beta = F.coalesce(F.col("rz") / F.nullif("rz_old", F.lit(0.0)), F.lit(0.0))
        state = durable(step.join(fresh, "volume_id").withColumn("p", F.col("r") / F.col("c_diag") + beta * F.col("p")).drop("rz", "rz_old"))
    raise AssertionError


def tortuosity_relational(mask: DataFrame, dims: Dims, name: str, tolerance: float = 1e-6, max_iter: int = 10000, d0: float = 1.0, d1: float = 0.001, non_uniform: bool = False) -> DataFrame:
    """(volume_id, dir, tau, iterations, converged, porosity) of voxels, by solve_relational: for volumes beyond a task.

    The same figures as of tortuosity; the next concentration upstream is a window over lines of voxels.
    """
    _, axis, sign = direction(name)
    a = AXES[axis]
    made = durable(system(mask, dims, name, d0, d1))
    solved, steps = solve_relational(made, dims, tolerance, max_iter)
    solved = durable(solved)
    known = made.join(solved, KEY)
    good = residual(known, dims, "c").select("volume_id", (F.col("rr") <= 100 * tolerance**2 * F.col("bb") + 1e-300).alias("converged"))
    line = Window.partitionBy("volume_id", *[b for b in AXES if b != a]).orderBy(F.col(a) if sign > 0 else F.col(a).desc())
    both = mask.select(*KEY, "v", F.when(F.col("v") > 0, F.lit(d1).cast("float").cast("double")).otherwise(F.lit(d0).cast("float").cast("double")).alias("d")).join(solved, KEY)
    both = both.withColumn("ahead", F.lead("c").over(line)).withColumn("next", F.lead("v").over(line))
    gap = F.when(F.col("ahead").isNull(), 0.5).otherwise(1.0)
    pore = F.col("v") == 0
    if non_uniform:
        gap = F.when(F.col("next") > 0, 0.5).otherwise(gap)
    flux = F.col("d") * (F.col("c") - F.coalesce("ahead", F.lit(0.0))) / gap
    mean = F.sum(F.when(pore, flux)) / F.nullif(F.sum(pore.cast("long")), F.lit(0)) if non_uniform else F.avg(flux)
    planes = both.groupBy("volume_id", a).agg(mean.alias("mean"), F.sum(pore.cast("long")).alias("pores"), F.count("*").alias("n"))
    n = dims[axis]
    whole = planes.groupBy("volume_id").agg((F.sum("pores") / F.sum("n")).alias("porosity"), F.when(F.count("mean") == n, F.avg("mean")).alias("mean"))
    tau = F.when(F.col("converged"), F.col("porosity") / (F.col("mean") * n)).otherwise(0.0)
    return whole.join(good, "volume_id").select("volume_id", F.lit(name).alias("dir"), tau.alias("tau"), F.lit(steps).cast("long").alias("iterations"), "converged", "porosity")


def face_slice(concentration: DataFrame, dims: Dims, name: str) -> DataFrame:
    """(volume_id, u, w, c): the concentrations on the face where a direction begins."""
    k, axis, sign = direction(name)
    u, w = AXES[(axis + 1) % 3], AXES[(axis + 2) % 3]
    return concentration.where(F.col(AXES[axis]) == (0 if sign > 0 else dims[axis] - 1)).select("volume_id", F.col(u).alias("u"), F.col(w).alias("w"), "c")


def concentration_profile(concentration: DataFrame, dims: Dims, name: str) -> DataFrame:
    """(volume_id, plane, mean) of the concentration along a direction."""
    _, axis, _ = direction(name)
    return concentration.groupBy("volume_id", F.col(AXES[axis]).alias("plane")).agg(F.avg("c").alias("mean"))


# Whole volumes in numpy, those of equal dims together: arrays are (n, dz, dy, dx).


class Stack:
    """The systems of a stack of masks along one direction, positive definite: - A x = - b."""

    def __init__(self, masks: np.ndarray, name: str, d0: float = 1.0, d1: float = 0.001, kind=np.float64):
        _, axis, self.sign = direction(name)
        self.main = 3 - axis  # the array axis of the main direction
        single = np.float32
        self.d = np.where(masks > 0, single(d1), single(d0)).astype(kind)
        self.faces = {}
        self.diagonal = np.zeros(masks.shape, kind)
        for k in (1, 2, 3):
            low, high = self._cut(k)
            face = (self.d[low] + self.d[high]) / 2
            self.faces[k] = face
            self.diagonal[low] += face
            self.diagonal[high] += face
        first, last = self._end(0), self._end(-1)
        self.diagonal[first] += 2 * self.d[first]
        self.diagonal[last] += 2 * self.d[last]
        self.b = np.zeros(masks.shape, kind)
        if self.sign > 0:
            self.b[first] = 2 * self.d[first]
        elif masks.shape[self.main] > 1:
            self.b[last] = 2 * self.d[last]
        n = masks.shape[self.main]
        at = np.arange(n, dtype=kind) / (n + 1)
        shape = [-1 if k == self.main else 1 for k in range(4)]
        self.start = np.broadcast_to((1 - at if self.sign > 0 else at).reshape(shape), masks.shape).astype(kind)

    @staticmethod
    def _cut(axis: int) -> tuple[tuple, tuple]:
        low = tuple(slice(None, -1) if k == axis else slice(None) for k in range(4))
        return low, tuple(slice(1, None) if k == axis else slice(None) for k in range(4))

    def _end(self, at: int) -> tuple:
        return tuple((slice(0, 1) if at == 0 else slice(-1, None)) if k == self.main else slice(None) for k in range(4))

    def take(self, at: np.ndarray) -> Stack:
        """The systems of some volumes."""
        out = object.__new__(Stack)
        out.main, out.sign = self.main, self.sign
        out.d, out.diagonal, out.b, out.start = self.d[at], self.diagonal[at], self.b[at], self.start[at]
        out.faces = {k: f[at] for k, f in self.faces.items()}
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        out = self.diagonal * x
        for k, face in self.faces.items():
            low, high = self._cut(k)
            out[low] -= face * x[high]
            out[high] -= face * x[low]
        return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("nzyx,nzyx->n", a, b, dtype=np.float64)


def _wide(a: np.ndarray, like: np.ndarray) -> np.ndarray:
    return a.astype(like.dtype)[:, None, None, None]


def cg(s: Stack, tolerance: float = 1e-6, max_iter: int = 10000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(solutions, converged, iterations) by conjugate gradients with the diagonal as preconditioner.

    A volume is done when its squared residual is at most tolerance**2 times that of the right side,
    and given up beyond 1e11. Volumes that are done leave the stack.
    """
    n = len(s.b)
    solution, good, steps = s.start.copy(), np.zeros(n, bool), np.zeros(n, np.int64)
    at, x = np.arange(n), s.start.copy()
    r = s.b - s.times(x)
    z = r / s.diagonal
    p, rz, limit = z.copy(), _dot(r, z), tolerance**2 * _dot(s.b, s.b)
    for k in range(max_iter + 1):
        rr = _dot(r, r)
        ok, lost = rr <= limit, ~(rr <= LOST)
        done = ok | lost | (k == max_iter)
        if done.any():
            solution[at[done]], good[at[done]], steps[at[done]] = x[done], ok[done], k
            left = ~done
            if not left.any():
                break
            at, s = at[left], s.take(left)
            x, r, p, rz, limit = x[left], r[left], p[left], rz[left], limit[left]
        q = s.times(p)
        alpha = _wide(rz / _dot(p, q), x)
        x += alpha * p
        r -= alpha * q
        z = r / s.diagonal
        fresh = _dot(r, z)
        p = z + _wide(fresh / rz, x) * p
        rz = fresh
    return solution, good, steps


def bicgstab(s: Stack, tolerance: float = 1e-6, max_iter: int = 10000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As cg, by stabilised bi-conjugate gradients, begun anew where the shadow residual is nearly orthogonal."""
    n = len(s.b)
    solution, good, steps = s.start.copy(), np.zeros(n, bool), np.zeros(n, np.int64)
    at, x = np.arange(n), s.start.copy()
    r = s.b - s.times(x)
    shadow, p, v = r.copy(), np.zeros_like(r), np.zeros_like(r)
    rho, alpha, omega = np.ones(n), np.ones(n), np.ones(n)
    norm, limit = _dot(r, r), tolerance**2 * _dot(s.b, s.b)
    for k in range(max_iter + 1):
        rr = _dot(r, r)
        ok, lost = rr <= limit, ~(rr <= LOST)
        done = ok | lost | (k == max_iter)
        if done.any():
            solution[at[done]], good[at[done]], steps[at[done]] = x[done], ok[done], k
            left = ~done
            if not left.any():
                break
            at, s = at[left], s.take(left)
            x, r, shadow, p, v, rr = x[left], r[left], shadow[left], p[left], v[left], rr[left]
            rho, alpha, omega, norm, limit = rho[left], alpha[left], omega[left], norm[left], limit[left]
        fresh = _dot(shadow, r)
        again = np.abs(fresh) < 1e-30 * np.maximum(norm, 1e-300)
        if again.any():
            shadow[again], p[again], v[again] = r[again], 0, 0
            rho[again] = alpha[again] = omega[again] = 1
            fresh[again], norm[again] = rr[again], rr[again]
        beta = fresh / rho * alpha / omega
        rho = fresh
        p = r + _wide(beta, x) * (p - _wide(omega, x) * v)
        y = p / s.diagonal
        v = s.times(y)
        alpha = rho / _dot(shadow, v)
        half = r - _wide(alpha, x) * v
        z = half / s.diagonal
        t = s.times(z)
        tt = _dot(t, t)
        omega = np.where(tt > 0, _dot(t, half) / np.where(tt > 0, tt, 1), 1.0)
        omega[omega == 0] = 1e-300
        x += _wide(alpha, x) * y + _wide(omega, x) * z
        r = half - _wide(omega, x) * t
    return solution, good, steps


SOLVERS: dict[str, Callable] = {"CG": cg, "BICGSTAB": bicgstab}


def memory_needed(voxels: int, solver: str = "CG", kind=np.float64, precondition: bool = True) -> int:
    """Bytes of a solver's vectors."""
    return voxels * np.dtype(kind).itemsize * ({True: 4, False: 3}[precondition] if solver == "CG" else 9)


def stack_tortuosity(masks: np.ndarray, s: Stack, x: np.ndarray, good: np.ndarray, non_uniform: bool = False) -> np.ndarray:
    """Porosity / (mean flux * extent) for each volume, 0 where there is no solution, NaN where a plane has no pore.

    The flux of a voxel is its own coefficient times the difference to the next concentration
    upstream, over half the distance at the held plane, which counts as 0. non_uniform: pores
    only, with half the distance towards solid, over the number of pores.
    """
    axis, n = s.main, masks.shape[s.main]
    ahead = np.zeros_like(x)
    inside = np.zeros(masks.shape, bool)
    low, high = s._cut(axis)
    here, there = (low, high) if s.sign > 0 else (high, low)
    ahead[here], inside[here] = x[there], True
    gap = np.where(inside, 1.0, 0.5)
    pores = masks == 0
    if non_uniform:
        solid = np.zeros(masks.shape, bool)
        solid[here] = ~pores[there]
        gap = np.where(solid, 0.5, gap)
    flux = s.d * (x - ahead) / gap
    others = tuple(k for k in (1, 2, 3) if k != axis)
    if non_uniform:
        flux = np.where(pores, flux, 0)
        count = pores.sum(axis=others)
    else:
        count = np.full((len(masks), n), masks[0].size // n)
    with np.errstate(divide="ignore", invalid="ignore"):
        planes = np.where(count > 0, flux.sum(axis=others, dtype=np.float64) / count, np.nan)
        porosity = pores.mean(axis=(1, 2, 3))
        tau = porosity / (planes.mean(axis=1) * n)
    return np.where(good, tau, 0.0)


def tortuosity(
    bricks: DataFrame, names: list[str], solver: str = "CG", tolerance: float = 1e-6, max_iter: int = 10000, d0: float = 1.0, d1: float = 0.001, precision: str = "double", non_uniform: bool = False
) -> DataFrame:
    """(volume_id, dir, tau, iterations, converged, residual_ok, porosity) of whole-volume masks.

    Volumes of equal dims are solved together, some at a time, in the task that reads them; there
    is no shuffle. tau is 0 where the solver fails, and null where non_uniform meets a plane
    without pores. residual_ok: whether the residual, computed anew, is within ten times the tolerance.
    """
    kind = np.float32 if precision in ("float", "single", "f", "s") else np.float64
    solve = SOLVERS.get(solver, cg)

    def run(rows: pa.RecordBatch) -> dict:
        ids = np.array(rows.column("volume_id").to_pylist(), dtype=object)
        out: dict[str, list] = {c: [] for c in ("volume_id", "dir", "tau", "iterations", "converged", "residual_ok", "porosity")}
        for at, masks in stacks(rows, 1 << 18):
            for name in names:
                s = Stack(masks, name, d0, d1, kind)
                x, good, steps = solve(s, tolerance, max_iter)
                tau = stack_tortuosity(masks, s, x, good, non_uniform)
                r = s.b - s.times(x)
                fine = _dot(r, r) <= 100 * tolerance**2 * _dot(s.b, s.b) + 1e-300
                values = (ids[at], [name] * len(at), [None if np.isnan(t) else float(t) for t in tau], steps, good, fine, (masks == 0).mean(axis=(1, 2, 3)))
                for c, v in zip(out, values):
                    out[c] += list(v)
        return out

    return per_batch(bricks, run, "volume_id long, dir string, tau double, iterations long, converged boolean, residual_ok boolean, porosity double")


def concentrations(bricks: DataFrame, name: str, solver: str = "CG", tolerance: float = 1e-6, max_iter: int = 10000) -> DataFrame:
    """Bricks of kind <f8 with the concentration of each whole-volume mask."""

    def run(rows: pa.RecordBatch) -> dict:
        data: list[bytes] = [b""] * rows.num_rows
        for at, masks in stacks(rows, 1 << 18):
            x, _, _ = SOLVERS[solver](Stack(masks, name), tolerance, max_iter)
            for k, values in zip(at, x):
                data[k] = values.astype("<f8").tobytes()
        return {c: rows.column(c) for c in ("volume_id", "dx", "dy", "dz")} | {"kind": ["<f8"] * rows.num_rows, "data": data}

    return per_batch(bricks, run, "volume_id long, dx int, dy int, dz int, kind string, data binary")
