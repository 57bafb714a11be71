"""Signed distances of particles, and packing of ellipsoids by simulated annealing.

Distances are ours where no formula is prescribed: an ellipsoid has the usual bound
k0 (k0 - 1) / k1 with k0 = |p / r|, k1 = |p / r**2|, a box its exact distance. Volumes are
integrated on an octree: a cell whose centre's distance exceeds its half diagonal is full or
empty, others are split up to a depth, where the sign of the centre decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..volumes import BRICK, Dims
from .particles import in_cubes, meeting_pairs, poisson_disk, summed

Distance = Callable[[np.ndarray], np.ndarray]


def rotation(q: np.ndarray) -> np.ndarray:
    """The matrix of a quaternion (x, y, z, w); of quaternions (4, n) the matrices (3, 3, n)."""
    x, y, z, w = q / np.maximum(1e-300, np.linalg.norm(q, axis=0 if q.ndim > 1 else None))
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


@dataclass
class Primitive:
    """An ellipsoid or box of given half extents, rotated and moved."""

    size: np.ndarray
    position: np.ndarray
    turn: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, 1.0]))
    kind: str = "ellipsoid"
    rounding: float = 0.0

    def distance(self, p: np.ndarray) -> np.ndarray:
        """Signed distances of points (n, 3), negative inside."""
        local = (p - self.position) @ rotation(self.turn)
        if self.kind == "box":
            q = np.abs(local) - (self.size - self.rounding)
            return np.linalg.norm(np.maximum(q, 0), axis=1) + np.minimum(q.max(axis=1), 0) - self.rounding
        k0, k1 = np.linalg.norm(local / self.size, axis=1), np.linalg.norm(local / self.size**2, axis=1)
        return np.where(k1 > 0, k0 * (k0 - 1) / np.where(k1 > 0, k1, 1), -self.size.min())

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        m = rotation(self.turn)
        reach = np.abs(m) @ self.size if self.kind == "box" else np.sqrt((m * m) @ (self.size**2))
        return self.position - reach, self.position + reach

    def volume(self) -> float:
        return float(8 * self.size.prod() if self.kind == "box" else 4 / 3 * math.pi * self.size.prod())


def union(items: list[Primitive]) -> Distance:
    return lambda p: np.min([i.distance(p) for i in items], axis=0) if items else np.full(len(p), np.inf)


def intersection(items: list[Primitive]) -> Distance:
    return lambda p: np.max([i.distance(p) for i in items], axis=0)


def void(items: list[Primitive], low: np.ndarray, high: np.ndarray) -> Distance:
    """The domain box without the items."""
    box = Primitive((high - low) / 2, (high + low) / 2, kind="box")
    return lambda p: np.maximum(box.distance(p), -union(items)(p))


def meet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """The overlap of two boxes, if any."""
    low, high = np.maximum(a[0], b[0]), np.minimum(a[1], b[1])
    return (low, high) if (low < high).all() else None


def inside_box(items: list[Primitive], low: np.ndarray, high: np.ndarray) -> list[Primitive]:
    """Items whose bounds meet a box."""
    return [i for i in items if meet(i.bounds(), (low, high))]


_CORNERS = np.array([[i, j, k] for k in (0, 1) for j in (0, 1) for i in (0, 1)], float)


def _octants(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = size / 2
    return (low[:, None, :] + _CORNERS[None] * half).reshape(-1, 3), half


def octree_cells(f: Distance, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, volumes) of the cells inside: full ones of any level and those of the last level with the centre inside."""
    corners, size, centres, volumes = np.asarray(low, float)[None], np.asarray(high, float) - low, [], []
    for level in range(depth + 1):
        middle = corners + size / 2
        d, half = f(middle), np.linalg.norm(size) / 2
        full = d <= -half if level < depth else d < 0
        centres.append(middle[full])
        volumes.append(np.full(full.sum(), size.prod()))
        open_ = (np.abs(d) < half) & (level < depth)
        if not open_.any():
            break
        corners, size = _octants(corners[open_], size)
    return np.concatenate(centres), np.concatenate(volumes)


def volume_of(f: Distance, low: np.ndarray, high: np.ndarray, depth: int = 4) -> float:
    return float(octree_cells(f, low, high, depth)[1].sum())


def total_volume(items: list[Primitive], low: np.ndarray, high: np.ndarray, depth: int = 4, parts: int = 4) -> float:
    """The volume of the union in a box, summed over parts**3 boxes, each with the items that reach it."""
    size, total = (high - low) / parts, 0.0
    for at in np.ndindex(parts, parts, parts):
        corner = low + np.array(at) * size
        near = inside_box(items, corner, corner + size)
        if near:
            total += volume_of(union(near), corner, corner + size, depth)
    return total


def overlaps(items: list[Primitive], depth: int = 3) -> np.ndarray:
    """For each item the volume it shares with others, summed over pairs whose bounds meet."""
    out, boxes = np.zeros(len(items)), [i.bounds() for i in items]
    for a in range(len(items)):
        for b in range(a + 1, len(items)):
            box = meet(boxes[a], boxes[b])
            if box:
                shared = volume_of(intersection([items[a], items[b]]), *box, depth)
                out[a] += shared
                out[b] += shared
    return out


def rasterize(items: list[Primitive], low: np.ndarray, high: np.ndarray, dims: Dims, overlap: bool = False) -> np.ndarray:
    """(dz, dy, dx) bytes: 255 where a voxel's centre is inside, or, for overlap, where the mean of
    the distance's gradients at its corners is shorter than 0.99, that is on a crease between items."""
    f = union(items)
    step = (high - low) / np.array(dims)
    points = lambda at: (low + np.stack(np.meshgrid(*[np.arange(d) + at for d in dims], indexing="ij"), axis=-1).reshape(-1, 3) * step)
    out = np.empty(int(np.prod(dims)), np.uint8)
    if not overlap:
        p = points(0.5)
        for k in range(0, len(p), 1 << 18):
            out[k : k + (1 << 18)] = np.where(f(p[k : k + (1 << 18)]) < 0, 255, 0)
        return np.ascontiguousarray(out.reshape(dims).transpose(2, 1, 0))
    mean, h = 0.0, 1e-4 * step.min()
    for corner in np.ndindex(2, 2, 2):
        p = points(0.0) + np.array(corner) * step
        g = np.stack([f(p + h * e) - f(p - h * e) for e in np.eye(3)], axis=1)
        mean = mean + g / np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-300) / 8
    return np.ascontiguousarray(np.where(np.linalg.norm(mean, axis=1) < 0.99, 255, 0).astype(np.uint8).reshape(dims).transpose(2, 1, 0))


def gravity(f: Distance, at: np.ndarray, mass: float, low: np.ndarray, high: np.ndarray, depth: int = 3) -> tuple[np.ndarray, float]:
    """The pull of the cells inside f, each its volume * mass / distance**2, and its magnitude."""
    centres, volumes = octree_cells(f, low, high, depth)
    way = centres - at
    d2 = (way * way).sum(axis=1)
    near = d2 > 1e-12
    way, pull = way[near], volumes[near] * mass / d2[near]
    force = (way / np.sqrt(d2[near])[:, None] * pull[:, None]).sum(axis=0) if near.any() else np.zeros(3)
    return force, float(np.linalg.norm(force))


def elasticity(items: list[Primitive], low: np.ndarray, high: np.ndarray, draw: np.random.Generator, depth: int = 3) -> np.ndarray:
    """(n, 3) forces: pulled to voids near by, pushed from items that overlap; nearly coincident ones are kicked at random."""
    forces, boxes, n = np.zeros((len(items), 3)), [i.bounds() for i in items], len(items)
    for a, item in enumerate(items):
        box = meet((boxes[a][0] - item.size.max(), boxes[a][1] + item.size.max()), (low, high))
        if box:
            near = inside_box(items, *box)
            forces[a] += gravity(void(near, *box), item.position, item.volume(), *box, depth=min(depth, 2))[0]
        for b, other in enumerate(items):
            shared_box = meet(boxes[a], boxes[b]) if a != b else None
            if not shared_box:
                continue
            shared = volume_of(intersection([item, other]), *shared_box, depth)
            if shared > 0.9 * min(item.volume(), other.volume()):
                forces[a] += draw.normal(size=3) * item.size.min()
                continue
            way = item.position - other.position
            d2 = max(1e-12, float(way @ way))
            forces[a] += 0.05 * shared * n / d2 * way / math.sqrt(d2)
    return forces


# Annealing.


def accept(score: float, fresh: float, temperature: float) -> float:
    """The probability of taking a fresh state: 1 if it is better, else falling with the difference over the temperature."""
    return 1.0 if fresh < score else math.exp(-(fresh - score) / temperature) if temperature > 0 else 0.0


def temperature(schedule: str, step: int, steps: int) -> float:
    """From 1 to 0: linear, quadratic, or exponential."""
    left = max(0.0, 1 - step / max(1, steps))
    return {"linear": left, "quadratic": left * left, "exp": math.exp(-5 * (1 - left))}[schedule]


def geometric(start: float, factor: float, step: int) -> float:
    return start * factor**step


@dataclass
class Annealing:
    """Simulated annealing of any state; history holds the best score after each step."""

    state: object
    score: Callable[[object], float]
    neighbour: Callable[[object, float], object]
    cool: Callable[[int], float]
    draw: np.random.Generator
    accepted: Callable[[float, float, float], float] = accept
    samples: int = 1

    def __post_init__(self):
        self.at = self._score(self.state)
        self.best, self.best_at, self.steps, self.rejected, self.history = self.state, self.at, 0, 0, []

    def _score(self, state: object) -> float:
        return sum(self.score(state) for _ in range(self.samples)) / self.samples

    def update(self, steps: int = 1) -> None:
        for _ in range(steps):
            t = self.cool(self.steps)
            fresh = self.neighbour(self.state, t)
            at = self._score(fresh)
            if at < self.best_at:
                self.best, self.best_at = fresh, at
            if self.draw.random() < self.accepted(self.at, at, t):
                self.state, self.at = fresh, at
            else:
                self.rejected += 1
            self.steps += 1
            self.history.append(self.best_at)


def penetration(items: list[Primitive], depth: int = 3) -> float:
    """The largest share of an item's volume that overlaps others, times the cube root of its volume."""
    shared = overlaps(items, depth)
    k = int(np.argmax(shared)) if len(shared) else 0
    v = items[k].volume() if items else 1.0
    return float(shared[k] / v * v ** (1 / 3)) if items else 0.0


def pack(n: int, size: tuple[float, float, float], seed: int, max_iter: int = 2000, schedule: float = 0.99, target: float = 0.03, low=(-1.0, -1.0, -1.0), high=(1.0, 1.0, 1.0), stop: bool = True) -> tuple[list[Primitive], Annealing]:
    """Ellipsoids of given half axes in a box, moved until they hardly overlap or max_iter is reached.

    They begin on a Poisson-disk sample. A move shifts and turns each at random, the more the
    hotter, and along its force, and with a probability of 1 - temperature puts the worst one
    elsewhere. Centres stay within the box.
    """
    draw, low, high, size = np.random.default_rng(seed), np.array(low, float), np.array(high, float), np.array(size, float)
    start = poisson_disk((high - low).min() / n ** (1 / 3), n, seed, low, high)
    turn = lambda: (lambda q: q / np.linalg.norm(q))(draw.normal(size=4))
    items = [Primitive(size, p, turn()) for p in start]

    def move(state: list[Primitive], t: float) -> list[Primitive]:
        forces = elasticity(state, low, high, draw, 2)
        out = []
        for item, force in zip(state, forces):
            length = np.linalg.norm(force)
            step = force * min(1.0, 0.1 * size.min() / length) if length > 0 else 0.0
            p = np.clip(item.position + draw.normal(size=3) * 0.1 * t * size.min() + step, low, high)
            q = item.turn + 0.1 * t * draw.normal(size=4)
            out.append(Primitive(size, p, q / np.linalg.norm(q)))
        if out and draw.random() < 1 - t:
            out[int(np.argmax(overlaps(out, 2)))] = Primitive(size, draw.uniform(low, high), turn())
        return out

    run = Annealing(items, lambda s: penetration(s, 2), move, lambda k: geometric(1.0, schedule, k), draw)
    while run.steps < max_iter and not (stop and run.best_at < target):
        run.update()
    return run.best, run


_DESCRIBED = [f"{c}{a}" for c, axes in (("p", "xyz"), ("q", "xyzw"), ("s", "xyz")) for a in axes]
PACKED = "set_id long, id long, px double, py double, pz double, qx double, qy double, qz double, qw double, sx double, sy double, sz double, score double, steps int, porosity double"


def pack_sets(sets: DataFrame) -> DataFrame:
    """Packings of sets (set_id, n, sx, sy, sz, seed, max_iter, schedule, target): a row for each particle. A set is one task's work."""

    def run(parts):
        for part in parts:
            for row in part.to_pylist():
                items, state = pack(row["n"], (row["sx"], row["sy"], row["sz"]), row["seed"], row["max_iter"], row["schedule"], row["target"])
                box = np.array([-1.0] * 3), np.array([1.0] * 3)
                porosity = 1 - total_volume(items, *box, depth=3) / 8
                rows = [(row["set_id"], k, *i.position, *i.turn, *i.size, state.best_at, state.steps, porosity) for k, i in enumerate(items)]
                names = [c.split()[0] for c in PACKED.split(", ")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, (float(v) if 2 <= k < 13 or k == 14 else int(v) for k, v in enumerate(r)))) for r in rows], schema=_packed_schema())

    return sets.mapInArrow(run, PACKED)


def _packed_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PACKED.split(", ")])


#: Items of a set that one task rasterizes, and points that are looked at together.
SHARE, POINTS = 1 << 13, 1 << 18
_DOMAIN = np.full(3, -1.0), np.full(3, 1.0)


def rasterize_sets(packed: DataFrame, dims: Dims) -> DataFrame:
    """A brick for each packed set: 255 where a voxel's centre is inside one of its items.

    packed: (set_id, id, px .. pz, qx .. qw, sx .. sz, and kind or not); items with nulls hold
    nothing. A set of many items is dealt over tasks, whose bricks are then united; a task holds one
    brick and a batch of rows, however many items there are.
    """
    spark = packed.sparkSession
    what = [c for c in packed.columns if c == "kind" or c in _DESCRIBED]
    counts = packed.groupBy("set_id").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    most = counts.agg(F.max("shares")).first()[0] or 0
    dealt = packed.select("set_id", "id", *what)
    if most > 1:
        dealt = dealt.join(counts.where("shares > 1"), "set_id", "left").withColumn("share", F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1))))
    else:
        dealt = dealt.withColumn("share", F.lit(0).cast("long"))
    kept = ["set_id", "share", *what]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(*kept).repartition(tasks, "set_id", "share").sortWithinPartitions("set_id", "share")

    def brick(key: tuple, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), *[pa.array([d], pa.int32()) for d in dims], pa.array(["<u1"]), pa.array([data.tobytes()], pa.binary())], names=[c.split()[0] for c in BRICK.split(", ")])

    def united(by: list[str], add: Callable[[np.ndarray, pa.RecordBatch], None]):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data, last = None, None
            for part in parts:
                keys = list(zip(*(part.column(c).to_pylist() for c in by)))
                turns = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
                for begin, end in zip(turns, turns[1:]):
                    if data is None or keys[begin] != last:
                        if data is not None:
                            yield brick(last, data)
                        data, last = np.zeros(int(np.prod(dims)), np.uint8), keys[begin]
                    add(data, part.slice(begin, end - begin))
            if data is not None:
                yield brick(last, data)

        return run

    made = dealt.mapInArrow(united(["set_id", "share"], lambda data, rows: fill(data, Primitives(rows), *_DOMAIN, dims)), BRICK)
    if most <= 1:
        return made

    def unite(data: np.ndarray, rows: pa.RecordBatch) -> None:
        for one in rows.column("data"):
            np.maximum(data, np.frombuffer(one.as_buffer(), np.uint8), out=data)

    return made.repartition(tasks, "volume_id").sortWithinPartitions("volume_id").mapInArrow(united(["volume_id"], unite), BRICK)


def fill(data: np.ndarray, items: Primitives, low: np.ndarray, high: np.ndarray, dims: Dims) -> None:
    """Set 255 in data (x fastest) for the voxels of low .. high whose centre is inside an item. Only voxels within items' bounds are looked at, POINTS at a time."""
    size, step = np.array(dims), (high - low) / np.array(dims)
    ends = ((end - low) / step - 0.5 for end in items.bounds())
    lacking = ~np.isfinite(items.size + items.position).all(axis=1)
    first, last = (np.where(lacking[:, None], 0, np.clip(r(end), lo, hi)).astype(np.int64) for r, end, lo, hi in zip((np.floor, np.ceil), ends, (0, -1), (size, size - 1)))
    extent = np.maximum(last - first + 1, 0)
    extent[lacking] = 0
    upto = np.cumsum(extent.prod(axis=1))
    for k in range(0, int(upto[-1]) if len(upto) else 0, POINTS):
        at = np.arange(k, min(k + POINTS, int(upto[-1])))
        row = np.searchsorted(upto, at, "right")
        at -= (upto - extent.prod(axis=1))[row]
        dx, dy, _ = extent[row].T
        x, y, z = (first[row] + np.stack([at % dx, at // dx % dy, at // (dx * dy)], axis=1)).T
        flat = (z * size[1] + y) * size[0] + x
        new = np.flatnonzero(data[flat] == 0)
        centre = low + (np.stack([x[new], y[new], z[new]], axis=1) + 0.5) * step
        data[flat[new[items.distance(row[new], centre) < 0]]] = 255


def _primitive(r: dict) -> Primitive:
    return Primitive(np.array([r["sx"], r["sy"], r["sz"]]), np.array([r["px"], r["py"], r["pz"]]), np.array([r["qx"], r["qy"], r["qz"], r["qw"]]), r.get("kind") or "ellipsoid")


def count_sets(items: DataFrame, dims: Dims) -> DataFrame:
    """(set_id, in_union, in_all, in_void): how many voxels of [-1, 1]**3 have their centre in any, in all, in none of a set's items."""

    def run(table: pa.Table) -> pa.Table:
        held, low, high = [_primitive(r) for r in table.to_pylist()], np.array([-1.0] * 3), np.array([1.0] * 3)
        p = low + (np.stack(np.meshgrid(*[np.arange(d) for d in dims], indexing="ij"), axis=-1).reshape(-1, 3) + 0.5) * (high - low) / np.array(dims)
        counts = [int((f(p) < 0).sum()) for f in (union(held), intersection(held), void(held, low, high))]
        return pa.table({"set_id": table.column("set_id").slice(0, 1)} | {c: pa.array([n], pa.int64()) for c, n in zip(("in_union", "in_all", "in_void"), counts)})

    return items.groupBy("set_id").applyInArrow(run, "set_id long, in_union long, in_all long, in_void long")


class Primitives:
    """Ellipsoids and boxes of many rows (kind, p, q and s columns; no kind: ellipsoids), as Primitive has them one by one."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        column = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        self.position, turn, self.size = (np.stack([column(f"{c}{a}").astype(float) for a in axes], axis=1) for c, axes in (("p", "xyz"), ("q", "xyzw"), ("s", "xyz")))
        kinds = rows.column("kind").to_pylist() if "kind" in rows.schema.names else [None] * rows.num_rows
        self.box = np.array([k == "box" for k in kinds], bool)
        self.matrix = rotation(turn.T).transpose(2, 0, 1)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        by_box = np.einsum("nij,nj->ni", np.abs(self.matrix), self.size)
        reach = np.where(self.box[:, None], by_box, np.sqrt(np.einsum("nij,nj->ni", self.matrix * self.matrix, self.size**2)))
        return self.position - reach, self.position + reach

    def along_axes(self) -> np.ndarray:
        """Which are boxes whose edges run along the axes."""
        return self.box & np.isin(self.matrix, (-1.0, 0.0, 1.0)).all(axis=(1, 2))

    def distance(self, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Signed distances of points (n, 3), each from the item of its row."""
        local, size, out = np.einsum("ni,nij->nj", p - self.position[rows], self.matrix[rows]), self.size[rows], np.empty(len(rows))
        box = self.box[rows]
        if box.any():
            q = np.abs(local[box]) - size[box]
            out[box] = np.linalg.norm(np.maximum(q, 0), axis=1) + np.minimum(q.max(axis=1), 0)
        if not box.all():
            local, size = local[~box], size[~box]
            with np.errstate(divide="ignore", invalid="ignore"):
                k0, k1 = np.linalg.norm(local / size, axis=1), np.linalg.norm(local / size**2, axis=1)
                out[~box] = np.where(k1 > 0, k0 * (k0 - 1) / np.where(k1 > 0, k1, 1), -size.min(axis=1, initial=np.inf))
        return out


def shared_volumes(a: Primitives, b: Primitives, i: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
    """The volumes that items i of a and j of b share, pair by pair: of two boxes along the axes their
    overlap, which the octree would give too; of others by one octree for each pair, all at a time."""
    (low_a, high_a), (low_b, high_b) = a.bounds(), b.bounds()
    low, high = np.maximum(low_a[i], low_b[j]), np.minimum(high_a[i], high_b[j])
    out = np.maximum(high - low, 0).prod(axis=1)
    left = np.flatnonzero(~(a.along_axes()[i] & b.along_axes()[j]))
    step = max(1, (1 << 18) >> (3 * depth))
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        out[rows] = _octree_volumes(a, b, i[rows], j[rows], low[rows], high[rows], depth)
    return out


def _octree_volumes(a: Primitives, b: Primitives, i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """volume_of the intersection of items i of a and j of b in their boxes low .. high; 0 where a box is empty."""
    at = np.flatnonzero((low < high).all(axis=1))
    corners, size, out = low[at], high - low, np.zeros(len(i))
    for level in range(depth + 1):
        middle, half = corners + size[at] / 2, np.linalg.norm(size[at], axis=1) / 2
        d = np.maximum(a.distance(i[at], middle), b.distance(j[at], middle))
        full = d <= -half if level < depth else d < 0
        out += np.bincount(at[full], size[at[full]].prod(axis=1), len(i))
        split = np.abs(d) < half
        if level == depth or not split.any():
            break
        at, size = at[split], size / 2
        corners = (corners[split][:, None] + _CORNERS[None] * size[at][:, None]).reshape(-1, 3)
        at = np.repeat(at, 8)
    return out


def with_bounds(items: DataFrame) -> DataFrame:
    """items (kind, p, q and s columns) with the boxes around them, min_x .. max_z."""

    def run(parts):
        for part in parts:
            columns = [pa.array(np.ascontiguousarray(end[:, k]), from_pandas=True) for end in Primitives(part).bounds() for k in range(3)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *BOUNDS])

    return items.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields), *(f"{b} double" for b in BOUNDS)]))


def total_volumes(items: DataFrame, depth: int = 3, parts: int = 4) -> DataFrame:
    """(set_id, volume, porosity) of the union of each set's items in [-1, 1]**3. A set is one task's work."""

    def run(table: pa.Table) -> pa.Table:
        volume = total_volume([_primitive(r) for r in table.to_pylist()], np.array([-1.0] * 3), np.array([1.0] * 3), depth, parts)
        return pa.table({"set_id": table.column("set_id").slice(0, 1), "volume": pa.array([volume], pa.float64()), "porosity": pa.array([1 - volume / 8], pa.float64())})

    return items.groupBy("set_id").applyInArrow(run, "set_id long, volume double, porosity double")


BOUNDS = [f"{m}_{a}" for m in ("min", "max") for a in "xyz"]


def overlap_volumes(items: DataFrame, bins: float, depth: int = 3) -> DataFrame:
    """(set_id, id, shared): for each item the volume it shares with others, over all pairs whose bounds meet.

    items: (set_id, id, kind, px .. pz, qx .. qw, sx .. sz). Pairs meet in cubes of the edge `bins`,
    as in_cubes has it; each task finds its pairs' volumes, many at a time, and sums them by item
    before a row is made. Items that meet no other have no row.
    """

    def work(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        of_a = Primitives(a)
        of_b = of_a if a is b else Primitives(b)
        shared_a, shared_b, n_a, n_b = (np.zeros(n) for n in (a.num_rows, b.num_rows) * 2)
        for i, j in meeting_pairs(a, b):
            shared = shared_volumes(of_a, of_b, i, j, depth)
            for k, total, n in ((i, shared_a, n_a), (j, shared_b, n_b)):
                total += np.bincount(k, shared, len(total))
                n += np.bincount(k, minlength=len(n))
        return summed(a, b, shared_a, shared_b, n_a > 0, n_b > 0, "shared")

    found = in_cubes(with_bounds(items), bins, work, "set_id long, id long, shared double", ["kind", *_DESCRIBED])
    return found.groupBy("set_id", "id").agg(F.sum("shared").alias("shared"))
