"""Spheres and boxes: generation, rasterization, overlap joins, meshes of templates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import durable
from ..volumes import AXES, XYZ, Dims

SPHERE = "set_id long, id long, px double, py double, pz double, r double"


def place_spheres(n: int, r_min: float, r_max: float, seed: int, within: bool = True, max_tries: int = 0) -> np.ndarray:
    """(n, 4) centres and radii of spheres in the unit cube that don't overlap, or (0, 4) after max_tries rejections in all.

    within: a sphere lies wholly in the cube. Two spheres overlap if their distance is less than
    the sum of their radii. 0 tries: never give up.
    """
    draw, out, tries = np.random.default_rng(seed), np.empty((0, 4)), 0
    while len(out) < n:
        p, r = draw.random(3), draw.uniform(r_min, r_max)
        if within:
            r = min(r, p.min(), (1 - p).min())
        clear = r >= r_min if within else True
        if clear and not (((out[:, :3] - p) ** 2).sum(axis=1) < (out[:, 3] + r) ** 2).any():
            out = np.vstack([out, [*p, r]])
            continue
        tries += 1
        if max_tries and tries >= max_tries:
            return np.empty((0, 4))
    return out


def largest_radius(n: int, seed: int, tolerance: float = 0.001, max_tries: int = 5000, within: bool = True) -> float:
    """The largest radius at which n equal spheres could be placed, by bisection from 0 to 0.5."""
    low, high = 0.0, 0.5
    while high - low > tolerance:
        r = (low + high) / 2
        low, high = (r, high) if len(place_spheres(n, r, r, seed, within, max_tries)) == n else (low, r)
    return low


def most_spheres(r: float, seed: int, max_tries: int = 5000, most: int = 10_000) -> int:
    """How many spheres of a radius could be placed one after the other before max_tries rejections, at most `most`."""
    draw, out, tries = np.random.default_rng(seed), np.empty((0, 3)), 0
    while len(out) < most and tries < max_tries:
        p = draw.uniform(r, 1 - r, 3)
        if (((out - p) ** 2).sum(axis=1) < 4 * r * r).any():
            tries += 1
        else:
            out = np.vstack([out, p])
    return len(out)


def generate_spheres(sets: DataFrame) -> DataFrame:
    """Spheres of each set (set_id, n, r_min, r_max, seed, within, max_tries); a set is placed by one task, in order."""

    def run(parts):
        for part in parts:
            for row in part.to_pylist():
                made = place_spheres(row["n"], row["r_min"], row["r_max"], row["seed"], row["within"], row["max_tries"])
                columns = [pa.array(np.full(len(made), row["set_id"], np.int64)), pa.array(np.arange(len(made)))] + [pa.array(made[:, k]) for k in range(4)]
                yield pa.RecordBatch.from_arrays(columns, names=["set_id", "id", "px", "py", "pz", "r"])

    return sets.select("set_id", "n", "r_min", "r_max", "seed", "within", "max_tries").mapInArrow(run, SPHERE)


def radius_table(counts: DataFrame, seed: int = 1, tolerance: float = 0.001, max_tries: int = 5000) -> DataFrame:
    """(n, radius) for each n of counts (n)."""

    def run(parts):
        for part in parts:
            n = part.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "radius": [largest_radius(k, seed, tolerance, max_tries) for k in n]})

    return counts.select(F.col("n").cast("long")).mapInArrow(run, "n long, radius double")


def rasterize_spheres(spheres: DataFrame, dims: Dims, exact_box: bool = False) -> DataFrame:
    """(set_id, x, y, z) of the voxels whose corner (x, y, z) / dims lies inside a sphere.

    Each sphere makes the voxels of its bounding box only, which is cut to
    int((dims - 1) * p) at either end; exact_box takes all of its voxels instead.
    """
    out = spheres
    for a, d in zip(AXES, dims):
        scale = d if exact_box else d - 1
        low, high = F.col(f"p{a}") - F.col("r"), F.col(f"p{a}") + F.col("r")
        first = F.greatest(F.lit(0), (low * scale).cast("int"))
        last = F.least(F.lit(d - 1), (F.ceil(high * scale) if exact_box else high * scale).cast("int"))
        out = out.withColumn(a, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    distance = sum(((F.col(a) / float(d) - F.col(f"p{a}")) * (F.col(a) / float(d) - F.col(f"p{a}")) for a, d in zip(AXES, dims)), F.lit(0.0))
    return out.where(distance < F.col("r") * F.col("r")).select("set_id", *XYZ).distinct()


def sphere_sums(spheres: DataFrame) -> DataFrame:
    """(set_id, n, surface, volume, tau): sums over the spheres, and (1 - volume) ** -0.5."""
    r = F.col("r")
    out = spheres.groupBy("set_id").agg(F.count("*").alias("n"), F.sum(4 * math.pi * r * r).alias("surface"), F.sum(4 / 3 * math.pi * r * r * r).alias("volume"))
    return out.withColumn("tau", F.when(F.col("volume") < 1, 1 / F.sqrt(1 - F.col("volume"))))


def particles_for(porosity: float, volume: float) -> int:
    """How many particles of a volume leave this porosity in the unit cube."""
    return int((1 - porosity) / volume)


def _ends() -> list[Column]:
    return [(F.col(f"p{a}") - F.col("r")).alias(f"min_{a}") for a in AXES] + [(F.col(f"p{a}") + F.col("r")).alias(f"max_{a}") for a in AXES]


def boxes(spheres: DataFrame) -> DataFrame:
    """(set_id, id, min_x .. max_z) around spheres."""
    return spheres.select("set_id", "id", *_ends())


#: Items of a cube that are compared with as many others at a time; a cube of more is cut into tiles.
TILE = 1 << 13
#: Cubes of fewer items are compared several at a time.
FEW = 256
#: Pairs that are tested at a time, and in a task.
CELLS, TESTS = 1 << 19, 1e8
ENDS = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
_KEYS = ["set_id", *[f"bin_{a}" for a in AXES]]
#: Where one item ends and another begins: low and high ends of a's and of b's rows along a line.
Ends = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def in_cubes(items: DataFrame, bins: float, work: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, more: list[str] | None = None) -> DataFrame:
    """What work(a, b) yields over the items that share cubes of the edge `bins`.

    items: (set_id, id, min_x .. max_z, and the columns `more`); nulls overlap nothing. a and b are
    items of a cube (or of several, by `job`) in the order of their ids. `meeting` finds their pairs:
    over all calls each pair of overlapping boxes comes once, in the cube of the lower corner of its
    overlap. A crowded cube is cut into tiles, whose pairs are dealt like cubes, so that no task
    holds more than two tiles. Only how many tests there are, and the most tiles, reach the driver.
    """
    spark = items.sparkSession
    cut = items.select("set_id", "id", *ENDS, *(more or [])).dropna(subset=["set_id", "id", *ENDS])
    begins = F.lit(0)
    for k, a in enumerate(AXES):
        low, high = F.floor(F.col(f"min_{a}") / bins), F.floor(F.col(f"max_{a}") / bins)
        cut = cut.withColumn(f"bin_{a}", F.explode(F.sequence(low, F.greatest(low, high))))
        begins = begins + F.when(F.col(f"bin_{a}") == low, 1 << k).otherwise(0)
    counts = cut.groupBy(*_KEYS).agg(F.count("*").alias("n"))
    counts = durable(counts.select(*_KEYS, "n", F.ceil(F.col("n") / TILE).alias("tiles")))
    tests, most = counts.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.max("tiles")).first()
    cut = cut.withColumn("begins", begins.cast("byte"))
    if (most or 0) > 1:
        cut = cut.join(counts.where("tiles > 1").select(*_KEYS, "tiles"), _KEYS, "left")
        cut = cut.withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
        with_each = "transform(sequence(0L, tiles - 1), k -> struct(tile AS of_a, k AS of_b))"
        with_others = "transform(filter(sequence(0L, tiles - 1), k -> k <> tile), k -> struct(k AS of_a, tile AS of_b))"
        cut = cut.withColumn("pair", F.explode(F.expr(f"concat({with_each}, {with_others})"))).select("*", "pair.of_a", "pair.of_b").drop("pair", "tiles")
    else:
        cut = cut.select("*", *[F.lit(0).cast("long").alias(c) for c in ("tile", "of_a", "of_b")])
    keys = [*_KEYS, "of_a", "of_b"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, math.ceil((tests or 0) / TESTS)))
    dealt = cut.repartition(tasks, *keys).sortWithinPartitions(*keys, "id")

    def call(held: list[pa.RecordBatch], jobs: list[int], tiles: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).append_column("job", pa.array(np.repeat(jobs, [h.num_rows for h in held])))
        if jobs[0] != jobs[-1]:
            table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
        table = table.combine_chunks()
        if tiles[0] == tiles[1]:
            return work(table, table)
        tile = table.column("tile").to_numpy()
        return work(*(table.filter(pa.array(tile == t)) for t in tiles))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, jobs, rows, last = [], [], 0, None
        for part in parts:
            if not part.num_rows:
                continue
            key = np.stack([part.column(c).to_numpy() for c in keys])
            turns = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
            for first, end in zip(turns, turns[1:]):
                at = tuple(key[:, first].tolist())
                if last and at != last and (rows >= FEW or at[4] != at[5] or last[4] != last[5]):
                    yield from call(held, jobs, last[4:])
                    held, jobs, rows = [], [], 0
                jobs.append((jobs[-1] + (at != last)) if jobs else 0)
                held.append(part.slice(first, end - first))
                rows, last = rows + end - first, at
        if held:
            yield from call(held, jobs, last[4:])

    return dealt.mapInArrow(run, schema)


def meeting(a: pa.Table, b: pa.Table, lines: list[Ends] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of a, first row of b, mask): the pairs a.id < b.id that overlap along the axes and `lines`, some rows of a at a time.

    a and b are as in_cubes hands them out. Ends are compared by their ranks, in two bytes rather than eight.
    """
    column = lambda t, c: t.column(c).to_numpy()
    ids, others, n = column(a, "id"), column(b, "id"), b.num_rows
    kind = np.int16 if a.num_rows + n < 1 << 15 else np.int32
    ranks = []
    for low, high, other_low, other_high in [*([column(t, f"{m}_{c}") for t in (a, b) for m in ("min", "max")] for c in AXES), *(lines or [])]:
        for ends, side in ((low, "a"), (other_low, "b")):
            order = np.sort(ends)
            rank, reach = (np.searchsorted(order, v, s).astype(kind) for v, s in ((ends, "left"), (other_high if side == "a" else high, "right")))
            ranks.append((rank, reach) if side == "a" else (reach, rank))
    begins, other_begins = column(a, "begins").view(np.uint8), column(b, "begins").view(np.uint8)
    job, other_job = column(a, "job"), column(b, "job")
    several = len(job) > 0 and n > 0 and (job.min() != job.max() or other_job.min() != other_job.max())
    after, place = np.searchsorted(others, ids, "right").astype(kind), np.arange(n, dtype=kind)
    step = max(1, CELLS // max(1, n))
    for first in range(0, a.num_rows, step):
        rows, start = slice(first, first + step), int(after[first])
        if start == n:
            break
        mask = (begins[rows, None] | other_begins[start:]) == 7
        for k, (x, y) in enumerate(ranks):
            mask &= x[rows, None] < y[start:] if k % 2 == 0 else y[start:] < x[rows, None]
        mask &= place[start:] >= after[rows, None]
        if several:
            mask &= job[rows, None] == other_job[start:]
        yield first, start, mask


def meeting_pairs(a: pa.Table, b: pa.Table, lines: list[Ends] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows (of a, of b) of meeting's pairs, rising in a."""
    for first, start, mask in meeting(a, b, lines):
        flat, width = np.flatnonzero(mask), mask.shape[1]
        if len(flat):
            i = flat // width
            yield i + first, flat - i * width + start


def overlapping(items: DataFrame, bins: float, test: Callable[[pa.Table, pa.Table], tuple[list[Ends], Callable[[np.ndarray, np.ndarray], np.ndarray] | None]] | None = None, more: list[str] | None = None) -> DataFrame:
    """Pairs (set_id, a, b), a < b, of items whose boxes overlap.

    items: (set_id, id, min_x .. max_z, and the columns `more`), met in cubes as in_cubes has it.
    test(a, b): further lines along which a pair must overlap, and a function from rows of a and
    of b to which of these pairs are kept.
    """

    def work(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        lines, keep = test(a, b) if test else ([], None)
        for i, j in meeting_pairs(a, b, lines):
            if keep is not None:
                kept = keep(i, j)
                i, j = i[kept], j[kept]
            if not len(i):
                continue
            turns = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1])
            rows = pa.array(i[turns])
            lists = pa.ListArray.from_arrays(pa.array(np.append(turns, len(i)), pa.int32()), b.column("id").combine_chunks().take(pa.array(j)))
            yield pa.RecordBatch.from_arrays([a.column("set_id").combine_chunks().take(rows), a.column("id").combine_chunks().take(rows), lists], names=["set_id", "a", "b"])

    return in_cubes(items, bins, work, "set_id long, a long, b array<long>", more).select("set_id", "a", F.explode("b").alias("b"))


def summed(a: pa.Table, b: pa.Table, of_a: np.ndarray, of_b: np.ndarray, met_a: np.ndarray, met_b: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """(set_id, id, name) of those rows of a and b that met others."""
    for t, v, met in ((a, of_a, met_a), (b, of_b, met_b)):
        rows = pa.array(np.flatnonzero(met))
        if len(rows):
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks().take(rows) for c in ("set_id", "id")), pa.array(v[met], pa.float64())], names=["set_id", "id", name])


def overlap_counts(items: DataFrame, bins: float) -> DataFrame:
    """(set_id, id, overlap): how many others' boxes each item's box overlaps, for those that overlap any.

    items: (set_id, id, min_x .. max_z). Each task counts its own pairs; none is made a row.
    """

    def work(a: pa.Table, b: pa.Table) -> Iterator[pa.RecordBatch]:
        of_a, of_b = np.zeros(a.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for first, start, mask in meeting(a, b):
            of_a[first : first + len(mask)] += mask.sum(axis=1)
            of_b[start:] += mask.sum(axis=0)
        return summed(a, b, of_a, of_b, of_a > 0, of_b > 0, "overlap")

    return in_cubes(items, bins, work, "set_id long, id long, overlap double").groupBy("set_id", "id").agg(F.sum("overlap").alias("overlap"))


def sphere_collisions(spheres: DataFrame, bins: float) -> DataFrame:
    """Pairs of spheres whose distance is less than the sum of their radii."""

    def test(a: pa.Table, b: pa.Table):
        (p, r), (q, s) = ((np.stack([t.column(f"p{c}").to_numpy() for c in AXES]), t.column("r").to_numpy()) for t in (a, b))

        def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x, y, z = (p[k, i] - q[k, j] for k in range(3))
            reach = r[i] + s[j]
            return x * x + y * y + z * z < reach * reach

        return [], close

    return overlapping(spheres.select("*", *_ends()), bins, test, ["px", "py", "pz", "r"])


def keep_in_box(items: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Items whose boxes meet a box."""
    for a, l, h in zip(AXES, low, high):
        items = items.where((F.col(f"min_{a}") <= h) & (F.col(f"max_{a}") >= l))
    return items


def bounds(items: DataFrame, by: str = "set_id") -> DataFrame:
    """The union of the boxes of each set."""
    return items.groupBy(by).agg(*[F.min(f"min_{a}").alias(f"min_{a}") for a in AXES], *[F.max(f"max_{a}").alias(f"max_{a}") for a in AXES])


def largest_axis() -> Column:
    """The axis along which the box min_* .. max_* is longest, the first of equals."""
    extent = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES]
    return F.when((extent[0] >= extent[1]) & (extent[0] >= extent[2]), 0).when(extent[1] >= extent[2], 1).otherwise(2)


def separated(a: np.ndarray, b: np.ndarray, faces_a: np.ndarray, faces_b: np.ndarray) -> bool:
    """Whether an axis parts two convex meshes: vertices (n, 3) and triangles (m, 3) of each."""
    def normals(v: np.ndarray, f: np.ndarray) -> np.ndarray:
        return np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])

    def edges(v: np.ndarray, f: np.ndarray) -> np.ndarray:
        pairs = np.unique(np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=1), axis=0)
        return v[pairs[:, 1]] - v[pairs[:, 0]]

    ea, eb = edges(a, faces_a), edges(b, faces_b)
    axes = np.concatenate([normals(a, faces_a), normals(b, faces_b), np.cross(ea[:, None], eb[None]).reshape(-1, 3)])
    axes = axes[(axes * axes).sum(axis=1) > 1e-18]
    pa_, pb = a @ axes.T, b @ axes.T
    return bool(((pa_.max(axis=0) < pb.min(axis=0)) | (pb.max(axis=0) < pa_.min(axis=0))).any())


def sphere_mesh(spark: SparkSession, radius: float, polar: int, azimuth: int) -> DataFrame:
    """(triangle, corner, x, y, z): a sphere of 2 * polar * azimuth triangles by latitude and longitude."""
    cells = spark.range(polar).select(F.col("id").alias("i")).crossJoin(spark.range(azimuth).select(F.col("id").alias("j")))
    corners = ((0, 0), (1, 0), (1, 1), (0, 0), (1, 1), (0, 1))
    at = F.array(*[F.struct(F.lit(k // 3).alias("half"), F.lit(k % 3).alias("corner"), (F.col("i") + p).alias("p"), (F.col("j") + q).alias("q")) for k, (p, q) in enumerate(corners)])
    points = cells.select("i", "j", F.explode(at).alias("c"))
    theta, phi = math.pi * F.col("c.p") / polar, 2 * math.pi * F.col("c.q") / azimuth
    number = ((F.col("i") * azimuth + F.col("j")) * 2 + F.col("c.half")).alias("triangle")
    return points.select(number, F.col("c.corner").alias("corner"), (radius * F.sin(theta) * F.cos(phi)).alias("x"), (radius * F.sin(theta) * F.sin(phi)).alias("y"), (radius * F.cos(theta)).alias("z"))


def poisson_disk(radius: float, n: int, seed: int, low=(0.0, 0.0, 0.0), high=(1.0, 1.0, 1.0), tries: int = 30) -> np.ndarray:
    """n points at least `radius` apart as far as they fit (Bridson's sampler on a grid), topped up evenly at random."""
    draw, low, high = np.random.default_rng(seed), np.asarray(low, float), np.asarray(high, float)
    cell = radius / math.sqrt(3)
    shape = np.maximum(1, np.ceil((high - low) / cell).astype(int))
    grid = np.full(shape, -1)
    points = [draw.uniform(low, high)]
    place = lambda p: tuple(np.minimum(((p - low) / cell).astype(int), shape - 1))
    grid[place(points[0])] = 0
    active = [0]
    while active and len(points) < n:
        k = int(draw.integers(len(active)))
        for _ in range(tries):
            way = draw.normal(size=3)
            p = points[active[k]] + way / np.linalg.norm(way) * radius * (1 + draw.random())
            if (p < low).any() or (p >= high).any():
                continue
            c = place(p)
            near = grid[tuple(slice(max(0, x - 2), x + 3) for x in c)].ravel()
            if all(np.linalg.norm(points[q] - p) >= radius for q in near[near >= 0]):
                grid[c] = len(points)
                active.append(len(points))
                points.append(p)
                break
        else:
            active.pop(k)
    points += [draw.uniform(low, high) for _ in range(n - len(points))]
    return np.array(points[:n])


def weighted_pick(items: DataFrame, by: str, weight: str, order: str, draws: DataFrame) -> DataFrame:
    """(draw, by, item): for each draw (draw, by, u) the first item whose running share of the weights reaches u."""
    line = Window.partitionBy(by).orderBy(weight, order)
    whole = Window.partitionBy(by)
    share = F.sum(weight).over(line.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(whole)
    before = share - F.col(weight) / F.sum(weight).over(whole)
    ranges = items.select(by, F.col(order).alias("item"), share.alias("share"), F.row_number().over(line).alias("nth"))
    hits = draws.join(ranges, by).where(F.col("share") >= F.col("u") - 1e-12)
    return hits.groupBy("draw", by).agg(F.min_by("item", "nth").alias("item"))


def largest_overlap(overlaps: DataFrame, by: str = "set_id", id_col: str = "id", value: str = "overlap") -> DataFrame:
    """(by, id, overlap) of each set's most overlapped particle, the smaller id of equals."""
    return overlaps.groupBy(by).agg(F.max_by(id_col, F.struct(F.col(value), -F.col(id_col))).alias(id_col), F.max(value).alias(value))


def convex_hull(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, triangles) of the hull of points in space, outward counter-clockwise, grown point by point."""
    points = np.unique(np.asarray(points, float), axis=0)
    scale = max(1e-300, float(np.abs(points - points.mean(axis=0)).max()))
    eps = 1e-10 * scale
    a = 0
    b = int(np.argmax(((points - points[a]) ** 2).sum(axis=1)))
    off = np.cross(points - points[a], points[b] - points[a])
    c = int(np.argmax((off**2).sum(axis=1)))
    normal = np.cross(points[b] - points[a], points[c] - points[a])
    height = (points - points[a]) @ normal
    d = int(np.argmax(np.abs(height)))
    if abs(height[d]) <= eps * max(1e-300, float(np.linalg.norm(normal))):
        raise ValueError("the points lie in a plane")
    faces = [(a, b, c), (a, c, d), (a, d, b), (b, d, c)]
    if height[d] > 0:
        faces = [f[::-1] for f in faces]

    def over(face: tuple[int, int, int], p: np.ndarray) -> float:
        n = np.cross(points[face[1]] - points[face[0]], points[face[2]] - points[face[0]])
        return float((p - points[face[0]]) @ n) / max(1e-300, float(np.linalg.norm(n)))

    for k in range(len(points)):
        if k in (a, b, c, d):
            continue
        seen = [f for f in faces if over(f, points[k]) > eps]
        if not seen:
            continue
        rim = {(f[i], f[(i + 1) % 3]) for f in seen for i in range(3)}
        faces = [f for f in faces if f not in seen] + [(u, v, k) for u, v in rim if (v, u) not in rim]
    used = sorted({v for f in faces for v in f})
    number = {v: i for i, v in enumerate(used)}
    return points[used], np.array([[number[v] for v in f] for f in faces])


def rasterize_hulls(instances: DataFrame, dims: Dims) -> DataFrame:
    """(set_id, x, y, z) of the voxels whose centre lies in an instance's convex hull.

    instances: (set_id, id, points array<array<double>>), points in the unit cube. Each instance makes
    the voxels of its bounding box only.
    """

    def run(parts):
        for part in parts:
            for row in part.to_pylist():
                v, f = convex_hull(np.array(row["points"]))
                low = np.maximum(0, np.floor(v.min(axis=0) * dims - 0.5)).astype(int)
                high = np.minimum(np.array(dims) - 1, np.ceil(v.max(axis=0) * dims)).astype(int)
                if (high < low).any():
                    continue
                x, y, z = (g.ravel() for g in np.meshgrid(*[np.arange(l, h + 1) for l, h in zip(low, high)], indexing="ij"))
                centre = (np.stack([x, y, z], axis=1) + 0.5) / np.array(dims)
                normals = np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])
                inside = (centre @ normals.T <= (v[f[:, 0]] * normals).sum(axis=1) + 1e-12).all(axis=1)
                columns = [pa.array(np.full(inside.sum(), row["set_id"], np.int64))] + [pa.array(c[inside].astype(np.int32)) for c in (x, y, z)]
                yield pa.RecordBatch.from_arrays(columns, names=["set_id", *XYZ])

    return instances.select("set_id", "id", "points").mapInArrow(run, "set_id long, x int, y int, z int").distinct()


#: How many hulls are made point by point in order to share their faces with like ones, before the others are made each on its own.
SHAPES = 16
#: Lines besides the axes along which convex items are compared before any other: the diagonals of space.
DIAGONALS = np.array([[1.0, 1, 1], [1, 1, -1], [1, -1, 1], [-1, 1, 1]])


class Hulls:
    """The convex hulls of many items, to be compared by pairs of row numbers.

    points (n, p, 3); normals (n, f, 3) of faces, of length one, and their offsets (n, f); edges
    (n, e, 3), directions of length one; centre (n, 3) and size (n). Items of fewer points, faces or
    edges repeat one of them. Items of one shape share its triangles: those of the first are taken
    for others whose points all lie behind them.
    """

    def __init__(self, points: pa.Array):
        """points: of each item x, y, z of one point after the other."""
        lengths = points.value_lengths().to_numpy() // 3
        flat, begins, n = points.flatten().to_numpy().reshape(-1, 3), np.cumsum(lengths) - lengths, len(lengths)
        most = int(lengths.max(initial=1))
        held = np.minimum(np.arange(most), lengths[:, None] - 1)
        self.points = flat[begins[:, None] + held] if n else np.empty((0, most, 3))
        shapes: list[tuple[np.ndarray, np.ndarray]] = []
        of = np.zeros(n, np.int64)
        left = np.arange(n)
        while len(left):
            faces, edges = self._triangles(self.points[left[0]])
            fits = np.zeros(len(left), bool)
            if len(shapes) < SHAPES:
                fits = self._behind(self.points[left], faces)
            fits[0] = True
            of[left[fits]] = len(shapes)
            shapes.append((faces, edges))
            left = left[~fits]
        f, e = (max((len(s[k]) for s in shapes), default=1) for k in (0, 1))
        faces = np.array([s[0][np.minimum(np.arange(f), len(s[0]) - 1)] for s in shapes]).reshape(-1, f, 3)[of]
        edges = np.array([s[1][np.minimum(np.arange(e), len(s[1]) - 1)] for s in shapes]).reshape(-1, e, 2)[of]
        row = np.arange(n)[:, None]
        a, b, c = (self.points[row, faces[:, :, k]] for k in range(3))
        self.normals = _unit(np.cross(b - a, c - a))
        self.offsets = np.einsum("nfk,npk->nfp", self.normals, self.points).max(axis=2, initial=-np.inf)
        self.edges = _unit(self.points[row, edges[:, :, 1]] - self.points[row, edges[:, :, 0]])
        self.centre = self.points.mean(axis=1)
        self.size = (self.points.max(axis=1, initial=-np.inf) - self.points.min(axis=1, initial=np.inf)).sum(axis=1)

    @staticmethod
    def _triangles(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Triangles and edges of one hull, by the numbers of its points."""
        v, f = convex_hull(points)
        number = np.array([int(np.flatnonzero((points == p).all(axis=1))[0]) for p in v])
        faces = number[f]
        return faces, np.unique(np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1), axis=0)

    @staticmethod
    def _behind(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
        """For which items all points lie behind these faces, none of which is flat with them."""
        a, b, c = (points[:, faces[:, k]] for k in range(3))
        normals = _unit(np.cross(b - a, c - a))
        above = np.einsum("nfk,npk->nfp", normals, points) - (normals * a).sum(axis=2)[:, :, None]
        eps = 1e-10 * np.abs(points - points.mean(axis=1, keepdims=True)).max(axis=(1, 2))[:, None]
        return ((above.max(axis=2) <= eps) & (above.min(axis=2) < -eps)).all(axis=1)

    def ends(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.points @ line
        return at.min(axis=1, initial=np.inf), at.max(axis=1, initial=-np.inf)

    def holds(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each row's hull holds its point."""
        return (np.einsum("mfk,mk->mf", self.normals[rows], at) <= self.offsets[rows]).all(axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def hulls_meet(a: Hulls, b: Hulls, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether hulls i of a and j of b meet, pair by pair.

    The point that divides the line between their centres by their sizes settles the pairs whose
    hulls both hold it; separating axes (normals, and products of edges) decide the others.
    """
    met = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 13):
        x, y = i[k : k + (1 << 13)], j[k : k + (1 << 13)]
        whole = a.size[x] + b.size[y]
        at = (a.centre[x] * b.size[y][:, None] + b.centre[y] * a.size[x][:, None]) / whole[:, None]
        met[k : k + (1 << 13)] = a.holds(x, at) & b.holds(y, at)
    left = np.flatnonzero(~met)
    step = max(1, (1 << 21) // max(1, a.edges.shape[1] * b.edges.shape[1] * (a.points.shape[1] + b.points.shape[1])))
    for k in range(0, len(left), step):
        x, y = i[left[k : k + step]], j[left[k : k + step]]
        products = np.cross(a.edges[x][:, :, None], b.edges[y][:, None]).reshape(len(x), -1, 3)
        axes = np.concatenate([a.normals[x], b.normals[y], products], axis=1)
        p, q = (np.einsum("mpk,mak->map", h.points[rows], axes) for h, rows in ((a, x), (b, y)))
        parted = (p.max(axis=2) < q.min(axis=2)) | (q.max(axis=2) < p.min(axis=2))
        met[left[k : k + step]] = ~(parted & ((axes * axes).sum(axis=2) > 1e-18)).any(axis=1)
    return met


def convex_collisions(items: DataFrame, bins: float) -> DataFrame:
    """Pairs (set_id, a, b) of convex items that meet, by separating axes for the pairs whose boxes do.

    items: (set_id, id, points array<array<double>>); one with a null among its points meets
    nothing. Pairs meet in cubes of the edge `bins`, as in_cubes has it; only those that overlap
    along the diagonals too are looked at one by one, many at a time.
    """
    flat = F.flatten("points")
    ends = [pick(F.transform("points", lambda p: p[k])).alias(f"{m}_{a}") for m, pick in (("min", F.array_min), ("max", F.array_max)) for k, a in enumerate(AXES)]  # noqa: B023
    held = items.where(~F.exists(flat, lambda c: c.isNull())).select("set_id", "id", *ends, flat.alias("points"))

    def test(a: pa.Table, b: pa.Table):
        of_a = Hulls(a.column("points").combine_chunks())
        of_b = of_a if a is b else Hulls(b.column("points").combine_chunks())
        return [(*of_a.ends(d), *of_b.ends(d)) for d in DIAGONALS], lambda i, j: hulls_meet(of_a, of_b, i, j)

    return overlapping(held, bins, test, ["points"])
