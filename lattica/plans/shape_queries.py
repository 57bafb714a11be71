"""Queries over functions, distances of particles, hulls, and diffusion against dense elimination in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import diffusion, elementwise, particles, sdf, segment, surface
from ..volumes import LARGE, SMALL, XYZ, large_mask, large_volume, small_bricks, small_masks, table, to_voxels
from ..volumes import particles as part_spheres
from . import actions
from .oracle import CCL, EV, LV, PT, VERTICES, areas
from .oracle import diffusion as diffusion_sql
from .registry import query, rounded

# Functions.

_LOW, _HIGH = (0.25, 0.25, 0.25), (0.5, 0.5, 0.5)
_STRETCH = (3, 5, 7)
_BOXES = f"{PT}, bx AS (SELECT id, " + ", ".join(f"p{a} - r AS min_{a}, p{a} + r * (1 + id % {n}) AS max_{a}" for a, n in zip(XYZ, _STRETCH)) + " FROM pt)"
_EXTENT = {a: f"(max_{a} - min_{a})" for a in XYZ}


@query(f"WITH {_BOXES} SELECT id, " + " AND ".join(f"min_{a} <= 0.5 AND max_{a} >= 0.25" for a in XYZ) + " AS meets, " + " AND ".join(f"min_{a} >= 0.25 AND max_{a} <= 0.5" for a in XYZ) + " AS inside, round("
       + " * ".join(_EXTENT.values()) + ", 6) AS volume, round((min_x + max_x) / 2, 6) + 0.0 AS centre, round(greatest(0.25 - min_y, 0) - greatest(max_y - 0.5, 0), 6) + 0.0 AS push, "
       + f"CASE WHEN {_EXTENT['x']} >= {_EXTENT['y']} AND {_EXTENT['x']} >= {_EXTENT['z']} THEN 0 WHEN {_EXTENT['y']} >= {_EXTENT['z']} THEN 1 ELSE 2 END AS longest FROM bx")
def box_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [(F.col(f"p{a}") - F.col("r")).alias(f"min_{a}") for a in XYZ] + [(F.col(f"p{a}") + F.col("r") * (1 + F.col("id") % n)).alias(f"max_{a}") for a, n in zip(XYZ, _STRETCH)]
    items = part_spheres(spark, sf_dir).select("id", *ends)
    low, high = (scalars.vector(*[f"{m}_{a}" for a in XYZ]) for m in ("min", "max"))
    box = scalars.vector(*_LOW), scalars.vector(*_HIGH)
    made = items.select(
        "id", scalars.box_meets(low, high, *box).alias("meets"), scalars.box_contains(*box, low, high).alias("inside"), scalars.box_volume(low, high).alias("volume"),
        scalars.box_centre(low, high)[0].alias("centre"), scalars.push_inside(low, high, *box)[1].alias("push"), particles.largest_axis().alias("longest"),
    )
    return rounded(made, "volume", "centre", "push")


_SIDE = "SELECT id, r, px, py, pz, py - px AS ux, pz - py AS uy, px - pz AS uz, r - px AS wx, -py AS wy, 1 - pz AS wz FROM pt"


@query(f"WITH {PT}, s AS ({_SIDE}), c AS (SELECT *, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz FROM s), l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM c) "
       "SELECT id, round(l / 2, 6) AS area, " + ", ".join(f"CASE WHEN l > 0 THEN round(n{a} / l, 6) + 0.0 END AS n{a}" for a in XYZ)
       + ", round(px - 2 * (px + 2 * py) / 5, 6) + 0.0 AS bounced, round(1 / sqrt(r), 6) AS inverse_root, round(4 / 3::DOUBLE * pi() * r * r * r, 9) AS ball FROM l")
def triangle_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = scalars.vector("px", "py", "pz"), scalars.vector("py", "pz", "px"), scalars.vector("r", 0.0, 1.0)
    root5 = 5**0.5
    bounced = scalars.reflect(a, scalars.vector(1 / root5, 2 / root5, 0.0))
    normal = scalars.triangle_normal(a, b, c)
    made = part_spheres(spark, sf_dir).select(
        "id", scalars.triangle_area(a, b, c).alias("area"), *[n.alias(f"n{k}") for n, k in zip(normal, XYZ)], bounced[0].alias("bounced"), scalars.rsqrt(F.col("r")).alias("inverse_root"), scalars.sphere_volume(F.col("r")).alias("ball")
    )
    return rounded(rounded(made, "area", "nx", "ny", "nz", "bounced", "inverse_root"), "ball", digits=9)


@query(f"WITH {PT} SELECT id, " + ", ".join(f"round(least(1, greatest(0, 1.5 - abs(4 * px - {k}))), 6) + 0.0 AS {c}" for c, k in (("red", 3), ("green", 2), ("blue", 1))) + " FROM pt")
def jet_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = part_spheres(spark, sf_dir).select("id", *[c.alias(n) for c, n in zip(scalars.jet(F.col("px")), ("red", "green", "blue"))])
    return rounded(made, "red", "green", "blue")


@query("SELECT c_custkey, array_to_string(list_filter(string_split(c_name, '#'), lambda x: x <> ''), '|') AS parts, 'customer ' || c_custkey || ' of ' || c_nationkey || '.' AS filled FROM customer")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.array_join(scalars.explode_text(F.col("c_name"), "#"), "|").alias("parts"), scalars.fill_in("customer % of %.", F.col("c_custkey"), F.col("c_nationkey")).alias("filled"))


@query(f"WITH {LV} SELECT volume_id, x, y, z, trunc(v / 3)::INT AS v FROM lv")
def cast_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.cast_volume(large_volume(spark, sf_dir).withColumn("v", F.col("v") / 3), "int")


@query("SELECT solver, bytes, 64 * n * bytes AS needed FROM (VALUES ('CG', 8, 4), ('CG', 4, 4), ('BICGSTAB', 8, 9), ('BICGSTAB', 4, 9)) t(solver, bytes, n)")
def solver_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, np.dtype(k).itemsize, diffusion.memory_needed(64, s, k)) for s in ("CG", "BICGSTAB") for k in (np.float64, np.float32)]
    return spark.createDataFrame(rows, "solver string, bytes int, needed int")


@query(f"WITH {LV}, s AS (SELECT y, z, count(*) AS n FROM (SELECT *, lag(v) OVER (PARTITION BY y, z ORDER BY x) AS before FROM lvm) WHERE v <> 255 AND before IS DISTINCT FROM v GROUP BY y, z) SELECT 0::BIGINT AS volume_id, max(n) AS most, sum(n)::BIGINT AS total FROM s")
def spans_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.most_spans(segment.spans(large_mask(spark, sf_dir)))


# Distances, hulls.


def _ellipsoids(spark: SparkSession, sf_dir: str, sets, size) -> DataFrame:
    """The parts as ellipsoids in [-1, 1]**3."""
    items = part_spheres(spark, sf_dir)
    return items.select(
        sets.cast("long").alias("set_id"), "id", *[(2 * F.col(f"p{a}") - 1).alias(f"p{a}") for a in XYZ], *[F.lit(v).alias(f"q{a}") for a, v in zip("xyzw", (0.0, 0.0, 0.0, 1.0))], *[(size * k).alias(f"s{a}") for a, k in zip(XYZ, (1, 2, 1))]
    )


def _inside(n: int, size: str) -> str:
    """Whether the centre of a voxel of n to a side is in a part's ellipsoid."""
    at = {a: f"((g.{a} + 0.5) * {2 / n}::DOUBLE - 2 * pt.p{a})" for a in XYZ}
    return f"(({at['x']} / ({size})) ** 2 + ({at['y']} / (2 * ({size}))) ** 2 + ({at['z']} / ({size})) ** 2 < 1)"


def _voxels(n: int) -> str:
    return f"g AS (SELECT (i % {n})::INT AS x, ((i // {n}) % {n})::INT AS y, (i // {n * n})::INT AS z FROM range(0, {n**3}) t(i))"


@query(f"WITH {PT}, {_voxels(16)} SELECT id % 16 AS volume_id, x, y, z, max(CASE WHEN {_inside(16, '4 * r')} THEN 255 ELSE 0 END)::DOUBLE AS v FROM pt, g GROUP BY ALL")
def sdf_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_voxels(sdf.rasterize_sets(_ellipsoids(spark, sf_dir, F.col("id") % 16, 4 * F.col("r")), (16, 16, 16)))


@query(f"WITH {PT}, {_voxels(8)}, i AS (SELECT id // 4 AS set_id, x, y, z, bool_or({_inside(8, '0.5 + r')}) AS one, bool_and({_inside(8, '0.5 + r')}) AS every FROM pt, g GROUP BY ALL) "
       "SELECT set_id::BIGINT AS set_id, count(*) FILTER (WHERE one) AS in_union, count(*) FILTER (WHERE every) AS in_all, count(*) FILTER (WHERE NOT one) AS in_void FROM i GROUP BY ALL")  # fmt: skip
def sdf_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sdf.count_sets(_ellipsoids(spark, sf_dir, F.floor(F.col("id") / 4), 0.5 + F.col("r")), (8, 8, 8))


_SHARED = " * ".join(f"greatest(0, least(a.p{c} + a.r, b.p{c} + b.r) - greatest(a.p{c} - a.r, b.p{c} - b.r))" for c in XYZ)
_MEET = " AND ".join(f"a.p{c} - a.r <= b.p{c} + b.r AND b.p{c} - b.r <= a.p{c} + a.r" for c in XYZ)


@query(f"WITH {PT} SELECT 0::BIGINT AS set_id, a.id, round(sum({_SHARED}), 9) AS shared FROM pt a JOIN pt b ON a.id <> b.id AND {_MEET} GROUP BY a.id")
def overlap_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part, as a cube, shares with others: for cubes along the axes the octree is exact."""
    items = part_spheres(spark, sf_dir).select("set_id", "id", F.lit("box").alias("kind"), *[f"p{a}" for a in XYZ], *[F.lit(v).alias(f"q{a}") for a, v in zip("xyzw", (0.0, 0.0, 0.0, 1.0))], *[F.col("r").alias(f"s{a}") for a in XYZ])
    return rounded(sdf.overlap_volumes(items, 0.11), "shared", digits=9)


@query(f"WITH {PT}, {_voxels(16)}, i AS (SELECT id % 16 AS set_id, x, y, z, bool_or(" + " AND ".join(f"abs((g.{a} + 0.5) / 8 - 2 * p{a}) < 4 * r" for a in XYZ) + ") AS held FROM pt, g GROUP BY ALL) "
       "SELECT set_id::BIGINT AS set_id, round(count(*) FILTER (WHERE held) / 512::DOUBLE, 6) AS volume, round(1 - count(*) FILTER (WHERE held) / 4096::DOUBLE, 6) + 0.0 AS porosity FROM i GROUP BY ALL")  # fmt: skip
def set_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes in 4**3 boxes of octrees of depth 2: as many cells of the last level as have their centre inside."""
    items = _ellipsoids(spark, sf_dir, F.col("id") % 16, 4 * F.col("r")).withColumn("kind", F.lit("box")).withColumn("sy", F.col("sx"))
    return rounded(sdf.total_volumes(items, 2, 4), "volume", "porosity")


@query("""SELECT s AS schedule, k::INT AS step, round(CASE s WHEN 'linear' THEN 1 - k / 50.0::DOUBLE WHEN 'quadratic' THEN (1 - k / 50.0::DOUBLE) ** 2 WHEN 'exp' THEN exp(-5 * k / 50.0::DOUBLE) ELSE 2 * 0.9::DOUBLE ** k END, 9) + 0.0 AS heat,
    round(CASE WHEN s = 'linear' AND k = 50 OR s = 'quadratic' AND k = 50 THEN 0 ELSE exp(-0.5 / CASE s WHEN 'linear' THEN 1 - k / 50.0::DOUBLE WHEN 'quadratic' THEN (1 - k / 50.0::DOUBLE) ** 2 WHEN 'exp' THEN exp(-5 * k / 50.0::DOUBLE) ELSE 2 * 0.9::DOUBLE ** k END) END, 6) AS chance
    FROM (VALUES ('linear'), ('quadratic'), ('exp'), ('geometric')) t(s), range(0, 51) r(k)""")
def cooling_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature at each of 50 steps, and the probability of taking a state that is worse by a half."""
    rows = []
    for name in ("linear", "quadratic", "exp", "geometric"):
        for k in range(51):
            heat = sdf.geometric(2.0, 0.9, k) if name == "geometric" else sdf.temperature(name, k, 50)
            rows.append((name, k, heat, sdf.accept(1.0, 1.5, heat)))
    return rounded(rounded(spark.createDataFrame(rows, "schedule string, step int, heat double, chance double"), "heat", digits=9), "chance")


def _corners():
    """Of a cube around each part."""
    signs = [(x, y, z) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]
    return F.array(*[F.array(*[F.col(f"p{a}") + s * F.col("r") for a, s in zip(XYZ, at)]) for at in signs])


@query(f"WITH {PT}, {_voxels(24)} SELECT DISTINCT 0::BIGINT AS set_id, x, y, z FROM pt, g WHERE " + " AND ".join(f"abs((g.{a} + 0.5) / 24 - p{a}) <= r" for a in XYZ))
def hull_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = part_spheres(spark, sf_dir)
    return particles.rasterize_hulls(items.select("set_id", "id", _corners().alias("points")), (24, 24, 24))


def _tips():
    """Of an octahedron around each part."""
    return F.array(*[F.array(*[F.col(f"p{a}") + (s * F.col("r") if k == axis else 0.0) for k, a in enumerate(XYZ)]) for axis in range(3) for s in (-1, 1)])


@query(f"WITH {PT} SELECT 0::BIGINT AS set_id, a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.id < b.id AND {_MEET} WHERE " + " + ".join(f"abs(a.p{c} - b.p{c})" for c in XYZ) + " <= a.r + b.r")
def convex_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octahedra meet where the sum of the distances along the axes is at most that of their radii."""
    items = part_spheres(spark, sf_dir)
    return particles.convex_collisions(items.select("set_id", "id", _tips().alias("points")), 0.11)


# Diffusion. SQL solves each volume's 64 equations by elimination without pivoting, which the dominant diagonal allows.


def _dense(axis: int, sign: int) -> str:
    """CTEs that end in `solved` (volume_id, x, y, z, c, v, d)."""
    step = {a: 4**k for k, a in enumerate(XYZ)}
    entry = " ".join(f"WHEN j = i {'+' if s == 'p' else '-'} {step[a]} THEN {f'c_{a}{s}'}" for a in XYZ for s in "pn")
    return f"""{diffusion_sql(axis, sign)}, eq AS (
    SELECT volume_id, x + 4 * y + 16 * z AS i, * EXCLUDE (volume_id) FROM sys
), base AS (
    SELECT volume_id, i, list(CASE WHEN j = 64 THEN rhs WHEN j = i THEN c_diag {entry} ELSE 0 END ORDER BY j) AS line FROM eq, range(0, 65) t(j) GROUP BY volume_id, i
), steps AS (
    SELECT volume_id, i, line, 0 AS k FROM base
    UNION ALL
    SELECT volume_id, i, CASE WHEN i = k THEN list_transform(line, lambda e: e / line[k + 1]) WHEN line[k + 1] = 0 THEN line
        ELSE list_transform(list_zip(line, lead_line), lambda e: e[1] - e[2] * line[k + 1] / lead_line[k + 1]) END, k + 1
    FROM (SELECT *, max(CASE WHEN i = k THEN line END) OVER (PARTITION BY volume_id) AS lead_line FROM steps WHERE k < 64)
), solved AS (
    SELECT s.volume_id, e.x, e.y, e.z, line[65] AS c, m.v AS v, d.v AS d FROM steps s JOIN eq e USING (volume_id, i)
    JOIN evm m ON m.volume_id = s.volume_id AND m.x = e.x AND m.y = e.y AND m.z = e.z JOIN d ON d.volume_id = s.volume_id AND d.x = e.x AND d.y = e.y AND d.z = e.z WHERE s.k = 64
)"""


def _tau(axis: int, sign: int, name: str) -> str:
    a = XYZ[axis]
    ahead = f"{'lead' if sign > 0 else 'lag'}(c) OVER (PARTITION BY volume_id, {', '.join(b for b in XYZ if b != a)} ORDER BY {a})"
    return f"""WITH RECURSIVE {_dense(axis, sign)}, f AS (SELECT volume_id, v, {a} AS plane, d * (c - coalesce(ahead, 0)) / CASE WHEN ahead IS NULL THEN 0.5 ELSE 1 END AS flux FROM (SELECT *, {ahead} AS ahead FROM solved))
    SELECT volume_id, '{name}' AS dir, round(avg((v = 0)::INT) / (avg(flux) * 4), 4) AS tau FROM f GROUP BY volume_id"""


def _measured(spark: SparkSession, sf_dir: str, name: str, solver: str) -> DataFrame:
    found = diffusion.tortuosity(small_bricks(spark, sf_dir), [name], solver, 1e-12).select("volume_id", "dir", "tau")
    return rounded(found, "tau", digits=4)


@query(_tau(0, 1, "X_POS"))
def tau_exact_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, "X_POS", "CG")


@query(_tau(1, -1, "Y_NEG"))
def tau_exact_y_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, "Y_NEG", "CG")


@query(_tau(2, 1, "Z_POS"))
def tau_exact_z_bicgstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir, "Z_POS", "BICGSTAB")


def _solved(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return to_voxels(diffusion.concentrations(small_bricks(spark, sf_dir), name, tolerance=1e-12)).withColumnRenamed("v", "c")


@query(f"WITH RECURSIVE {_dense(0, 1)} SELECT volume_id, x, y, z, round(c, 6) + 0.0 AS c FROM solved")
def concentration_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_solved(spark, sf_dir, "X_POS"), "c")


@query(f"WITH RECURSIVE {_dense(0, 1)} SELECT volume_id, y AS u, z AS w, round(c, 6) + 0.0 AS c FROM solved WHERE x = 0")
def concentration_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diffusion.face_slice(_solved(spark, sf_dir, "X_POS"), SMALL, "X_POS"), "c")


@query(f"WITH RECURSIVE {_dense(0, 1)} SELECT volume_id, x AS plane, round(avg(c), 6) + 0.0 AS mean FROM solved GROUP BY ALL")
def concentration_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diffusion.concentration_profile(_solved(spark, sf_dir, "X_POS"), SMALL, "X_POS"), "mean")


# Meshes.


_POINT = ", ".join(f"round(p{a}[e{k} + 1] - 0.5, 9) + 0.0 AS {n}{a}" for k, n in enumerate("abc") for a in XYZ)
_ON = " ".join(f"JOIN v v{n} ON v{n}.volume_id = f.volume_id AND " + " AND ".join(f"v{n}.{a} = f.{n}{a}" for a in XYZ) for n in "abc")


@query(f"""WITH {EV}, {VERTICES}, v AS (SELECT volume_id, x, y, z, row_number() OVER (PARTITION BY volume_id ORDER BY x, y, z) AS vertex FROM summed), f AS (SELECT volume_id, {_POINT} FROM points JOIN tri USING (cubeindex))
    SELECT f.volume_id, va.vertex AS a, vb.vertex AS b, vc.vertex AS c FROM f {_ON}""")
def mc_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, faces = surface.mesh(small_masks(spark, sf_dir), SMALL)
    return faces


_PARTS = "pm AS (SELECT g.volume_id, part, g.x, g.y, g.z, CASE WHEN inner_.here THEN 255 ELSE 0 END AS v FROM g LEFT JOIN inner_ USING (volume_id, part, x, y, z))"


@query(f"""WITH RECURSIVE {CCL}, parts AS (SELECT volume_id, label, CASE WHEN z_pos AND z_neg THEN 'mid' WHEN z_pos THEN 'pos' ELSE 'neg' END AS part FROM allfaces WHERE NOT dir_none AND (z_pos OR z_neg)),
    inner_ AS (SELECT volume_id, part, x + 1 AS x, y + 1 AS y, z + 1 AS z, TRUE AS here FROM ccl JOIN parts USING (volume_id, label)),
    g AS (SELECT vec_id::BIGINT AS volume_id, part, (i % 6)::INT AS x, ((i // 6) % 6)::INT AS y, (i // 36)::INT AS z FROM embeddings, (VALUES ('pos'), ('neg'), ('mid')) t(part), range(0, 216) r(i)),
    {_PARTS}, {areas('pm', 6, 'volume_id, part')} SELECT volume_id, part, count(*) AS faces FROM sides GROUP BY ALL""")
def partition_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = to_voxels(segment.label_bricks(small_bricks(spark, sf_dir))).withColumn("label", F.col("v").cast("long")).drop("v")
    out = None
    for name, (_, faces) in actions.partition_meshes(labels, SMALL, "z").items():
        counted = faces.groupBy("volume_id").agg(F.count("*").alias("faces")).select("volume_id", F.lit(name).alias("part"), "faces")
        out = counted if out is None else out.union(counted)
    return out
