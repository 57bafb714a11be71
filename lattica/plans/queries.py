"""One query for each operator over the volumes that the star schema's tables hold, with its SQL."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import diffusion, elementwise, particles, reduce, reshape, sdf, segment, stencil, surface
from ..volumes import KEY, LARGE, SMALL, XYZ, directions, from_linear, large_mask, large_volume, linear_index, small_bricks, small_masks, small_volumes, table, to_bricks, to_voxels
from ..volumes import particles as part_spheres
from . import actions
from .oracle import CCL, EV, LV, PT, VERTICES, areas, cells, neighbour_columns
from .oracle import diffusion as diffusion_sql
from .registry import ORACLE_SQL, QUERIES, query, rounded

AXIS_DIRS = ["X_POS", "Y_POS", "Z_POS"]


def shifted(vox: DataFrame, by: int = 1) -> DataFrame:
    """Each volume under the id of the one `by` before it."""
    return vox.withColumn("volume_id", F.col("volume_id") - by)


# Scans and the data model.


@query(f"WITH {EV} SELECT volume_id, x, y, z, round(v, 6) + 0.0 AS v FROM ev")
def volume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(small_volumes(spark, sf_dir), "v")


@query(f"WITH {LV} SELECT volume_id, x, y, z, v FROM lv")
def count_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return large_volume(spark, sf_dir)


@query(f"WITH {EV} SELECT volume_id, x, y, z, v::DOUBLE AS v FROM evm")
def brick_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_voxels(small_bricks(spark, sf_dir))


@query(f"WITH {EV} SELECT volume_id, (x + 4 * y + 16 * z)::BIGINT AS linear, x, y, z FROM ev")
def linear_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = small_volumes(spark, sf_dir).withColumn("linear", linear_index(SMALL))
    return at.select("volume_id", "linear", *from_linear("linear", SMALL))


@query("""SELECT * FROM (VALUES (0, 'X_POS', 0, 1, 1, 0, 0), (1, 'X_NEG', 0, -1, -1, 0, 0), (2, 'Y_POS', 1, 1, 0, 1, 0), (3, 'Y_NEG', 1, -1, 0, -1, 0),
    (4, 'Z_POS', 2, 1, 0, 0, 1), (5, 'Z_NEG', 2, -1, 0, 0, -1), (6, 'DIR_NONE', NULL, 0, 0, 0, 0)) t(dir_id, name, axis, sgn, ox, oy, oz)""")
def direction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directions(spark)


# Reductions.


@query(f"WITH {EV} SELECT volume_id, count(*) FILTER (WHERE v = 0) / count(*)::DOUBLE AS porosity FROM evm GROUP BY ALL")
def porosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.porosity(small_masks(spark, sf_dir))


@query(f"WITH {EV} SELECT volume_id, count(*) FILTER (WHERE v = 0) / count(*)::DOUBLE AS porosity FROM evm GROUP BY ALL")
def porosity_bricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.porosity(small_bricks(spark, sf_dir))


_REDUCED = "volume_id, round(sum(v), 6) + 0.0 AS total, round(min(v), 6) + 0.0 AS least, round(max(v), 6) + 0.0 AS most, round(sum(v * v), 6) AS square_sum, count(*) FILTER (WHERE v = 0) AS zeros, count(*) AS n"


@query(f"WITH {EV} SELECT {_REDUCED} FROM ev GROUP BY volume_id")
def reduce_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce.reduce_all(small_volumes(spark, sf_dir)), "total", "least", "most", "square_sum")


@query(f"WITH {LV} SELECT {_REDUCED} FROM lv WHERE x BETWEEN 4 AND 19 AND y BETWEEN 5 AND 20 AND z BETWEEN 6 AND 30 GROUP BY volume_id")
def reduce_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce.reduce_all(large_volume(spark, sf_dir), (4, 5, 6), (20, 21, 31)), "total", "least", "most", "square_sum")


@query(f"WITH {LV} SELECT volume_id, count(*) FILTER (WHERE v = 0) / count(*)::DOUBLE AS porosity FROM lvm GROUP BY ALL")
def porosity_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.porosity(large_mask(spark, sf_dir))


@query(f"WITH {EV} SELECT volume_id, round(product(CASE WHEN v < 0 THEN -1 ELSE 1 END)) AS product FROM ev GROUP BY ALL")
def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = small_volumes(spark, sf_dir).withColumn("v", F.when(F.col("v") < 0, -1.0).otherwise(1.0))
    return rounded(reduce.product(signs), "product", digits=0)


_PAIR = "FROM ev a JOIN ev b ON b.volume_id = a.volume_id + 1 AND a.x = b.x AND a.y = b.y AND a.z = b.z"
_TRIPLE = f"{_PAIR} JOIN ev c ON c.volume_id = a.volume_id + 2 AND a.x = c.x AND a.y = c.y AND a.z = c.z"
_MASKS = _PAIR.replace("ev ", "evm ")


def _pair_sql(value: str, source: str = _PAIR) -> str:
    return f"WITH {EV} SELECT a.volume_id, a.x, a.y, a.z, {value} AS v {source}"


@query(f"WITH {EV} SELECT a.volume_id, round(sum(a.v * b.v), 6) + 0.0 AS dot {_PAIR} GROUP BY ALL")
def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = small_volumes(spark, sf_dir)
    return rounded(reduce.dot(a, shifted(a)), "dot")


@query(f"WITH {LV} SELECT volume_id, x AS plane, sum(v) AS total FROM lv GROUP BY ALL")
def profile_axis_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.profile(large_volume(spark, sf_dir), LARGE, "X_POS")


@query(f"WITH {LV} SELECT volume_id, (31 - y)::INT AS plane, sum(v) AS total FROM lv GROUP BY ALL")
def profile_axis_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.profile(large_volume(spark, sf_dir), LARGE, "Y_NEG")


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(100 * sum(value) / (SELECT sum(value) FROM events), 4) AS percent FROM events GROUP BY ALL")
def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce.profile_events(table(spark, sf_dir, "events"), "event_type", "value"), "total", "mean", "percent", digits=4)


# Maps.


@query(f"WITH {LV} SELECT volume_id, x, y, z, (CASE WHEN v < 5 THEN 0 ELSE 255 END)::INT AS v FROM lv")
def binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.binarize(large_volume(spark, sf_dir), 0.02)


@query(f"WITH {EV} SELECT volume_id, x, y, z, (CASE WHEN v < 0.1 THEN 0 ELSE 1 END)::INT AS v FROM ev")
def binarize_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.binarize(small_volumes(spark, sf_dir), 0.1, unsigned=False)


@query(f"WITH {EV} SELECT volume_id, x, y, z, round((v + 1) / 2, 6) AS v FROM ev")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.normalize(small_volumes(spark, sf_dir), -1.0, 1.0), "v")


@query(f"WITH {LV} SELECT volume_id, x, y, z, 7.5::DOUBLE AS v FROM lv")
def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.fill(large_volume(spark, sf_dir), 7.5)


@query(f"WITH {LV} SELECT 3::BIGINT AS volume_id, x, y, z, 255::INT AS v FROM grid")
def constant_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.constant(spark, LARGE, 255, 3)


@query(f"WITH {LV} SELECT volume_id, x, y, z, CASE WHEN v > 0 THEN 0.001::FLOAT::DOUBLE ELSE 1::DOUBLE END AS v FROM lvm")
def diffusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.diffusivity(large_mask(spark, sf_dir))


@query(f"WITH {LV} SELECT volume_id, x, y, z, round(v / 255, 6) AS v FROM lv")
def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(large_volume(spark, sf_dir).withColumn("v", elementwise.to_unit(F.col("v"), "uchar")), "v")


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = small_masks(spark, sf_dir)
    return a, shifted(a)


@query(_pair_sql("(CASE WHEN a.v <> 0 AND b.v <> 0 THEN 255 ELSE 0 END)::INT", _MASKS))
def mask_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.mask_and(*_masks(spark, sf_dir))


@query(_pair_sql("greatest(a.v, b.v)", _MASKS))
def mask_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.mask_max(*_masks(spark, sf_dir))


@query(_pair_sql("(CASE WHEN a.v > 0 AND b.v > 0 THEN 0 ELSE a.v END)::INT", _MASKS))
def mask_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.mask_sub(*_masks(spark, sf_dir))


_ON = "SELECT volume_id, x, y, z FROM evm WHERE v <> 0"
_NEXT = "SELECT volume_id - 1 AS volume_id, x, y, z FROM evm WHERE v <> 0"


@query(f"WITH {EV} {_ON} INTERSECT {_NEXT}")
def mask_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.intersect(*_masks(spark, sf_dir))


@query(f"WITH {EV} {_ON} UNION {_NEXT}")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.union(*_masks(spark, sf_dir))


@query(f"WITH {EV} {_ON} EXCEPT {_NEXT}")
def mask_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementwise.difference(*_masks(spark, sf_dir))


def _sides(spark: SparkSession, sf_dir: str, n: int = 2) -> list[DataFrame]:
    a = small_volumes(spark, sf_dir)
    return [shifted(a, k) if k else a for k in range(n)]


@query(_pair_sql("round(b.v - a.v, 6) + 0.0"))
def subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.subtract(*_sides(spark, sf_dir)), "v")


@query(_pair_sql("round(a.v * b.v, 6) + 0.0"))
def multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.multiply(*_sides(spark, sf_dir)), "v")


@query(_pair_sql("round(a.v + 0.5::DOUBLE * b.v, 6) + 0.0"))
def axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.add_scaled(*_sides(spark, sf_dir), 0.5), "v")


@query(_pair_sql("round(0.25::DOUBLE * a.v + b.v, 6) + 0.0"))
def scale_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.scale_into(*_sides(spark, sf_dir), 0.25), "v")


@query(_pair_sql("round(2::DOUBLE * (a.v + 0.5::DOUBLE * b.v) + c.v, 6) + 0.0", _TRIPLE))
def scale_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.scale_add(*_sides(spark, sf_dir, 3), 0.5, 2.0), "v")


@query(_pair_sql("round(a.v + 0.5::DOUBLE * b.v + 2::DOUBLE * c.v, 6) + 0.0", _TRIPLE))
def add_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elementwise.add_two(*_sides(spark, sf_dir, 3), 0.5, 2.0), "v")


@query(_pair_sql("round(a.v / (b.v + 2), 6) + 0.0"))
def jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return rounded(elementwise.jacobi(a, b.withColumn("v", F.col("v") + 2)), "v")


# Parts of volumes.


@query(f"WITH {LV} SELECT volume_id, (x - 4)::INT AS x, (y - 5)::INT AS y, (z - 6)::INT AS z, v FROM lv WHERE x BETWEEN 4 AND 11 AND y BETWEEN 5 AND 13 AND z BETWEEN 6 AND 15")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.crop(large_volume(spark, sf_dir), (4, 5, 6), (8, 9, 10))


@query(f"WITH {LV} SELECT volume_id, x AS u, y AS w, v FROM lv WHERE z = 28")
def slice_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.slice_axis(large_volume(spark, sf_dir), LARGE, "Z_NEG", 3)


@query(f"WITH {LV} SELECT 0::BIGINT AS volume_id, (i % 34)::INT AS x, ((i // 34) % 34)::INT AS y, (i // 1156)::INT AS z, coalesce(v, 0)::DOUBLE AS v FROM range(0, 39304) t(i) LEFT JOIN lv ON lv.x + 1 = i % 34 AND lv.y + 1 = (i // 34) % 34 AND lv.z + 1 = i // 1156")
def pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pad(large_volume(spark, sf_dir), LARGE, (1, 1, 1), (1, 1, 1))


@query(f"WITH {LV} SELECT volume_id, (x - 1)::INT AS x, (y - 1)::INT AS y, (z - 1)::INT AS z, v FROM lv WHERE least(x, y, z) > 0 AND greatest(x, y, z) < 31")
def unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pad(large_volume(spark, sf_dir), LARGE, (-1, -1, -1), (-1, -1, -1))


@query(f"WITH {LV} SELECT volume_id, x, y, z, v FROM lv WHERE y < 16 AND z < 8")
def aspect_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.aspect_crop(large_volume(spark, sf_dir), LARGE, (1.0, 0.5, 0.25))


_ORIGINS = "range(0, 24, 8)"


@query(f"WITH {LV} SELECT volume_id, ox::INT AS originx, oy::INT AS originy, oz::INT AS originz, sum(v) AS total, count(*) AS n FROM lv, {_ORIGINS} a(ox), {_ORIGINS} b(oy), {_ORIGINS} c(oz) WHERE ox + 8 <= 31 AND oy + 8 <= 31 AND oz + 8 <= 31 AND x BETWEEN ox AND ox + 7 AND y BETWEEN oy AND oy + 7 AND z BETWEEN oz AND oz + 7 GROUP BY ALL")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reshape.windows(large_volume(spark, sf_dir), LARGE, (8, 8, 8), (8, 8, 8))
    return found.groupBy("volume_id", "originx", "originy", "originz").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query(f"WITH {LV} SELECT volume_id, ox::INT AS originx, oy::INT AS originy, oz::INT AS originz, count(*) FILTER (WHERE v = 0) / count(*)::DOUBLE AS porosity FROM lvm, range(0, 17, 4) a(ox), range(0, 17, 4) b(oy), range(0, 17, 4) c(oz) WHERE ox + 16 <= 31 AND oy + 16 <= 31 AND oz + 16 <= 31 AND x BETWEEN ox AND ox + 15 AND y BETWEEN oy AND oy + 15 AND z BETWEEN oz AND oz + 15 GROUP BY ALL")
def slice_porosity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.porosity(actions.cut_windows(to_bricks(large_mask(spark, sf_dir), LARGE), (16, 16, 16), (4, 4, 4)))


# Neighbours.


@query(f"WITH {LV}, nb AS (SELECT *, {neighbour_columns(32, 'periodic')} FROM lvm) SELECT volume_id, x, y, z, (CASE WHEN least(x_pos, x_neg, y_pos, y_neg, z_pos, z_neg) > 0 THEN v ELSE 0 END)::INT AS v FROM nb")
def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.erode(large_mask(spark, sf_dir), LARGE)


@query(f"WITH {LV}, nb AS (SELECT *, {neighbour_columns(32, 'periodic')} FROM lv) SELECT volume_id, x, y, z, round(v + 0.1::DOUBLE * (x_pos + x_neg + y_pos + y_neg + z_pos + z_neg - 6 * v) + CASE WHEN x < 4 AND y < 4 AND z < 4 THEN 1.5::DOUBLE ELSE 0 END, 6) + 0.0 AS v FROM nb")
def heat_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stencil.heat_step(large_volume(spark, sf_dir), LARGE, 0.1, [((0, 0, 0), (4, 4, 4), 1.5)]), "v")


_CHANGE = " + ".join(f"(d + d_{a}_{s}) / 2 * (coalesce({a}_{s}, {'1' if (a, s) == ('x', 'neg') else '0' if (a, s) == ('x', 'pos') else 'v'}) - v)" for a in XYZ for s in ("pos", "neg"))


@query(f"WITH {EV}, j AS (SELECT ev.*, CASE WHEN evm.v > 0 THEN 0.001::FLOAT::DOUBLE ELSE 1::DOUBLE END AS d FROM ev JOIN evm USING (volume_id, x, y, z)), nb AS (SELECT *, {neighbour_columns(4, 'none')}, {neighbour_columns(4, 'clamp', 'd', 'd_')} FROM j) SELECT volume_id, x, y, z, round(v + 0.1::DOUBLE * ({_CHANGE}), 6) + 0.0 AS v FROM nb")
def diffuse_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefficients = elementwise.diffusivity(small_masks(spark, sf_dir))
    return rounded(stencil.diffuse_step(small_volumes(spark, sf_dir), coefficients, SMALL, 0.1, {"X_NEG": 1.0, "X_POS": 0.0}), "v")


# Components.


_RUNS = "s AS (SELECT *, sum(fresh) OVER (PARTITION BY volume_id, y, z ORDER BY x) AS run FROM (SELECT *, coalesce((lag(v) OVER (PARTITION BY volume_id, y, z ORDER BY x) <> v)::INT, 1) AS fresh FROM lvm))"


@query(f"WITH {LV}, {_RUNS} SELECT volume_id, y, z, min(x) AS x0, max(x) AS x1 FROM s WHERE v <> 255 GROUP BY volume_id, y, z, run")
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.spans(large_mask(spark, sf_dir))


@query("WITH s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, coalesce((lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type)::INT, 1) AS fresh FROM events)) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM s GROUP BY user_id, run")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.event_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the small masks, found in the bricks without a shuffle."""
    return to_voxels(segment.label_bricks(small_bricks(spark, sf_dir))).withColumn("label", F.col("v").cast("long")).drop("v")


@query(f"WITH RECURSIVE {CCL} SELECT volume_id, x, y, z, label FROM ccl")
def ccl_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select(*KEY, "label")


@query(f"WITH RECURSIVE {CCL} SELECT volume_id, x, y, z, label FROM ccl")
def ccl_labels_by_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.label_voxels(small_masks(spark, sf_dir))


@query()
def ccl_labels_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.label_voxels(large_mask(spark, sf_dir))


@query(f"WITH RECURSIVE {CCL} SELECT * FROM infob")
def segment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_info(_labels(spark, sf_dir), SMALL)


@query(f"WITH RECURSIVE {CCL} SELECT * FROM allfaces")
def face_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.label_faces(_labels(spark, sf_dir), SMALL)


@query(f"WITH RECURSIVE {CCL} SELECT i.* FROM infob i JOIN allfaces f USING (volume_id, label) WHERE NOT f.dir_none")
def unreachable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return segment.filter_segments(segment.segment_info(labels, SMALL), segment.label_faces(labels, SMALL))


@query(f"WITH RECURSIVE {CCL} SELECT volume_id, sum(voxel_num) / 64::DOUBLE AS ratio FROM info GROUP BY ALL")
def segment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_ratio(segment.segment_info(_labels(spark, sf_dir), SMALL), SMALL)


@query(f"WITH RECURSIVE {CCL} SELECT volume_id, label FROM allfaces WHERE x_pos AND x_neg")
def spanning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.labels_at_both(segment.label_faces(_labels(spark, sf_dir), SMALL), "X_POS", "X_NEG")


@query(f"WITH RECURSIVE {CCL} SELECT c.volume_id, c.x, c.y, c.z, (CASE WHEN f.x_neg THEN 255 ELSE 0 END)::INT AS v FROM ccl c LEFT JOIN allfaces f USING (volume_id, label)")
def boundary_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.boundary_volume(_labels(spark, sf_dir), SMALL, "X_NEG")


@query(f"WITH RECURSIVE {CCL} SELECT c.volume_id, c.x, c.y, c.z, (CASE WHEN NOT f.x_neg THEN 255 ELSE 0 END)::INT AS v FROM ccl c LEFT JOIN allfaces f USING (volume_id, label)")
def boundary_volume_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.boundary_volume(_labels(spark, sf_dir), SMALL, "X_NEG", invert=True)


@query(f"WITH RECURSIVE {CCL} SELECT volume_id, label, CASE WHEN z_pos AND z_neg THEN 'mid' WHEN z_pos THEN 'pos' ELSE 'neg' END AS part FROM allfaces WHERE NOT dir_none AND (z_pos OR z_neg)")
def face_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.face_partition(_labels(spark, sf_dir), SMALL, "z")


@query(f"WITH RECURSIVE {CCL} SELECT volume_id, label, x, y, z, 255::INT AS v FROM ccl WHERE label > 0")
def separate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.separate(_labels(spark, sf_dir))


def _channel(shift: int) -> str:
    hue = "((label % 26) * 137.50776405::DOUBLE) % 360 / 60"
    return f"(CASE WHEN label = 0 THEN 0 ELSE round(least(1, greatest(0, abs(({hue} + {shift}) % 6 - 3) - 1)) * 255) END)::INT"


@query(f"WITH RECURSIVE {CCL} SELECT volume_id, x, y, z, {_channel(0)} AS r, {_channel(4)} AS g, {_channel(2)} AS b, (CASE WHEN label = 0 THEN 0 ELSE 255 END)::INT AS a FROM ccl")
def colorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.colorize(_labels(spark, sf_dir))


@query(f"WITH {EV} SELECT volume_id, (x + 4 * y + 16 * z)::BIGINT AS linear, row_number() OVER (PARTITION BY volume_id ORDER BY x + 4 * y + 16 * z) - 1 AS dense FROM evm WHERE v = 0")
def compact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.compact_index(small_masks(spark, sf_dir), F.col("v") == 0, SMALL)


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS label FROM lineitem")
def dense_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return segment.dense_relabel(rows, "l_suppkey", "l_orderkey").select("l_orderkey", "l_linenumber", "label")


# Surfaces.


@query(f"WITH {EV}, {cells('evm')} SELECT volume_id, cubeindex, count(*) AS n FROM cells GROUP BY ALL")
def mc_case_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.case_histogram(small_masks(spark, sf_dir), SMALL)


_AREA = "SELECT v.volume_id, round(coalesce(a.area, 0), 6) AS area FROM (SELECT DISTINCT volume_id FROM {}) v LEFT JOIN areas a USING (volume_id)"


@query(f"WITH {EV}, {areas('evm', 4)} {_AREA.format('evm')}")
def mc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surface.area_bricks(small_bricks(spark, sf_dir)), "area")


@query(f"WITH {EV}, {areas('evm', 4)} {_AREA.format('evm')}")
def mc_area_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surface.area(small_masks(spark, sf_dir), SMALL), "area")


@query(f"WITH {LV}, {areas('lvm', 32)} {_AREA.format('lvm')}")
def mc_area_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(surface.area(large_mask(spark, sf_dir), LARGE), "area")


_DIRS = ", ".join(f"('{n}')" for n in ("X_POS", "X_NEG", "Y_POS", "Y_NEG", "Z_POS", "Z_NEG"))
_BY_DIR = f"""dirs(dir) AS (VALUES {_DIRS}), dm AS (
    SELECT c.volume_id, dir, c.x, c.y, c.z, CASE WHEN (CASE dir WHEN 'X_POS' THEN f.x_pos WHEN 'X_NEG' THEN f.x_neg WHEN 'Y_POS' THEN f.y_pos WHEN 'Y_NEG' THEN f.y_neg WHEN 'Z_POS' THEN f.z_pos ELSE f.z_neg END) THEN 255 ELSE 0 END AS v
    FROM ccl c CROSS JOIN dirs LEFT JOIN allfaces f USING (volume_id, label)
)"""


@query(f"WITH RECURSIVE {CCL}, {_BY_DIR}, {areas('dm', 4, 'volume_id, dir')} SELECT v.volume_id, v.dir, round(coalesce(a.area, 0), 6) AS area FROM (SELECT DISTINCT volume_id, dir FROM dm) v LEFT JOIN areas a USING (volume_id, dir)")
def mc_area_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return rounded(surface.area_by_direction(labels, SMALL, ["X_POS", "X_NEG", "Y_POS", "Y_NEG", "Z_POS", "Z_NEG"]), "area")


@query(f"WITH {EV}, {areas('evm', 4)}, t AS (SELECT volume_id, area FROM areas) SELECT volume_id, (3 * count(*))::BIGINT AS corners FROM sides GROUP BY ALL")
def mc_mesh_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.triangles(small_masks(spark, sf_dir), SMALL).groupBy("volume_id").agg((3 * F.count("*")).alias("corners"))


@query(f"WITH {EV}, {VERTICES} SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY x, y, z) AS vertex, x, y, z, " + ", ".join(f"CASE WHEN l > 1e-9 THEN round(n{a} / l, 6) + 0.0 ELSE 0 END AS n{a}" for a in XYZ) + " FROM summed")
def mc_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, _ = surface.mesh(small_masks(spark, sf_dir), SMALL)
    return rounded(vertices, "nx", "ny", "nz")


# Diffusion.


_SYSTEM = ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in ("c_xp", "c_xn", "c_yp", "c_yn", "c_zp", "c_zn", "c_diag", "rhs", "x0"))


@query(f"WITH {diffusion_sql(0, 1)} SELECT volume_id, x, y, z, {_SYSTEM} FROM sys")
def diffusion_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = diffusion.system(small_masks(spark, sf_dir), SMALL, "X_POS")
    return rounded(made, *[c for c in made.columns if c not in KEY], digits=9)


@query(f"WITH {diffusion_sql(1, -1)} SELECT volume_id, x, y, z, {_SYSTEM} FROM sys")
def diffusion_system_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = diffusion.system(small_masks(spark, sf_dir), SMALL, "Y_NEG")
    return rounded(made, *[c for c in made.columns if c not in KEY], digits=9)


_AX = "c_diag * x0 + " + " + ".join(f"c_{a}{s[0]} * coalesce(_{a}_{s}, 0)" for a in XYZ for s in ("pos", "neg"))


@query(f"WITH {diffusion_sql(0, 1)}, nx AS (SELECT *, {neighbour_columns(4, 'none', 'x0', '_')} FROM sys) SELECT volume_id, round(sum((rhs - ({_AX})) ** 2), 8) AS rr, round(sum(rhs * rhs), 8) AS bb FROM nx GROUP BY ALL")
def initial_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diffusion.residual(diffusion.system(small_masks(spark, sf_dir), SMALL, "X_POS"), SMALL), "rr", "bb", digits=8)


@query()
def tau_by_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.tau(small_bricks(spark, sf_dir), ["X_POS", "X_NEG", "Y_POS", "Z_POS"])


@query("SELECT vec_id::BIGINT AS volume_id, dir, TRUE AS converged, TRUE AS residual_ok FROM embeddings, (VALUES ('X_POS'), ('Y_NEG')) t(dir)")
def tau_residual_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffusion.tortuosity(small_bricks(spark, sf_dir), ["X_POS", "Y_NEG"]).select("volume_id", "dir", "converged", "residual_ok")


@query("SELECT vec_id::BIGINT AS volume_id, dir, TRUE AS same FROM embeddings, (VALUES ('X_POS'), ('Z_NEG')) t(dir)")
def solvers_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = {s: diffusion.tortuosity(small_bricks(spark, sf_dir), ["X_POS", "Z_NEG"], s, 1e-9).select("volume_id", "dir", F.col("tau").alias(s)) for s in ("CG", "BICGSTAB")}
    both = solved["CG"].join(solved["BICGSTAB"], ["volume_id", "dir"])
    return both.select("volume_id", "dir", (F.abs(F.col("CG") - F.col("BICGSTAB")) <= 1e-4 * F.col("CG")).alias("same"))


@query()
def tau_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.tau(to_bricks(large_mask(spark, sf_dir), LARGE), AXIS_DIRS)


# Particles.


@query(f"WITH {PT}, g AS (SELECT (i % 24)::INT AS x, ((i // 24) % 24)::INT AS y, (i // 576)::INT AS z FROM range(0, 13824) t(i)) SELECT DISTINCT 0::BIGINT AS set_id, x, y, z FROM g, pt WHERE (x / 24::DOUBLE - px) ** 2 + (y / 24::DOUBLE - py) ** 2 + (z / 24::DOUBLE - pz) ** 2 < r * r AND "
       + " AND ".join(f"{a} BETWEEN greatest(0, trunc((p{a} - r) * 23)) AND least(23, trunc((p{a} + r) * 23))" for a in XYZ))
def sphere_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.rasterize_spheres(part_spheres(spark, sf_dir), (24, 24, 24))


_SUMS = "count(*) AS n, round(sum(4 * pi() * r * r), 6) AS surface, round(sum(4 / 3::DOUBLE * pi() * r * r * r), 6) AS volume"


@query(f"WITH {PT}, s AS (SELECT {_SUMS} FROM pt) SELECT 0::BIGINT AS set_id, n, surface, volume, CASE WHEN volume < 1 THEN round(1 / sqrt(greatest(1 - volume, 1e-300)), 4) END AS tau FROM s")
def sphere_analytic_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = particles.sphere_sums(part_spheres(spark, sf_dir))
    return made.select("set_id", "n", F.round("surface", 6).alias("surface"), F.round("volume", 6).alias("volume"), F.round("tau", 4).alias("tau"))


@query(f"WITH {PT} SELECT 0::BIGINT AS set_id, a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.id < b.id AND abs(a.px - b.px) < a.r + b.r AND (a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2 < (a.r + b.r) ** 2")
def sphere_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.sphere_collisions(part_spheres(spark, sf_dir), 0.11)


_BOX = " AND ".join(f"a.p{c} - a.r <= b.p{c} + b.r AND b.p{c} - b.r <= a.p{c} + a.r" for c in XYZ)


@query(f"WITH {PT} SELECT 0::BIGINT AS set_id, a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.id < b.id AND {_BOX}")
def aabb_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.overlapping(particles.boxes(part_spheres(spark, sf_dir)), 0.11)


@query(f"WITH {PT} SELECT 0::BIGINT AS set_id, " + ", ".join(f"round(min(p{a} - r), 6) + 0.0 AS min_{a}" for a in XYZ) + ", " + ", ".join(f"round(max(p{a} + r), 6) AS max_{a}" for a in XYZ) + " FROM pt WHERE " + " AND ".join(f"p{a} - r <= 0.5 AND p{a} + r >= 0.25" for a in XYZ))
def trimmed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = particles.keep_in_box(particles.boxes(part_spheres(spark, sf_dir)), (0.25,) * 3, (0.5,) * 3)
    return rounded(particles.bounds(kept), *[f"{m}_{a}" for m in ("min", "max") for a in XYZ])


@query(f"WITH {PT}, o AS (SELECT 0::BIGINT AS set_id, a.id, count(*)::DOUBLE AS overlap FROM pt a JOIN pt b ON a.id <> b.id AND {_BOX} GROUP BY a.id) SELECT set_id, id, overlap FROM o ORDER BY overlap DESC, id LIMIT 1")
def argmax_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.largest_overlap(particles.overlap_counts(particles.boxes(part_spheres(spark, sf_dir)), 0.11))


@query("""WITH w AS (SELECT c_nationkey, c_custkey, sum(c_custkey % 7 + 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 + 1, c_custkey ROWS UNBOUNDED PRECEDING) / sum(c_custkey % 7 + 1) OVER (PARTITION BY c_nationkey)::DOUBLE AS share,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 + 1, c_custkey) AS nth FROM customer),
    u AS (SELECT n_nationkey, k AS draw, ((n_nationkey * 31 + k * 17) % 97) / 97::DOUBLE AS u FROM nation, range(0, 3) t(k))
    SELECT draw::BIGINT AS draw, c_nationkey, arg_min(c_custkey, nth) AS item FROM u JOIN w ON c_nationkey = n_nationkey AND share >= u - 1e-12 GROUP BY draw, c_nationkey""")
def weighted_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 7 + 1).alias("weight"))
    draws = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey")).crossJoin(spark.range(3).withColumnRenamed("id", "draw"))
    draws = draws.withColumn("u", ((F.col("c_nationkey") * 31 + F.col("draw") * 17) % 97) / F.lit(97.0))
    return particles.weighted_pick(items, "c_nationkey", "weight", "c_custkey", draws)


@query(f"WITH {PT} SELECT id, round(least(abs(px - 0.5), abs(py - 0.5), abs(pz - 0.5)), 6) AS nearest, round(sqrt((px - 0.5) ** 2 + (py - 0.5) ** 2 + (pz - 0.5) ** 2), 6) AS length, round(px * 0.25::DOUBLE + (1 - 0.25::DOUBLE) * py, 6) AS lerp, (CASE WHEN px < 0.25 THEN 0.25::DOUBLE WHEN px > 0.75 THEN 0.75::DOUBLE ELSE round(px, 6) END) AS clamped FROM pt")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = part_spheres(spark, sf_dir)
    p, centre = scalars.vector("px", "py", "pz"), scalars.vector(0.5, 0.5, 0.5)
    away = scalars.minus(p, centre)
    nearest = F.least(*[F.abs(c) for c in away])
    made = items.select("id", nearest.alias("nearest"), scalars.length(away).alias("length"), scalars.lerp(F.col("py"), F.col("px"), 0.25).alias("lerp"), scalars.clamp(F.col("px"), 0.25, 0.75).alias("clamped"))
    return rounded(made, "nearest", "length", "lerp", "clamped")


@query(f"WITH {PT} SELECT id, round(1 + 2 * -py, 6) + 0.0 AS x, round(2 + 2 * px, 6) AS y, round(3 + 2 * pz, 6) AS z FROM pt")
def transformed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = (0.0, 0.0, 0.5**0.5, 0.5**0.5)
    made = geometry.transform(scalars.vector("px", "py", "pz"), (1.0, 2.0, 3.0), quarter, (2.0, 2.0, 2.0))
    return rounded(part_spheres(spark, sf_dir).select("id", *[c.alias(a) for c, a in zip(made, XYZ)]), *XYZ)


@query("SELECT 32::BIGINT AS triangles, TRUE AS close_to_sphere")
def sphere_mesh_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = particles.sphere_mesh(spark, 1.0, 4, 4).groupBy("triangle").pivot("corner", [0, 1, 2]).agg(F.first(F.struct(*XYZ)))
    named = corners.select(*[F.col(str(k)).alias(n) for k, n in enumerate("abc")])
    whole = named.agg(F.count("*").alias("triangles"), F.sum(surface.triangle_area()).alias("area"))
    return whole.select("triangles", F.col("area").between(8.0, 12.57).alias("close_to_sphere"))


@query()
def random_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.createDataFrame([(k, 40, 0.05, 0.08, k, True, 20000) for k in range(8)], "set_id long, n int, r_min double, r_max double, seed long, within boolean, max_tries int")
    return particles.generate_spheres(sets)


@query()
def largest_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.radius_table(spark.range(10, 50, 10, 4).withColumnRenamed("id", "n"))


@query()
def packed_ellipsoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.createDataFrame([(k, 4, 0.4, 0.4, 0.4, k, 2000, 0.99, 0.03) for k in range(4)], "set_id long, n int, sx double, sy double, sz double, seed long, max_iter int, schedule double, target double")
    return sdf.pack_sets(sets.repartition(4))


# Whole measures.


_ALPHA_DIRS = "dirs(dir) AS (VALUES ('X_POS'), ('X_NEG')), dm AS (SELECT c.volume_id, dir, c.x, c.y, c.z, CASE WHEN (CASE dir WHEN 'X_POS' THEN f.x_pos ELSE f.x_neg END) THEN 255 ELSE 0 END AS v FROM ccl c CROSS JOIN dirs LEFT JOIN allfaces f USING (volume_id, label) UNION ALL SELECT volume_id, 'DIR_NONE', x, y, z, v FROM evm)"


@query(f"""WITH RECURSIVE {CCL}, {_ALPHA_DIRS}, {areas('dm', 4, 'volume_id, dir')}
    SELECT v.volume_id::VARCHAR AS ID, 4 AS dimx, 4 AS dimy, 4 AS dimz, v.dir, p.porosity, round(coalesce(a.area, 0), 6) AS rad, coalesce(s.ratio, 0)::DOUBLE AS segmentVolumeRatio
    FROM (SELECT DISTINCT volume_id, dir FROM dm) v LEFT JOIN areas a USING (volume_id, dir)
    JOIN (SELECT volume_id, count(*) FILTER (WHERE v = 0) / 64::DOUBLE AS porosity FROM evm GROUP BY ALL) p USING (volume_id)
    LEFT JOIN (SELECT i.volume_id, sum(i.voxel_num) / 64::DOUBLE AS ratio FROM info i JOIN allfaces f USING (volume_id, label) WHERE NOT f.dir_none GROUP BY ALL) s USING (volume_id)""")
def alpha_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(actions.alpha(small_bricks(spark, sf_dir), ["X_POS", "X_NEG"], segments=True), "rad")


@query(f"WITH RECURSIVE {CCL}, {areas('evm', 4)} SELECT m.volume_id, m.porosity, coalesce(n.n, 0)::BIGINT AS n_components, round(coalesce(a.area, 0), 6) AS area FROM (SELECT volume_id, count(*) FILTER (WHERE v = 0) / count(*)::DOUBLE AS porosity FROM evm GROUP BY ALL) m LEFT JOIN (SELECT volume_id, max(label) AS n FROM ccl GROUP BY ALL) n USING (volume_id) LEFT JOIN areas a USING (volume_id)")
def volume_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(actions.measure(small_bricks(spark, sf_dir), []), "area")


@query()
def volume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.measure(small_bricks(spark, sf_dir), AXIS_DIRS)


@query()
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.slices(to_bricks(large_mask(spark, sf_dir), LARGE), (8, 8, 8), (8, 8, 8))


# Further functions of the library.


@query(f"WITH {PT}, s AS (SELECT avg(4 * pi() * r * r) AS a, avg(4 / 3::DOUBLE * pi() * r * r * r) AS v FROM pt) SELECT round((3 / (4 * pi())) ** (1 / 3::DOUBLE) * a / v ** (2 / 3::DOUBLE), 6) AS factor FROM s")
def shape_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = particles.sphere_sums(part_spheres(spark, sf_dir)).select((F.col("surface") / F.col("n")).alias("a"), (F.col("volume") / F.col("n")).alias("v"))
    return rounded(sums.select(surface.shape_factor(F.col("a"), F.col("v")).alias("factor")), "factor")


_FACES = ", ".join(f"({k}, '{n}')" for k, n in enumerate(segment.DIRECTIONS))


@query(f"WITH RECURSIVE {CCL}, d(dir_id, name) AS (VALUES {_FACES}) SELECT volume_id, label, dir_id, CASE dir_id WHEN 0 THEN x_pos WHEN 1 THEN x_neg WHEN 2 THEN y_pos WHEN 3 THEN y_neg WHEN 4 THEN z_pos WHEN 5 THEN z_neg ELSE dir_none END AS touches FROM allfaces, d")
def face_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.face_rows(segment.label_faces(_labels(spark, sf_dir), SMALL))


@query(f"WITH RECURSIVE {CCL} SELECT c.volume_id, c.x, c.y, c.z, (CASE WHEN c.label IN (1, 3) THEN 255 ELSE 0 END)::INT AS v FROM ccl c")
def selected_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return segment.selected_mask(labels, labels.where("label IN (1, 3)"))


@query("SELECT event_id, round(CASE WHEN t < 0 THEN 0 WHEN t > 1 THEN 1 ELSE t * t * (3 - 2 * t) END, 6) AS smooth, round(value - floor(value), 6) AS part, (value::BIGINT * 0 + (event_id + 6) // 7)::BIGINT AS sevenths FROM (SELECT *, (value - 10) / 80.0::DOUBLE AS t FROM events)")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    made = table(spark, sf_dir, "events").select("event_id", scalars.smoothstep(10.0, 90.0, v).alias("smooth"), scalars.fraction(v).alias("part"), scalars.round_up_div(F.col("event_id"), 7).cast("long").alias("sevenths"))
    return rounded(made, "smooth", "part")


@query("SELECT c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 0 ELSE round(exp(-(c_custkey % 7) / 4.0::DOUBLE), 6) END)::DOUBLE AS p FROM customer")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    score = F.lit(1.0)
    fresh = F.when(key % 3 == 0, 0.5).otherwise(1.0 + (key % 7) / 2.0)
    heat = F.when(key % 5 == 0, 0.0).otherwise(2.0)
    made = table(spark, sf_dir, "customer").select("c_custkey", scalars.acceptance(score, fresh, heat).alias("p"))
    return rounded(made, "p")


@query(f"WITH {PT} SELECT id, " + ", ".join(f"round({a}, 6) + 0.0 AS {a}" for a in XYZ) + " FROM (SELECT id, px AS x, py AS y, pz AS z FROM pt)")
def inverse_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    move, turn, scale = (1.0, -2.0, 0.5), (0.5, 0.5, 0.5, 0.5), (2.0, 3.0, 0.25)
    there = geometry.transform(scalars.vector("px", "py", "pz"), move, turn, scale)
    moved = part_spheres(spark, sf_dir).select("id", *[c.alias(f"q{a}") for c, a in zip(there, XYZ)])
    back = geometry.inverse(scalars.vector("qx", "qy", "qz"), move, turn, scale)
    return rounded(moved.select("id", *[c.alias(a) for c, a in zip(back, XYZ)]), *XYZ)


_DRAW = random.Random(7)
_PLACE = [_DRAW.randint(0, 16) for _ in XYZ]


@query(f"WITH {LV} SELECT volume_id, " + ", ".join(f"({a} - {o})::INT AS {a}" for a, o in zip(XYZ, _PLACE)) + ", v FROM lv WHERE " + " AND ".join(f"{a} BETWEEN {o} AND {o + 15}" for a, o in zip(XYZ, _PLACE)))
def random_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.random_crop(large_volume(spark, sf_dir), LARGE, (16, 16, 16), seed=7)


@query()
def mc_case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.case_table(spark)


@query()
def poisson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(particles.poisson_disk(0.15, 50, seed=1))], "id long, px double, py double, pz double")


from . import file_queries, shape_queries  # noqa: E402, F401  (they register theirs)
