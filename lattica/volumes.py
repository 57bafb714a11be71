"""The data model: voxels, bricks, directions, and volumes read from the star schema's tables.

voxels: (volume_id, x, y, z, v), one row per voxel. bricks: (volume_id, dx, dy, dz, kind, data),
one row per volume or part of one, data being the values with x fastest. A mask has 0 for pores
and another value, 255, for solid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Dims = tuple[int, int, int]
AXES = ("x", "y", "z")
XYZ = ["x", "y", "z"]
KEY = ["volume_id", "x", "y", "z"]

#: Element types of volumes by their number in files, as numpy names, with bytes each.
KINDS = {0: ("<f4", 4), 1: ("<f8", 8), 2: ("<i1", 1), 3: ("<u1", 1), 4: ("<i4", 4), 5: ("<u4", 4)}
#: Directions by number.
DIRECTIONS = ("X_POS", "X_NEG", "Y_POS", "Y_NEG", "Z_POS", "Z_NEG", "DIR_NONE")
BRICK = "volume_id long, dx int, dy int, dz int, kind string, data binary"


def direction(name: str | int) -> tuple[int, int, int]:
    """(number, axis, sign) of a direction; DIR_NONE has axis and sign 0."""
    k = DIRECTIONS.index(name) if isinstance(name, str) else int(name)
    return (k, k // 2, 1 - 2 * (k % 2)) if k < 6 else (6, 0, 0)


def directions(spark: SparkSession) -> DataFrame:
    """(dir_id, name, axis, sgn, ox, oy, oz), a row for each of the seven directions."""
    rows = []
    for name in DIRECTIONS:
        k, axis, sign = direction(name)
        rows.append((k, name, axis if sign else None, sign, *(sign * (axis == a) for a in range(3))))
    return spark.createDataFrame(rows, "dir_id int, name string, axis int, sgn int, ox int, oy int, oz int")


def parse_directions(flag: str) -> list[str]:
    """Directions of a command-line flag: all, pos, neg, xneg, yneg, zneg, else each of x, y, z in it, else X_POS."""
    sets = {"all": DIRECTIONS[:6], "pos": DIRECTIONS[0:6:2], "neg": DIRECTIONS[1:6:2], "xneg": ["X_NEG"], "yneg": ["Y_NEG"], "zneg": ["Z_NEG"]}
    return list(sets.get(flag) or [DIRECTIONS[2 * AXES.index(c)] for c in flag if c in AXES] or ["X_POS"])


def linear_index(dims: Dims, x: str | Column = "x", y: str | Column = "y", z: str | Column = "z") -> Column:
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
    return (x + y * dims[0] + z * (dims[0] * dims[1])).cast("long")


def from_linear(index: str, dims: Dims) -> list[Column]:
    """x, y, z of a linear index."""
    i = F.col(index)
    plane = dims[0] * dims[1]
    return [(i % dims[0]).cast("int").alias("x"), (F.floor(i / dims[0]) % dims[1]).cast("int").alias("y"), F.floor(i / plane).cast("int").alias("z")]


def voxels(arrays: DataFrame, dims: Dims, id_col: str, data_col: str) -> DataFrame:
    """One row per voxel from rows that hold a volume as an array, x fastest."""
    exploded = arrays.select(F.col(id_col).cast("long").alias("volume_id"), F.posexplode(data_col).alias("i", "v"))
    return exploded.select("volume_id", *from_linear("i", dims), F.col("v").cast("double").alias("v"))


def grid(spark: SparkSession, dims: Dims) -> DataFrame:
    """(x, y, z) of every voxel."""
    return spark.range(dims[0] * dims[1] * dims[2]).select(*from_linear("id", dims))


def to_bricks(vox: DataFrame, dims: Dims, kind: str = "<u1") -> DataFrame:
    """A brick for each volume of voxels; voxels that aren't there are 0. Volumes must fit into a task."""

    def build(table: pa.Table) -> pa.Table:
        data = np.zeros(dims[::-1], kind)
        x, y, z = (table.column(c).to_numpy() for c in XYZ)
        data[z, y, x] = table.column("v").to_numpy()
        row = {"volume_id": table.column("volume_id").slice(0, 1)} | {f"d{a}": pa.array([d], pa.int32()) for a, d in zip(AXES, dims)}
        return pa.table(row | {"kind": [kind], "data": pa.array([data.tobytes()], pa.binary())})

    return vox.select(*KEY, "v").groupBy("volume_id").applyInArrow(build, BRICK)


def to_voxels(bricks: DataFrame) -> DataFrame:
    """One row per voxel of whole-volume bricks."""

    def expand(rows: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in [*KEY, "v"]}
        for volume, dx, dy, dz, kind, data in zip(*(rows.column(c).to_pylist() for c in ("volume_id", "dx", "dy", "dz", "kind", "data"))):
            z, y, x = np.indices((dz, dy, dx), np.int32).reshape(3, -1)
            for c, v in zip(out, (np.full(len(x), volume, np.int64), x, y, z, np.frombuffer(data, kind).astype(np.float64))):
                out[c].append(v)
        return {c: np.concatenate(v) for c, v in out.items()}

    return per_batch(bricks, expand, "volume_id long, x int, y int, z int, v double")


def pack(arrays: DataFrame, dims: Dims, id_col: str, data_col: str, kind: str = "<u1") -> DataFrame:
    """Bricks from rows that hold a whole volume as an array of numbers; no shuffle."""

    def run(rows: pa.RecordBatch) -> dict:
        n = rows.num_rows
        values = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)
        return {"volume_id": rows.column(0)} | {f"d{a}": np.full(n, d, np.int32) for a, d in zip(AXES, dims)} | {"kind": [kind] * n, "data": [v.tobytes() for v in values]}

    return per_batch(arrays.select(F.col(id_col).cast("long"), data_col), run, BRICK)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow with f from a batch to columns."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield pa.RecordBatch.from_pydict(f(part), schema=arrow)

    return df.mapInArrow(run, schema)


def stacks(rows: pa.RecordBatch, most: int = 1 << 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, (n, dz, dy, dx) values) for the bricks of a batch, equal dims and kinds together, `most` values at a time."""
    shape = list(zip(*(rows.column(c).to_pylist() for c in ("dz", "dy", "dx", "kind"))))
    groups: dict[tuple, list[int]] = {}
    for k, s in enumerate(shape):
        groups.setdefault(s, []).append(k)
    data = rows.column("data")
    for (dz, dy, dx, kind), members in groups.items():
        step = max(1, most // max(1, dx * dy * dz))
        for at in range(0, len(members), step):
            chosen = members[at : at + step]
            yield np.array(chosen), np.stack([np.frombuffer(data[k].as_buffer(), kind).reshape(dz, dy, dx) for k in chosen])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Dims of the volumes that are read from the star schema.
SMALL: Dims = (4, 4, 4)
LARGE: Dims = (32, 32, 32)


def small_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of many 4x4x4 volumes: one for each row of embeddings."""
    return voxels(table(spark, sf_dir, "embeddings"), SMALL, "vec_id", "embedding")


def small_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """small_volumes as masks: negative values are pores."""
    return small_volumes(spark, sf_dir).withColumn("v", F.when(F.col("v") < 0, 0).otherwise(255))


def small_bricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bricks of small_masks, read from the arrays without a shuffle."""
    mask = F.transform("embedding", lambda v: F.when(v.cast("double") < 0, 0).otherwise(255))
    return pack(table(spark, sf_dir, "embeddings").select("vec_id", mask.alias("m")), SMALL, "vec_id", "m")


def large_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of one 32x32x32 volume: how many rows of lineitem fall on each voxel."""
    at = [F.pmod(c, F.lit(32)).cast("int").alias(a) for c, a in zip(("l_partkey", "l_suppkey", "l_orderkey"), AXES)]
    counts = table(spark, sf_dir, "lineitem").select(*at).groupBy(*XYZ).agg(F.count("*").alias("v"))
    dense = grid(spark, LARGE).join(F.broadcast(counts), XYZ, "left")  # at most 32**3 rows
    return dense.select(F.lit(0).cast("long").alias("volume_id"), *XYZ, F.coalesce("v", F.lit(0)).cast("double").alias("v"))


def large_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """large_volume as a mask: solid where a voxel has at least the mean."""
    total = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))
    vox = large_volume(spark, sf_dir).crossJoin(F.broadcast(total))  # one row
    return vox.select(*KEY, F.when(F.col("v") * 32768 >= F.col("n"), 255).otherwise(0).alias("v"))


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, id, px, py, pz, r): a sphere in the unit cube for each part."""
    at = [((F.col("p_partkey") * m % n) / float(n)).alias(f"p{a}") for a, m, n in zip(AXES, (37, 53, 71), (101, 103, 107))]
    return table(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("set_id"), F.col("p_partkey").cast("long").alias("id"), *at, (F.col("p_size") / 1000.0).alias("r"))
