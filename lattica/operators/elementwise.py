"""Maps over voxels and joins of volumes voxel by voxel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..volumes import KEY, XYZ, Dims, grid


def binarize(vox: DataFrame, threshold: float = 1.0, unsigned: bool = True) -> DataFrame:
    """Values under the threshold become 0, others 255 (unsigned bytes, threshold a fraction of 255) or 1 (floats)."""
    limit, high = (int(threshold * 255), 255) if unsigned else (threshold, 1)
    return vox.withColumn("v", F.when(F.col("v") < limit, 0).otherwise(high))


def normalize(vox: DataFrame, low: float, high: float) -> DataFrame:
    return vox.withColumn("v", (F.col("v") - low) / (high - low))


def combine(a: DataFrame, b: DataFrame, value: Column, *others: DataFrame) -> DataFrame:
    """Voxels that a, b (and c) share, with v from columns a, b (and c).

    All sides are keyed alike, so volumes stored bucketed or repartitioned by KEY join in place.
    """
    out = a.select(*KEY, F.col("v").alias("a"))
    for name, other in zip("bc", (b, *others)):
        out = out.join(other.select(*KEY, F.col("v").alias(name)), KEY)
    return out.select(*KEY, value.alias("v"))


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """255 where both are set."""
    return combine(a, b, F.when((F.col("a") != 0) & (F.col("b") != 0), 255).otherwise(0))


def mask_max(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, F.greatest("a", "b"))


def mask_sub(a: DataFrame, b: DataFrame) -> DataFrame:
    """a without what b sets too."""
    return combine(a, b, F.when((F.col("a") > 0) & (F.col("b") > 0), 0).otherwise(F.col("a")))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """b - a, in this order."""
    return combine(a, b, F.col("b") - F.col("a"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, F.col("a") * F.col("b"))


def add_scaled(a: DataFrame, b: DataFrame, beta: float) -> DataFrame:
    """a + beta b."""
    return combine(a, b, F.col("a") + beta * F.col("b"))


def scale_add(a: DataFrame, b: DataFrame, c: DataFrame, beta: float, gamma: float) -> DataFrame:
    """gamma (a + beta b) + c."""
    return combine(a, b, gamma * (F.col("a") + beta * F.col("b")) + F.col("c"), c)


def add_two(a: DataFrame, b: DataFrame, c: DataFrame, beta: float, gamma: float) -> DataFrame:
    """a + beta b + gamma c."""
    return combine(a, b, F.col("a") + beta * F.col("b") + gamma * F.col("c"), c)


def scale_into(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """alpha a + b."""
    return combine(a, b, alpha * F.col("a") + F.col("b"))


def jacobi(b: DataFrame, diagonal: DataFrame) -> DataFrame:
    """b / diagonal."""
    return combine(b, diagonal, F.col("a") / F.col("b"))


def fill(vox: DataFrame, value: float) -> DataFrame:
    return vox.withColumn("v", F.lit(value))


def constant(spark: SparkSession, dims: Dims, value: float, volume_id: int = 0) -> DataFrame:
    """A volume of one value."""
    return grid(spark, dims).select(F.lit(volume_id).cast("long").alias("volume_id"), *XYZ, F.lit(value).alias("v"))


def diffusivity(mask: DataFrame, d0: float = 1.0, d1: float = 0.001) -> DataFrame:
    """d1 where the mask is set, else d0, both rounded to single precision."""
    single = lambda d: F.lit(d).cast("float").cast("double")
    return mask.withColumn("v", F.when(F.col("v") > 0, single(d1)).otherwise(single(d0)))


def cast_volume(vox: DataFrame, kind: str) -> DataFrame:
    return vox.withColumn("v", F.col("v").cast(kind))


def to_unit(value: Column, kind: str) -> Column:
    """A value of an integer kind as a fraction of its largest: char, uchar, int, uint, uint64."""
    return value / {"char": 127.0, "uchar": 255.0, "int": 2.0**31, "uint": 2.0**32 - 1, "uint64": 2.0**64 - 1}[kind]


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set voxels of both masks, as coordinates."""
    on = lambda m: m.where("v <> 0").select(*KEY)
    return on(a).join(on(b), KEY, "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    on = lambda m: m.where("v <> 0").select(*KEY)
    return on(a).union(on(b)).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    on = lambda m: m.where("v <> 0").select(*KEY)
    return on(a).join(on(b), KEY, "left_anti")
