"""Sums over volumes and over planes of volumes; all combine map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..volumes import AXES, KEY, Dims, direction


def reduce_all(vox: DataFrame, low: Dims | None = None, high: Dims | None = None) -> DataFrame:
    """(volume_id, total, least, most, square_sum, zeros, n) over each volume, or its box [low, high)."""
    if low is not None:
        for a, l, h in zip(AXES, low, high):
            vox = vox.where((F.col(a) >= l) & (F.col(a) < h))
    return vox.groupBy("volume_id").agg(
        F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum(F.col("v") * F.col("v")).alias("square_sum"), F.count_if(F.col("v") == 0).alias("zeros"), F.count("*").alias("n")
    )


def product(vox: DataFrame) -> DataFrame:
    return vox.groupBy("volume_id").agg(F.product("v").alias("product"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume_id, dot) of two volumes with the same ids."""
    joined = a.select(*KEY, "v").join(b.select(*KEY, F.col("v").alias("w")), KEY)
    return joined.groupBy("volume_id").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))


def porosity(mask: DataFrame) -> DataFrame:
    """(volume_id, porosity): the share of zeros."""
    return mask.groupBy("volume_id").agg((F.count_if(F.col("v") == 0) / F.count("*")).alias("porosity"))


def profile(vox: DataFrame, dims: Dims, name: str) -> DataFrame:
    """(volume_id, plane, total): the sum over each plane along a direction, from the far end for a negative one."""
    _, axis, sign = direction(name)
    plane = F.col(AXES[axis]) if sign > 0 else dims[axis] - 1 - F.col(AXES[axis])
    return vox.groupBy("volume_id", plane.cast("int").alias("plane")).agg(F.sum("v").alias("total"))


def profile_events(events: DataFrame, name_col: str, seconds_col: str) -> DataFrame:
    """(name, n, total, mean, percent) of timed events, by falling mean."""
    grouped = events.groupBy(F.col(name_col).alias("name")).agg(F.count("*").alias("n"), F.sum(seconds_col).alias("total"), F.avg(seconds_col).alias("mean"))
    whole = events.agg(F.sum(seconds_col).alias("whole"))
    return grouped.crossJoin(F.broadcast(whole)).select("name", "n", "total", "mean", (100 * F.col("total") / F.col("whole")).alias("percent")).orderBy(F.desc("mean"))
