"""Operators on a voxel and its six neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..volumes import AXES, Dims

#: The face value that stands for a zero gradient.
ZERO_GRADIENT = 1e37


def neighbours(vox: DataFrame, dims: Dims, boundary: str = "clamp", column: str = "v", prefix: str = "") -> DataFrame:
    """vox with x_neg, x_pos, ... z_pos: the values of the six neighbours.

    Beyond the border stands the voxel itself (clamp), the far side (periodic) or null (none).
    Each axis is one window over lines of voxels; the volume must be dense.
    """
    out = vox
    for axis, extent in zip(AXES, dims):
        line = Window.partitionBy("volume_id", *[a for a in AXES if a != axis]).orderBy(axis)
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for side, step, far in (("neg", F.lag, F.last), ("pos", F.lead, F.first)):
            value = step(column).over(line)
            if boundary == "clamp":
                value = F.coalesce(value, F.col(column))
            elif boundary == "periodic":
                value = F.coalesce(value, far(column).over(whole))
            out = out.withColumn(f"{prefix}{axis}_{side}", value)
    return out


def _sides(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{a}_{s}") for a in AXES for s in ("pos", "neg")]


def erode(mask: DataFrame, dims: Dims) -> DataFrame:
    """Keep voxels whose six neighbours are all set; the volume wraps around."""
    kept = F.lit(True)
    for side in _sides():
        kept &= side > 0
    return neighbours(mask, dims, "periodic").select("volume_id", *AXES, F.when(kept, F.col("v")).otherwise(0).alias("v"))


def heat_step(vox: DataFrame, dims: Dims, rate: float = 0.1, sources: list[tuple[Dims, Dims, float]] = ()) -> DataFrame:
    """One explicit step v + rate * (sum of neighbours - 6 v) in a volume that wraps around.

    sources: (low, high, amount) boxes that gain the amount afterwards.
    """
    total = sum(_sides()[1:], _sides()[0])
    value = F.col("v") + rate * (total - 6.0 * F.col("v"))
    for low, high, amount in sources:
        inside = F.lit(True)
        for a, l, h in zip(AXES, low, high):
            inside &= (F.col(a) >= l) & (F.col(a) < h)
        value = value + F.when(inside, amount).otherwise(0.0)
    return neighbours(vox, dims, "periodic").select("volume_id", *AXES, value.alias("v"))


def diffuse_step(concentration: DataFrame, coefficients: DataFrame, dims: Dims, step: float, faces: dict[str, float]) -> DataFrame:
    """One explicit step of masked diffusion with variable coefficients.

    concentration, coefficients: voxels. faces: a fixed value for each direction (X_POS is the face
    at the end of x), or ZERO_GRADIENT, which is also taken for those not named. Fluxes use the
    mean of the coefficients at either side.
    """
    joined = concentration.select("volume_id", *AXES, "v").join(coefficients.select("volume_id", *AXES, F.col("v").alias("d")), ["volume_id", *AXES])
    joined = neighbours(neighbours(joined, dims, "none"), dims, "clamp", "d", "d_")
    change = F.lit(0.0)
    for a in AXES:
        for side in ("pos", "neg"):
            fixed = faces.get(f"{a}_{side}".upper(), ZERO_GRADIENT)
            beyond = F.col("v") if fixed >= ZERO_GRADIENT else F.lit(fixed)
            mean = (F.col("d") + F.col(f"d_{a}_{side}")) / 2
            change = change + mean * (F.coalesce(F.col(f"{a}_{side}"), beyond) - F.col("v"))
    return joined.select("volume_id", *AXES, (F.col("v") + step * change).alias("v"))
