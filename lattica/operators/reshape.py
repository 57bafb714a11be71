"""Parts of volumes: crops, slices, padding, sliding windows."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..volumes import AXES, KEY, XYZ, Dims, direction, from_linear


def crop(vox: DataFrame, origin: Dims, size: Dims) -> DataFrame:
    """The box [origin, origin + size), moved to 0."""
    inside = [(F.col(a) >= o) & (F.col(a) < o + s) for a, o, s in zip(AXES, origin, size)]
    return vox.where(inside[0] & inside[1] & inside[2]).withColumns({a: (F.col(a) - o).cast("int") for a, o in zip(AXES, origin)})


def clamp_crop(dims: Dims, origin: Dims, size: Dims) -> tuple[Dims, Dims]:
    """(origin, size) within dims; an empty box raises."""
    low = tuple(min(max(o, 0), d) for o, d in zip(origin, dims))
    high = tuple(min(max(o + s, 0), d) for o, s, d in zip(origin, size, dims))
    out = tuple(h - l for l, h in zip(low, high))
    if min(out) <= 0:
        raise ValueError(f"the box {origin} + {size} is empty in {dims}")
    return low, out


def random_crop(vox: DataFrame, dims: Dims, size: Dims, seed: int) -> DataFrame:
    """A box of the given size at a place drawn by the seed; any place that fits is as likely."""
    draw = random.Random(seed)
    return crop(vox, tuple(draw.randint(0, d - s) for d, s in zip(dims, size)), size)


def aspect_size(dims: Dims, aspect: tuple[float, float, float]) -> Dims:
    """The size of the crop with an aspect; the first component that is 1 keeps its extent."""
    if 1.0 not in aspect:
        raise ValueError("one component of the aspect must be 1")
    extent = dims[aspect.index(1.0)]
    return tuple(max(1, min(d, int(extent * a))) for d, a in zip(dims, aspect))


def aspect_crop(vox: DataFrame, dims: Dims, aspect: tuple[float, float, float]) -> DataFrame:
    return crop(vox, (0, 0, 0), aspect_size(dims, aspect))


def slice_axis(vox: DataFrame, dims: Dims, name: str, index: int) -> DataFrame:
    """(volume_id, u, w, v) of the plane `index` along a direction; u and w are the next axes in turn.

    Along Z_NEG the planes count from the far end.
    """
    _, axis, _ = direction(name)
    at = dims[2] - 1 - index if name == "Z_NEG" else index
    u, w = AXES[(axis + 1) % 3], AXES[(axis + 2) % 3]
    return vox.where(F.col(AXES[axis]) == at).select("volume_id", F.col(u).alias("u"), F.col(w).alias("w"), "v")


def pad(vox: DataFrame, dims: Dims, low: Dims, high: Dims, value: float = 0.0) -> DataFrame:
    """The volume within a border of `value`; negative widths take layers away.

    Only border voxels are made, and added to the moved voxels; nothing is joined.
    """
    size = tuple(d + l + h for d, l, h in zip(dims, low, high))
    if min(size) <= 0:
        raise ValueError("nothing is left")
    kind = vox.schema["v"].dataType
    moved = vox.select("volume_id", *[(F.col(a) + l).cast("int").alias(a) for a, l in zip(AXES, low)], "v")
    inside = F.lit(True)
    for a, s in zip(AXES, size):
        inside &= (F.col(a) >= 0) & (F.col(a) < s)
    volumes = vox.select("volume_id").distinct()
    cells = vox.sparkSession.range(size[0] * size[1] * size[2]).select(*from_linear("id", size))
    old = F.lit(True)
    for a, l, d in zip(AXES, low, dims):
        old &= (F.col(a) >= l) & (F.col(a) < l + d)
    border = volumes.crossJoin(cells.where(~old)).select(*KEY, F.lit(value).cast(kind).alias("v"))
    return moved.where(inside).union(border)


def window_origins(dims: Dims, size: Dims, stride: Dims, begin: Dims = (0, 0, 0), end: Dims | None = None, inclusive_end: bool = False) -> list[list[int]]:
    """Starts of sliding windows along each axis: those with start + size <= end.

    end is dims - 1 unless given, so that a window that ends on the last voxel is left out;
    inclusive_end takes it too.
    """
    end = end or tuple(d if inclusive_end else d - 1 for d in dims)
    return [list(range(b, e - s + 1, t)) for b, e, s, t in zip(begin, end, size, stride)]


def windows(vox: DataFrame, dims: Dims, size: Dims, stride: Dims, **bounds) -> DataFrame:
    """(volume_id, originx, originy, originz, x, y, z, v): each voxel once for each window it is in, coordinates within it.

    The starts that reach a voxel are found by arithmetic on its coordinates, so nothing is joined.
    """
    out = vox
    for a, s, t, starts in zip(AXES, size, stride, window_origins(dims, size, stride, **bounds)):
        if not starts:
            return vox.where("false").select("volume_id", *[F.lit(0).alias(f"origin{b}") for b in AXES], *XYZ, "v")
        first, last = starts[0], starts[-1]
        low = F.greatest(F.lit(0), F.ceil((F.col(a) - s + 1 - first) / t)).cast("int")
        high = F.least(F.lit(len(starts) - 1), F.floor((F.col(a) - first) / t)).cast("int")
        reach = F.when((F.col(a) >= first) & (F.col(a) < last + s) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(f"origin{a}", F.explode(reach)).withColumn(f"origin{a}", (F.col(f"origin{a}") * t + first).cast("int"))
    return out.select("volume_id", *[f"origin{a}" for a in AXES], *[(F.col(a) - F.col(f"origin{a}")).cast("int").alias(a) for a in AXES], "v")
