"""Spans, connected components of masks, and what is known of each component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import connected_components, numbered, roots
from ..volumes import AXES, BRICK, DIRECTIONS, KEY, XYZ, Dims, per_batch, stacks


def spans(mask: DataFrame, background: float = 255) -> DataFrame:
    """(volume_id, y, z, x0, x1): runs along x of equal values other than the background, x1 included."""
    line = Window.partitionBy("volume_id", "y", "z").orderBy("x")
    fresh = F.coalesce((F.lag("v").over(line) != F.col("v")).cast("int"), F.lit(1))
    numbered = mask.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("volume_id", "y", "z", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first("v").alias("v"))
    return runs.where(F.col("v") != background).select("volume_id", "y", "z", "x0", "x1")


def most_spans(runs: DataFrame) -> DataFrame:
    """(volume_id, most, total): the largest number of spans on a line of each volume, and the number of all."""
    return runs.groupBy("volume_id", "y", "z").agg(F.count("*").alias("n")).groupBy("volume_id").agg(F.max("n").alias("most"), F.sum("n").alias("total"))


def event_runs(events: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """(by, run, value, first, last, n): runs of equal values in each sequence, numbered from 1."""
    line = Window.partitionBy(by).orderBy(*order)
    fresh = F.coalesce((F.lag(value).over(line) != F.col(value)).cast("int"), F.lit(1))
    numbered = events.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "run").agg(F.first(value).alias(value), F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"), F.count("*").alias("n"))


def span_edges(runs: DataFrame) -> DataFrame:
    """Pairs (a, b) of touching spans as structs (volume_id, z, y, x0): equal lines joined on the overlap along x."""
    node = F.struct("volume_id", "z", "y", "x0")
    here = runs.select("volume_id", "y", "z", "x0", "x1", node.alias("a"))
    out = None
    for dy, dz in ((1, 0), (0, 1)):
        there = runs.select("volume_id", (F.col("y") - dy).alias("y"), (F.col("z") - dz).alias("z"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), node.alias("b"))
        met = here.join(there, ["volume_id", "y", "z"]).where((F.col("x0") <= F.col("u1")) & (F.col("u0") <= F.col("x1"))).select("a", "b")
        out = met if out is None else out.union(met)
    return out


def label_voxels(mask: DataFrame, background: float = 255) -> DataFrame:
    """(volume_id, x, y, z, label): 6-connected components numbered from 1 by their first voxel, background 0.

    For volumes of any size: spans are the nodes of a graph over all volumes whose components
    are found by joins. A span's node orders as its first voxel's linear index does, so the
    smallest node of a component gives its rank.
    """
    runs = spans(mask, background)
    node = F.struct("volume_id", "z", "y", "x0")
    found = connected_components(span_edges(runs))
    rooted = runs.withColumn("node", node).join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    firsts = rooted.select("volume_id", "root").distinct()
    ranked = numbered(firsts, "volume_id", ["root"], "label")
    labelled = rooted.join(ranked, ["volume_id", "root"])
    inside = labelled.select("volume_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "z", "label")
    return mask.select(*KEY).join(inside, KEY, "left").select(*KEY, F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def label_stack(values: np.ndarray, background: float = 255) -> np.ndarray:
    """Labels of a stack (n, dz, dy, dx) of masks, numbered in each by its first voxel."""
    n = len(values)
    size = values[0].size
    index = np.arange(values.size).reshape(values.shape)
    on = values != background
    a, b = [], []
    for axis in (1, 2, 3):
        low = tuple(slice(None, -1) if k == axis else slice(None) for k in range(4))
        high = tuple(slice(1, None) if k == axis else slice(None) for k in range(4))
        both = on[low] & on[high]
        a.append(index[low][both])
        b.append(index[high][both])
    root = roots(values.size, np.concatenate(a), np.concatenate(b))
    first = on.ravel() & (root == np.arange(values.size))
    rank = first.reshape(n, size).cumsum(axis=1).ravel()
    return np.where(on.ravel(), rank[root], 0).reshape(values.shape)


def label_bricks(bricks: DataFrame, background: float = 255) -> DataFrame:
    """Bricks with kind <i8 that hold the labels of whole-volume masks; volumes of a batch are labelled together."""

    def run(rows: pa.RecordBatch) -> dict:
        data: list[bytes] = [b""] * rows.num_rows
        for at, values in stacks(rows):
            for k, labels in zip(at, label_stack(values, background)):
                data[k] = labels.astype("<i8").tobytes()
        return {c: rows.column(c) for c in ("volume_id", "dx", "dy", "dz")} | {"kind": ["<i8"] * rows.num_rows, "data": data}

    return per_batch(bricks, run, BRICK)


def segment_info(labels: DataFrame, dims: Dims) -> DataFrame:
    """(volume_id, label, min_*, max_* (exclusive), voxel_num, at_boundary) of each component."""
    boxes = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", lambda a: (F.max(a) + 1).cast("int"))) for a in AXES]
    out = labels.where("label > 0").groupBy("volume_id", "label").agg(*boxes, F.count("*").alias("voxel_num"))
    border = F.lit(False)
    for a, d in zip(AXES, dims):
        border |= (F.col(f"min_{a}") == 0) | (F.col(f"max_{a}") == d)
    return out.withColumn("at_boundary", border)


def label_faces(labels: DataFrame, dims: Dims) -> DataFrame:
    """(volume_id, label, x_pos .. z_neg, dir_none): which faces a component touches; dir_none: all six."""
    touches = {}
    for a, d in zip(AXES, dims):
        touches |= {f"{a}_pos": F.bool_or(F.col(a) == d - 1), f"{a}_neg": F.bool_or(F.col(a) == 0)}
    out = labels.where("label > 0").groupBy("volume_id", "label").agg(*[v.alias(k) for k, v in touches.items()])
    every = F.lit(True)
    for k in touches:
        every &= F.col(k)
    return out.withColumn("dir_none", every)


def face_rows(faces: DataFrame) -> DataFrame:
    """label_faces with a row (volume_id, label, dir_id, touches) for each direction."""
    pairs = ", ".join(f"{k}, {name.lower()}" for k, name in enumerate(DIRECTIONS))
    return faces.selectExpr("volume_id", "label", f"stack(7, {pairs}) AS (dir_id, touches)")


def _flag(name: str) -> str:
    return name.lower()


def filter_segments(info: DataFrame, faces: DataFrame, name: str = "DIR_NONE", invert: bool = True) -> DataFrame:
    """Components that touch a face, or, inverted, that don't."""
    wanted = faces.where(~F.col(_flag(name)) if invert else F.col(_flag(name))).select("volume_id", "label")
    return info.join(wanted, ["volume_id", "label"], "left_semi")


def segment_ratio(info: DataFrame, dims: Dims) -> DataFrame:
    """(volume_id, ratio): the components' share of the whole volume."""
    return info.groupBy("volume_id").agg((F.sum("voxel_num") / float(dims[0] * dims[1] * dims[2])).alias("ratio"))


def labels_at_both(faces: DataFrame, begin: str, end: str) -> DataFrame:
    """Components that touch two faces."""
    return faces.where(F.col(_flag(begin)) & F.col(_flag(end))).select("volume_id", "label")


def selected_mask(labels: DataFrame, selected: DataFrame) -> DataFrame:
    """255 where the label is one of (volume_id, label)."""
    marks = selected.select("volume_id", "label").distinct().withColumn("_on", F.lit(True))
    return labels.join(marks, ["volume_id", "label"], "left").select(*KEY, F.when(F.col("_on"), 255).otherwise(0).alias("v"))


def boundary_volume(labels: DataFrame, dims: Dims, name: str, invert: bool = False) -> DataFrame:
    """255 where the component touches a face, or, inverted, doesn't; the background never is."""
    flag = F.col(_flag(name))
    return selected_mask(labels, label_faces(labels, dims).where(~flag if invert else flag))


def face_partition(labels: DataFrame, dims: Dims, axis: str) -> DataFrame:
    """(volume_id, label, part) of components not touching all faces: pos or neg if they touch one end of an axis only, mid if both."""
    pos, neg = F.col(f"{axis}_pos"), F.col(f"{axis}_neg")
    part = F.when(pos & neg, "mid").when(pos, "pos").when(neg, "neg")
    return label_faces(labels, dims).where(~F.col("dir_none")).select("volume_id", "label", part.alias("part")).where("part IS NOT NULL")


def separate(labels: DataFrame) -> DataFrame:
    """A mask volume for each component: (volume_id, label, x, y, z, v) of its own voxels, all others being 0."""
    return labels.where("label > 0").select("volume_id", "label", *XYZ, F.lit(255).alias("v"))


def palette(spark, colours: int = 26) -> DataFrame:
    """(slot, r, g, b, a): label 0 is transparent, the others get hues at even steps of the golden angle."""
    hue = (F.col("id") * 137.50776405) % 360 / 60
    ramp = lambda shift: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs(F.pmod(hue + shift, F.lit(6.0)) - 3) - 1))
    channel = lambda shift: F.round(ramp(shift) * 255).cast("int")
    return spark.range(colours).select(F.col("id").alias("slot"), channel(0).alias("r"), channel(4).alias("g"), channel(2).alias("b"), F.lit(255).alias("a"))


def colorize(labels: DataFrame, colours: int = 26, selected: DataFrame | None = None) -> DataFrame:
    """(volume_id, x, y, z, r, g, b, a) by label modulo the palette; background and what isn't selected are transparent."""
    if selected is not None:
        labels = labels.join(selected.select("volume_id", "label").distinct(), ["volume_id", "label"], "left_semi")
    painted = labels.withColumn("slot", F.col("label") % colours).join(F.broadcast(palette(labels.sparkSession, colours)), "slot")  # a row for each colour
    clear = F.col("label") == 0
    return painted.select(*KEY, *[F.when(clear, 0).otherwise(F.col(c)).alias(c) for c in "rgba"])


def compact_index(vox: DataFrame, selected, dims: Dims) -> DataFrame:
    """(volume_id, linear, dense): selected voxels numbered from 0 in linear order."""
    linear = (F.col("x") + F.col("y") * dims[0] + F.col("z") * (dims[0] * dims[1])).cast("long")
    chosen = vox.where(selected).select("volume_id", linear.alias("linear"))
    return numbered(chosen, "volume_id", ["linear"], "dense").select("volume_id", "linear", (F.col("dense") - 1).alias("dense"))


def dense_relabel(rows: DataFrame, root: str, by: str = "volume_id") -> DataFrame:
    """rows with label: the rank of their root among those of the volume."""
    return rows.withColumn("label", F.dense_rank().over(Window.partitionBy(by).orderBy(root)).cast("long"))
