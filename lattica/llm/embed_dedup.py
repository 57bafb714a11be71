"""Embedding near-duplicates by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_pair, connected_components, durable, pack_tiles, roots, tile_pairs, tile_size

#: Rows of the left tile multiplied at a time.
ROWS = 512
#: Pairs recomputed in double precision at a time.
EXACT = 1 << 16
#: Components of a tile's vectors, at most.
TILE = 1 << 24
#: Added to the bound for the rounding of the bound's own arithmetic.
SLACK = 1e-5


def valid(column: str):
    """Whether an array column is set and holds no null, NaN or infinite component."""
    high = float("inf")
    return F.col(column).isNotNull() & F.coalesce(
        F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < high)), F.lit(False)
    )


class Quantised:
    """Unit vectors u = q / scale + r with int8 q; lost = |r| and size = |q / scale| bound the error.

    u.v differs from the product of the quantised vectors by at most lost_u * |v| + lost_v * size_u.
    """

    def __init__(self, x: np.ndarray):
        self.x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norms
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        unit = self.x / self.norm[:, None]
        self.scale = 127.0 / np.abs(unit).max(axis=1)
        self.q = np.rint(unit * self.scale[:, None]).astype(np.int8)
        near = self.q / self.scale[:, None]
        self.lost = np.sqrt(np.square(unit - near).sum(axis=1)) + 1e-12
        self.size = np.sqrt(np.square(near).sum(axis=1))


def similar(a: Quantised, b: Quantised, threshold: float, same: bool):
    """Chunks (i, j) of the pairs with cosine >= threshold; i < j only where both sides are the same.

    The int8 values are multiplied as float32, in which their sums of products are exact up to
    2**24 (1040 dimensions); beyond that as float64.
    """
    kind = np.float32 if a.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = b.q.astype(kind).T
    worst = float(b.lost.max())
    for at in range(0, len(a.q), ROWS):
        rows = slice(at, at + ROWS)
        product = a.q[rows].astype(kind) @ right
        # The product must reach this for the cosine to be possibly over the threshold.
        least = ((threshold - SLACK - a.lost[rows] - worst * a.size[rows]) * a.scale[rows])[:, None] * b.scale[None, :]
        i, j = np.nonzero(product >= least.astype(kind))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), EXACT):
            x, y = i[k : k + EXACT], j[k : k + EXACT]
            cosine = np.einsum("ij,ij->i", a.x[x], b.x[y]) / (a.norm[x] * b.norm[y])
            hit = cosine >= threshold
            if hit.any():
                yield x[hit], y[hit]


def _read(tile: dict) -> tuple[np.ndarray, np.ndarray, Quantised]:
    x = np.frombuffer(tile["rows"], tile["kind"]).reshape(len(tile["ids"]) // 8, -1)
    return np.frombuffer(tile["ids"], "<i8"), np.frombuffer(tile["copies"], "<i8"), Quantised(x.astype(np.float64))


def _links(tiles: list[dict], threshold: float) -> pa.Table:
    """(id, links, root): links found here, copies counted, and an edge of a spanning forest or null."""
    sides = [_read(t) for t in tiles]
    (ids_a, copies_a, a), (ids_b, copies_b, b) = sides[0], sides[-1]
    same = len(sides) == 1
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    shift = 0 if same else len(ids_a)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i, j in similar(a, b, threshold, same):
        np.add.at(links, i, copies_b[j])
        np.add.at(links, j + shift, copies_a[i])
        label = roots(len(ids), place[i], place[j + shift], label)
    links, ids = links[order], ids[order]
    at = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
    return pa.table({"id": ids[at], "links": links[at], "root": ids[label[at]]})


def embedding_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile_rows: int = 8192
) -> DataFrame:
    """(id, n_links, component, kept) for each row of vectors.

    Two rows link if the cosine of their vectors, in double precision, is at least threshold.
    Equal vectors are compared once and counted with their copies. Vectors are dealt into tiles;
    a task multiplies two tiles in int8 and recomputes only pairs that the error bounds leave
    open. Of each pair of tiles come a count for each vector and a spanning forest of its links,
    never the pairs themselves. Vectors of unequal length are not compared. A vector that is
    null, empty, zero, or holds a null or non-finite component, and a null id, has no link and is
    its own component. Repeated rows count as copies. Other columns of vectors are ignored.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    numpy_kind = "<f4" if kind == "float" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    if kind != "float":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    usable = valid("v") & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    good = rows.where(usable)
    nodes = durable(good.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    sizes = {r["n"]: r["c"] for r in nodes.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).collect()}
    spark, first, width, bands = vectors.sparkSession, {}, {}, []
    for n in sorted(sizes):
        per_tile = tile_size(sizes[n], tile_rows if n <= 256 else max(256, tile_rows * 256 // n), min(1 << 16, TILE // n))
        first[n], width[n] = sum(width.values()), -(-sizes[n] // per_tile)
        bands += [(first[n] + x, first[n] + x, first[n] + width[n] - 1) for x in range(width[n])]
    if not bands:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    spread = spark.createDataFrame([(n, first[n], width[n]) for n in first], "n int, first int, width int")
    tiled = nodes.withColumn("n", F.size("v")).join(F.broadcast(spread), "n")  # a row for each vector length
    tiled = tiled.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("width")).cast("int")).alias("tile"), "id", "copies", "v")

    def blob(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(numpy_kind)
        one = lambda name: t.column(name).to_numpy().astype("<i8").tobytes()
        return pa.table({"tile": t.column("tile").slice(0, 1), "ids": [one("id")], "copies": [one("copies")], "rows": [x.tobytes()], "kind": [numpy_kind]})

    blobs = durable(pack_tiles(tiled, len(bands), blob, "tile int, ids binary, copies binary, rows binary, kind string"))
    found = tile_pairs(blobs, bands).mapInArrow(by_pair(lambda tiles: _links(tiles, threshold)), "id long, links long, root long")
    found = durable(found)
    component = connected_components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = (
        nodes.join(links, "id", "left")
        .join(component.withColumnRenamed("node", "id"), "id", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    linked = good.join(known, "v").select("id", F.col("n_links").cast("long").alias("n_links"), "component")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))  # meet no join
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
