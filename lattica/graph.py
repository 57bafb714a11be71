"""Connected components: of one task's nodes with numpy, of any graph with joins."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Edges that one task finishes, once no more are left.
FINISH = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and all runs in one machine (unit tests) a local folder is
    taken; on a cluster, whose executors could not read it, that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lattica-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and it outlives any executor.

    The read table has its true size, so that joins with small ones are planned well, where the
    estimate of a plain checkpoint would multiply with each join of a loop. The table is removed
    when the application ends, or by discard, for which its path is added to kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    if kept is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder name for files in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that nothing reads any more."""
    for path in paths:
        place, system = _place(spark, path)
        system.delete(place, True)
    paths.clear()


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n local nodes the smallest node it reaches over the edges (a, b).

    label: the result of an earlier call, to which these edges are added.
    """
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with a column `name`: each row's place, from 1, in its group `by` in the order of `order`.

    For groups of any size: rows are dealt by ranges of (by, *order), so that no task holds a
    whole group, numbered within each range, and moved on by what the group has in earlier ones.
    """
    part, n, before = "_lattica_part", "_lattica_n", "_lattica_before"
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by, *order)
    dealt = durable(dealt.withColumn(part, F.spark_partition_id()))
    earlier = Window.partitionBy(by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(by, part).agg(F.count("*").alias(n)).select(by, part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(by, part).orderBy(*order)) + F.col(before)
    return dealt.join(counts, [by, part]).withColumn(name, place.cast("long")).drop(part, before)


def _both_ways(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ways).alias("e")).select("e.a", "e.b")


def _finish(edges: DataFrame) -> DataFrame:
    """(a, to): each node of few edges that isn't the smallest it reaches, with that one; found in one task."""

    def run(parts):
        held = [part for part in parts if part.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        kind, n = table.column("a").type, table.num_rows
        if pa.types.is_integer(kind):
            names, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in "ab"]), return_inverse=True)
            name = lambda k: pa.array(names[k], kind)
        else:  # structs order by their fields, nulls first
            items = [v for c in "ab" for v in table.column(c).to_pylist()]
            keys = [tuple((x is not None, x) for x in v.values()) if isinstance(v, dict) else v for v in items]
            value = dict(zip(keys, items))
            names = sorted(value)
            number = {key: k for k, key in enumerate(names)}
            at = np.array([number[key] for key in keys])
            name = lambda k: pa.array([value[names[j]] for j in k], kind)
        label = roots(len(names), at[:n], at[n:])
        moved = np.flatnonzero(label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([name(moved), name(label[moved])], names=["a", "to"])

    return edges.coalesce(1).mapInArrow(run, edges.select("a", F.col("b").alias("to")).schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph with edges (a, b), as (node, component), for nodes that have edges.

    component is the smallest node reachable. Nodes may be of any type that has an order, structs
    too. Each round hooks every node to its smallest smaller neighbour, shortens the chains once,
    and contracts the edges; only how many edges are left reaches the driver, and as soon as they
    are at most FINISH one task finishes them. A hub only costs in the two joins of the
    contraction, which adaptive execution can split; the minimum is combined map-side. Edges with a null end and loops are left out; without edges the result is empty.
    """
    spark, old = edges.sparkSession, []
    ordered = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = durable(ordered.distinct(), old)
    label = durable(_both_ways(edges).select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), old)
    while left := edges.count():
        used, old = old, []
        if left <= FINISH:
            moved = _finish(edges).select(F.col("a").alias("component"), "to")
            label = durable(label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
            discard(spark, used)
            return label
        hook = _both_ways(edges).groupBy("a").agg(F.min("b").alias("to")).where("to < a")  # read twice below, shuffled once
        further = hook.select(F.col("a").alias("to"), F.col("to").alias("further"))
        hook = durable(hook.join(further, "to", "left").select("a", F.coalesce("further", "to").alias("to")), used)
        for side, other in (("a", "b"), ("b", "a")):
            moved = hook.select(F.col("a").alias(side), F.col("to").alias("to"))
            edges = edges.join(moved, side, "left").select(F.coalesce("to", side).alias(side), other).select("a", "b")
        ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = durable(ordered.distinct(), old)
        moved = hook.select(F.col("a").alias("component"), "to")
        label = durable(label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), old)
        discard(spark, used)
    return label
