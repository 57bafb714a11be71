"""What several operators share: batches, pairs of tiles, and lattica.graph's components and durable tables."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import connected_components, durable, roots

__all__ = ["batches", "by_pair", "connected_components", "durable", "pack_tiles", "roots", "shuffle_partitions", "slices", "small_batches", "tile_pairs", "tile_size"]

#: Bytes of rows that small_batches lets Spark hand to Python at once.
BATCH = 2 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile what is run hands rows to Python in Arrow batches of about BATCH bytes, a row at least.

    An executor holds a batch outside its heap as vectors and as the bytes to send, both of which
    grow by doubling, for each of its tasks. By default that's 10,000 rows or 64 MiB. A size that
    the session sets holds.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key in spark.conf.getAll:
        yield
        return
    spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(key)


def slices(parts: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, not empty and at most `rows` at a time, so that what is made of a batch stays small."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)
        del part
        pa.default_memory_pool().release_unused()


def batches(f, schema: str):
    """mapInArrow body from f(pyarrow.RecordBatch) -> dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            yield pa.RecordBatch.from_pydict(f(part), schema=arrow)

    return run


def tile_size(rows: int, least: int, most: int, tiles: int = 256) -> int:
    """Rows of a tile: `least`, or more where that would make more tiles, but never over `most`, which bounds a task's memory.

    Each tile is sent once to every tile that it meets, so what is moved grows with the number of tiles.
    """
    return min(max(least, -(-rows // tiles)), max(least, most))


def pack_tiles(rows: DataFrame, tiles: int, pack, schema: str) -> DataFrame:
    """One row for each tile, made by pack(pyarrow.Table of the tile's rows); rows: (tile int, ...). Each tile has a task of its own."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [part for part in parts if part.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            for tile in pc.unique(table.column("tile")).sort():
                yield from pack(table.filter(pc.equal(table.column("tile"), tile))).to_batches()

    return rows.repartitionById(tiles, F.col("tile")).mapInArrow(run, schema)


def tile_pairs(tiles: DataFrame, bands: list[tuple[int, int, int]]) -> DataFrame:
    """The rows of both tiles of each pair, one after the other: (tile, ..., pair, tiles).

    tiles: (tile, ...), a row for each tile. bands: (tile, low, high) for each tile that meets
    the tiles low to high, itself perhaps among them; only these, a row for each tile, come from
    the driver. Pairs are numbered without a gap and dealt evenly over the partitions by their
    number; tiles is 1 where a tile is paired with itself, else 2.
    """
    spark, count, rows = tiles.sparkSession, 0, []
    for tile, low, high in bands:
        if low <= high:
            rows.append((tile, low, high, count))
            count += high - low + 1
    if not rows:
        rows = [(-1, -1, -1, 0)]  # meets no tile
    of = spark.createDataFrame(rows, "one int, low int, high int, base long")
    pairs = of.withColumn("other", F.explode(F.sequence("low", "high"))).select((F.col("base") + F.col("other") - F.col("low")).alias("pair"), F.array_distinct(F.array("one", "other")).alias("both"))
    pairs = pairs.select("pair", F.explode("both").alias("tile"), F.size("both").alias("tiles"))
    n = max(1, min(count, 4 * shuffle_partitions(spark)))
    dealt = tiles.join(pairs, "tile").repartitionById(n, F.pmod(F.col("pair"), F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("pair", "tile")


def by_pair(f):
    """mapInArrow body that calls f(list of row dicts) -> pyarrow.Table for each pair of tiles.

    A tile without rows isn't there, and its pairs are skipped.
    """

    def whole(held: list[dict]) -> bool:
        return bool(held) and len(held) == held[0]["tiles"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part in parts:
            for row in part.to_pylist():
                if held and held[0]["pair"] != row["pair"]:
                    if whole(held):
                        yield from f(held).to_batches()
                    held = []
                held.append(row)
        if whole(held):
            yield from f(held).to_batches()

    return run
