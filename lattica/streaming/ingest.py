"""Measure volumes as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.actions import measure
from ..sources.codecs import decode_volume
from ..volumes import BRICK, per_batch


def arriving_volumes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of bricks from .bin files that appear in a folder."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.bin").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def run(rows):
        made = [decode_volume(b) for b in rows.column("content").to_pylist()]
        dims = {f"d{a}": [d[k] for _, d, _ in made] for k, a in enumerate("xyz")}
        return {"volume_id": rows.column("volume_id")} | dims | {"kind": [m[0] for m in made], "data": [m[2] for m in made]}

    return per_batch(files.select(F.xxhash64("path").alias("volume_id"), "content"), run, BRICK)


def measure_arriving(spark: SparkSession, folder: str, out: str, checkpoint: str, names: list[str] = ("X_POS",)) -> StreamingQuery:
    """Append measures of each new volume to a Parquet table, once each: the batch number is part of its path."""

    def write(batch: DataFrame, number: int) -> None:
        measure(batch, list(names)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = arriving_volumes(spark, folder).writeStream.foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
