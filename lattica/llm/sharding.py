"""Balanced shards by histogram sort."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, durable, shuffle_partitions

#: Probes within each open interval and round.
PROBES = 16
#: Keys are 32 hexadecimal digits, the first half of the text.
SPAN = 1 << 128
#: Columns of its own while rows are dealt; no column of the input may bear these names.
KEY, PART = "_lattica_key", "_lattica_part"


def _key(n: int) -> bytes:
    return b"%032x" % n


@dataclass
class Search:
    """A splitter: keys below it should weigh `target`; it is known to lie in (low, high]."""

    target: float
    tolerance: float
    low: int = 0
    high: int = SPAN - 1
    found: int | None = None


def splitters(keyed: DataFrame, wanted: dict[str, list[tuple[float, float]]], weights: dict[str, str]) -> list[int]:
    """Keys k such that the rows with key < k weigh a wanted share of the whole, within a tolerance.

    keyed: (key, ...). wanted: by weight's name, (share, tolerance), both as fractions of the
    whole; weights: SQL expressions by name. Every round each partition sums the weights between
    sorted probes; at most (splitters * PROBES) sums reach the driver, which narrows each
    interval to the one where its target lies, cut to the smallest and largest key there. So a
    heavy key range, such as many copies of a text, is isolated within a few rounds and then cut
    by the further digits. A splitter between two rows with neighbouring keys is exact.
    """
    names = list(weights)
    totals = keyed.agg(*[F.sum(F.expr(weights[n]).cast("double")).alias(n) for n in names]).first().asDict()
    searches = [(n, Search(share * (totals[n] or 0), tolerance * (totals[n] or 0))) for n in names for share, tolerance in wanted.get(n, [])]
    rows = keyed.select(F.col("key"), *[F.expr(weights[n]).cast("double").alias(n) for n in names])
    schema = "slot int, " + ", ".join(f"{n} double" for n in names) + ", first string, last string"
    while opened := [s for _, s in searches if s.found is None]:
        probes = sorted({s.low + (s.high - s.low) * k // PROBES for s in opened for k in range(1, PROBES + 1)} | {s.low for s in opened} | {s.high + 1 for s in opened})
        shared = keyed.sparkSession.sparkContext.broadcast(np.array([_key(p) for p in probes], "S33"))

        def sums(part: pa.RecordBatch, shared=shared) -> dict:
            keys = np.array(part.column(0).to_pylist(), "S33")
            order = np.argsort(keys)
            keys = keys[order]
            slot = np.searchsorted(shared.value, keys, side="right")
            there, starts = np.unique(slot, return_index=True)
            stops = np.append(starts[1:], len(keys))
            summed = {n: np.add.reduceat(part.column(n).to_numpy()[order], starts) for n in names}
            return {"slot": there.astype(np.int32)} | summed | {"first": [keys[k].decode() for k in starts], "last": [keys[k - 1].decode() for k in stops]}

        got = rows.mapInArrow(batches(sums, schema), schema).groupBy("slot").agg(*[F.sum(n).alias(n) for n in names], F.min("first").alias("first"), F.max("last").alias("last"))
        by_slot = {r["slot"]: r for r in got.collect()}
        below = {n: [0.0, *itertools.accumulate(by_slot[k][n] if k in by_slot else 0.0 for k in range(len(probes) + 1))] for n in names}
        for n, s in searches:
            if s.found is not None:
                continue
            # below[n][k + 1] is the weight of keys < probes[k]
            ahead = [abs(below[n][k + 1] - s.target) for k in range(len(probes))]
            near = min(range(len(probes)), key=ahead.__getitem__)
            slots = [k for k in by_slot if below[n][k] <= s.target < below[n][k + 1] and by_slot[k][n] > 0]
            if ahead[near] <= s.tolerance or not slots:
                s.found = probes[near]
                continue
            row = by_slot[slots[0]]
            first, last = int(row["first"], 16), int(row["last"], 16)
            if first == last:  # one key holds the target: cut on its nearer side
                after = below[n][slots[0] + 1] - s.target < s.target - below[n][slots[0]]
                s.found = first + 1 if after else first
            else:
                s.low, s.high = first, last
        shared.unpersist()
    return [s.found for _, s in searches]


def whole_groups(keyed: DataFrame, borders: list[int], most: float) -> list[int]:
    """The borders, each moved to the nearer edge of the group of equal texts that it cuts, if that moves at most the size `most`."""
    if not borders:
        return borders
    half = 1 << 64
    edges = [(b // half * half, min(SPAN - 1, b // half * half + half)) for b in borders]
    text = lambda k: F.lit(_key(k).decode())
    sums = []
    for k, (b, (low, high)) in enumerate(zip(borders, edges)):
        for side, first, stop in (("a", low, b), ("b", b, high)):
            sums.append(F.coalesce(F.sum(F.when((F.col("key") >= text(first)) & (F.col("key") < text(stop)), F.col("size"))), F.lit(0)).alias(f"{side}{k}"))
    got = keyed.agg(*sums).first()
    out = []
    for k, (b, (low, high)) in enumerate(zip(borders, edges)):
        less, to = min((got[f"a{k}"], low), (got[f"b{k}"], high))
        out.append(to if less <= most else b)
    return out


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", group_tolerance: float = 0.05) -> DataFrame:
    """docs with size, shard and slot (these replace columns of the same names).

    size is the text's length in UTF-8 plus 1 (1 for a null text). Rows are sorted by a key of a
    hash of the text and a hash of the id, so equal texts are neighbours. Shards are ranges of the
    key of nearly equal total size: the borders are off by at most `tolerance` of a shard's size,
    or by half of the row that lies on the border. A border among equal texts is then moved to
    the nearer end of their group, so that they share a shard, if that moves at most
    `group_tolerance` of a shard's size; only a larger group, such as one that holds a third of
    all bytes, is cut, as sizes could not be near equal otherwise. slot numbers the rows of a shard from 0. Rows equal in both id and text have
    one key and stay together. Null ids are one id. Without rows the result is empty.

    Borders are found on the keys and sizes alone. Further borders cut the shards into parts of
    like numbers of rows and bytes, one for each task, and the rows are exchanged once, by part.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("size", "shard", "slot", KEY, PART)]
    digits = [F.lpad(F.lower(F.hex(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull()))), 16, "0") for c in (text_col, id_col)]
    size = (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 1).cast("long")
    rows = docs.select(*kept, F.concat(*digits).alias(KEY), size.alias("size"))
    keyed = durable(rows.select(F.col(KEY).alias("key"), "size"))
    parts = max(shards, shuffle_partitions(spark))
    means = keyed.agg(F.avg("size")).first()[0] or 1.0
    weights = {"bytes": "size", "mixed": f"size + {float(means)!r}D"}
    wanted = {"bytes": [(k / shards, tolerance / shards) for k in range(1, shards)], "mixed": [(k / parts, 0.2 / parts) for k in range(1, parts)]}
    found = splitters(keyed, wanted, weights)
    borders, inner = sorted(found[: shards - 1]), found[shards - 1 :]
    total = keyed.agg(F.sum("size")).first()[0] or 0
    borders = sorted(whole_groups(keyed, borders, group_tolerance * total / shards))
    every = sorted({*borders, *inner})
    shard_of = np.searchsorted(np.array([_key(b) for b in borders], "S33"), np.array([_key(0), *map(_key, every)], "S33"), side="right") if borders else np.zeros(len(every) + 1, int)
    shared = spark.sparkContext.broadcast((np.array([_key(b) for b in every], "S33"), shard_of.astype(np.int32)))

    def part_of(keys: pa.Array) -> np.ndarray:
        return np.searchsorted(shared.value[0], np.array(keys.to_pylist(), "S33"), side="right").astype(np.int32)

    def count(part: pa.RecordBatch) -> dict:
        there, n = np.unique(part_of(part.column(0)), return_counts=True)
        return {"part": there, "n": n}

    counted = keyed.select("key").mapInArrow(batches(count, "part int, n long"), "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
    counts = {r["part"]: r["n"] for r in counted.collect()}  # a row for each part
    starts, used = [], [0] * shards
    for k, s in enumerate(shard_of):
        starts.append(used[s])
        used[s] += counts.get(k, 0)

    def deal(batch_parts):
        for part in batch_parts:
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(part_of(part.column(KEY)))], names=[*part.schema.names, PART])

    def number(batch_parts):
        at: dict[int, int] = {}
        for part in batch_parts:
            which, slots = part.column(PART).to_numpy(), np.empty(part.num_rows, np.int64)
            for k in np.unique(which):
                mine = np.flatnonzero(which == k)
                begin = at.get(k, starts[k])
                slots[mine] = np.arange(begin, begin + len(mine))
                at[k] = begin + len(mine)
            columns = [*(part.column(c) for c in [*kept, "size"]), pa.array(shared.value[1][which]), pa.array(slots)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "size", "shard", "slot"])

    dealt = rows.mapInArrow(deal, rows.withColumn(PART, F.lit(0)).schema).repartitionById(len(every) + 1, PART).sortWithinPartitions(PART, KEY)
    schema = docs.select(*kept, F.lit(0).cast("long").alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema
    return dealt.mapInArrow(number, schema)
