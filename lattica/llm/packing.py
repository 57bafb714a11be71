"""Best-fit packing of tokenised documents after a dominance reduction."""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, durable, small_batches

#: Rows of one length are numbered in so many parts, each by a task of its own.
PARTS = 256


@functools.cache
def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids, equal to tokenizers' encode(text, add_special_tokens=False) of a byte-level BPE file.

    The vocabulary and pattern are handed to tiktoken, which applies the same merges faster,
    provided that the file lists its merges in the order of their ids. The file's added tokens
    are found in texts as that library finds them. Where tiktoken gives up, the library is asked.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    to_byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocabulary = file["model"]["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in file["model"]["merges"]]
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    whole = functools.cache(lambda: Tokenizer.from_file(path))  # read only if it is asked

    def ask(text: str) -> np.ndarray:
        return np.asarray(whole().encode(text, add_special_tokens=False).ids, np.uint32)

    if merged != sorted(merged) or file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return ask
    # Fixed value: the pattern by which byte-level BPE splits texts.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(to_byte[c] for c in token): k for token, k in vocabulary.items() if token not in added}
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as wrong:
            if not isinstance(wrong, Exception) and type(wrong).__name__ != "PanicException":  # its panics are no Exception
                raise
            return ask(text)

    return encode


def cut(n: int, room: int) -> list[int]:
    """Lengths of the pieces of n tokens: all full but the first."""
    return ([n % room] if n % room else []) + [room] * (n // room)


def pieces(docs: DataFrame, path: str, room: int, end: int = 0, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids) for each piece of each document's ids followed by `end`.

    digest: ids_crc32, the checksum of the ids as little-endian 32-bit numbers, in place of the ids.
    """
    name = "ids_crc32" if digest else "ids"
    schema = f"doc_id long, piece int, start long, length long, {name} {'long' if digest else 'binary'}"

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", name)}
        encode = byte_bpe(path)
        for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
            ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
            start = 0
            for k, n in enumerate(cut(len(ids), room)):
                content = ids[start : start + n].tobytes()
                for c, v in zip(out, (doc, k, start, n, zlib.crc32(content) if digest else content)):
                    out[c].append(v)
                start += n
        return out

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(batches(run, schema), schema)


def reduce(counts: dict[int, int], room: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix sets that dominate all other sets holding one of their items; (sets with times, rest).

    For an item j, every set with j that fits is dominated by
    - {j}, if nothing fits beside it;
    - {j, i}, i the largest that fits, if no two others fit, if i fills the rest, or if i is as
      large as any two others that fit together while no three do;
    - {j, a, b}, if no three others fit, a is the largest that fits, b the largest that fits with
      both, and no two others larger than b fit with j: a and b then hold whatever another set
      has beside j.
    Fixing such a set keeps at least one best packing reachable. Sets are fixed as often as their
    items last, by length, so the work depends on the number of lengths and not of items.
    """
    left = {n: c for n, c in counts.items() if c}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*items: int) -> None:
        times = min(left[n] // items.count(n) for n in set(items))
        for n in items:
            left[n] -= times
        for n in set(items):
            if not left[n]:
                del left[n]
        fixed.append((tuple(sorted(items, reverse=True)), times))

    def smallest(k: int, but: int, over: int = 0) -> list[int]:
        """The k smallest items over `over`, without one item of length `but`."""
        out: list[int] = []
        for n in sorted(left):
            if n > over:
                out += [n] * min(k - len(out), left[n] - (n == but))
            if len(out) == k:
                break
        return out

    def largest(most: int, *but: int) -> int:
        """The largest item of at most `most`, beside one item for each of `but`; 0 if none."""
        return max((n for n, c in left.items() if n <= most and c > but.count(n)), default=0)

    def best_two(most: int, but: int) -> int:
        """The largest sum of two items that is at most `most`, without one item of length `but`."""
        there = sorted(n for n, c in left.items() if c > (n == but))
        low, high, best = 0, len(there) - 1, 0
        while low <= high:
            if there[low] + there[high] > most:
                high -= 1
                continue
            if low < high or left[there[low]] - (there[low] == but) > 1:
                best = max(best, there[low] + there[high])
            low += 1
        return best

    for j in sorted(left, reverse=True):  # exact partners first: they hold whatever is left over
        while left.get(j) and (i := room - j) and left.get(i, 0) > (i == j):
            take(j, i)
    again = True
    while again:
        again = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                gap = room - j
                i = largest(gap, j)
                low = smallest(3, j)
                if not i:
                    take(j)
                elif i == gap or len(low) < 2 or low[0] + low[1] > gap:
                    take(j, i)
                elif len(low) < 3 or sum(low) > gap:
                    if best_two(gap, j) <= i:
                        take(j, i)
                    else:
                        b = largest(min(i, gap - i), j, i)
                        above = smallest(2, j, over=b)
                        if b and (len(above) < 2 or sum(above) > gap):
                            take(j, i, b)
                        else:
                            break
                else:
                    break
                again = True
    return fixed, left


def best_fit(counts: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by length: (lengths in one bin, number of such bins).

    Bins of equal content are one entry, so the work depends on the number of lengths.
    """
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[n]
        for gap in sorted(g for g in open_ if g >= n):
            while left and open_.get(gap):
                content, bins = open_[gap].pop()
                each = gap // n  # a bin just used has the smallest gap and is used again
                full = min(bins, left // each)
                rest = left - full * each if full < bins else 0
                if full:
                    open_[gap - each * n].append(((*content, (n, each)), full))
                if full < bins and rest:
                    open_[gap - rest * n].append(((*content, (n, rest)), 1))
                if bins - full - bool(rest):
                    open_[gap].append((content, bins - full - bool(rest)))
                left -= full * each + rest
            if not open_[gap]:
                del open_[gap]
        each = room // n
        if left // each:
            open_[room - each * n].append((((n, each),), left // each))
        if left % each:
            open_[room - left % each * n].append((((n, left % each),), 1))
    return [(tuple(n for n, times in content for _ in range(times)), bins) for held in open_.values() for content, bins in held]


def plan(counts: dict[int, int], room: int) -> dict[str, np.ndarray]:
    """Where the rows of each length go: from rank on, sequences base, base + 1, ... at offset."""
    fixed, rest = reduce(counts, room)
    base, used, rows = 0, defaultdict(int), []
    for lengths, times in [*fixed, *best_fit(rest, room)]:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], base, offset))
            used[n] += times
            offset += n
        base += times
    assert used == {n: c for n, c in counts.items() if c}, "every piece has a place"
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 48 | table[:, 1], "rank": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def place(rows: DataFrame, room: int) -> DataFrame:
    """rows, with a length from 1 to room, doc_id and piece, plus sequence_id and offset.

    The number of rows of each length, at most `room` figures, is collected on the driver.
    Rows of one length are numbered in PARTS parts by a hash of their ids, so that a length that
    most documents share is no task's burden. Where each part begins, at most room * PARTS rows,
    is joined on the parts, by which the rows are dealt already.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int")
    with small_batches(spark):  # rows come from whole texts
        rows = durable(rows.withColumn("_part", part))
    by_part = durable(rows.groupBy("length", "_part").agg(F.count("*").alias("n")))  # room * PARTS rows at most
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(counts, room))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_part").orderBy(*[c for c in rows.columns if c not in ("length", "_part")])
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_first"))
    kept = [c for c in rows.columns if c != "_part"]

    def run(parts):
        where = shared.value
        for batch in parts:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(where["key"], batch.column("length").to_numpy() << 48 | rank, side="right") - 1
            sequence, offset = where["base"][at] + rank - where["rank"][at], where["offset"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = rows.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.select(*kept, F.col("_rank").cast("long")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, room: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece.

    Documents are encoded, followed by the id `end`, cut if longer than room (the first piece is
    the short one) and packed into sequences of at most room ids. A null text counts as empty
    and has the one id `end`. A repeated id has the pieces of each of its rows. A null id is kept.
    Other columns are ignored. Without documents the result is empty.
    """
    return place(pieces(docs, path, room, end, id_col, text_col, digest=True), room)


def sequences(docs: DataFrame, path: str, room: int = 2048, end: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>, doc_ids, lengths): the packed sequences themselves."""
    placed = place(pieces(docs, path, room, end), room)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = placed.groupBy("sequence_id").agg(ordered.alias("p"))

    def run(part: pa.RecordBatch) -> dict:
        joined = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32) for row in part.column(1).to_pylist()]
        return {"sequence_id": part.column(0), "ids": joined, "doc_ids": part.column(2), "lengths": part.column(3)}

    schema = "sequence_id long, ids array<int>, doc_ids array<long>, lengths array<long>"
    return rows.select("sequence_id", "p", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths")).mapInArrow(batches(run, schema), schema)
