"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_pair, durable, pack_tiles, tile_pairs, tile_size
from .embed_dedup import valid

#: Components of a tile's vectors, at most.
TILE = 1 << 22
#: Entries of each list that are read first; every further step reads twice as many.
FIRST = 16


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """For each dimension the rows of x in ascending order."""
    return np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))


class Lists:
    """Candidates with, for each dimension, their rows in ascending and descending order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, up: np.ndarray | None = None):
        """up: (dimensions, n), what sorted_lists(x) gives."""
        self.ids, self.n = ids, len(ids)
        self.up = sorted_lists(x) if up is None else up
        self.down = self.up[:, ::-1]
        self.values = np.take_along_axis(x.T, self.up, axis=1)
        self.x = x
        self.largest = int(np.abs(x).max(initial=0))
        self.single, self.double = None, None

    def rows_for(self, q: np.ndarray) -> np.ndarray:
        """The candidates in the narrowest type in which all scores of q are exact."""
        bound = self.largest * int(np.abs(q).sum())
        if bound < 1 << 24:
            if self.single is None:
                self.single = self.x.astype(np.float32)
            return self.single
        if bound < 1 << 53:
            if self.double is None:
                self.double = self.x.astype(np.float64)
            return self.double
        return self.x

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates but `own`, ties to smaller ids.

        Lists are read from their best end, that is the high one where q is positive and the low
        one where it is negative. What is first seen is scored in full. No candidate that is
        still unseen can score more than the sum over the frontier; reading stops when that is
        less than the kth score. At a tie it goes on, as a smaller id may follow.
        """
        plus, minus = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        x = self.rows_for(q)
        y = q.astype(x.dtype)
        seen, met = np.zeros(self.n, bool), np.zeros(self.n, bool)
        best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, FIRST
        while at < self.n:
            to = min(self.n, at + step)
            if len(plus) + len(minus):
                met[:] = False
                met[self.down[plus, at:to].ravel()] = True
                met[self.up[minus, at:to].ravel()] = True
                met &= ~seen
                new = np.flatnonzero(met)
                seen |= met
            else:  # all scores are zero
                new, to = np.arange(self.n), self.n
            score = (x[new] @ y).astype(np.int64)
            ids = self.ids[new]
            keep = ids != own
            if len(best) == k:
                keep &= score >= best[-1]
            best_ids, best = np.concatenate([best_ids, ids[keep]]), np.concatenate([best, score[keep]])
            if len(best) > k:
                least = np.partition(best, len(best) - k)[len(best) - k]
                best_ids, best = best_ids[best >= least], best[best >= least]
            order = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[order], best[order]
            if to == self.n:
                break
            if len(best) == k:
                frontier = int(q[plus] @ self.values[plus, self.n - to]) + int(q[minus] @ self.values[minus, to - 1])
                if frontier < best[-1]:
                    break
            at, step = to, step * 2
        return best_ids, best


def _search(tiles: list[dict], k: int) -> pa.Table:
    def read(t: dict) -> tuple[np.ndarray, np.ndarray]:
        ids, rows = np.frombuffer(t["ids"], "<i8"), np.frombuffer(t["rows"], "<i8")
        return ids, rows.reshape(len(ids), len(rows) // len(ids))

    held, asked = (next(t for t in tiles if t["asks"] == asks) for asks in (False, True))
    ids, x = read(held)
    lists = Lists(ids, x, np.frombuffer(held["lists"], "<i4").reshape(x.shape[::-1]))
    out: list[list] = [[], [], [], []]
    for ask, own, q in zip(np.frombuffer(asked["numbers"], "<i8"), *read(asked)):
        ids, scores = lists.search(int(own), q, k)
        for column, values in zip(out, (np.full(len(ids), ask), np.full(len(ids), own), ids, scores)):
            column.append(values)
    return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in zip(("ask", "query_id", "id", "score"), out)})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, tile_rows: int = 16384, query_rows: int = 512) -> DataFrame:
    """(query_id, rank, id, score): the k candidates of highest inner product for each query.

    queries and candidates: (id long, v array<long>); a candidate with the query's own id is left
    out, ties go to the smaller id, a query gets all candidates if there are fewer than k, and no
    row if there are none. Vectors meet only vectors of their length; null ids and vectors must
    be left out before. Sums of products must stay within 63 bits. A candidate in several rows
    counts with each of them, and each of several queries of one id has its own k ranks. Each task runs the
    threshold algorithm for one tile of queries over one tile of candidates, whose lists are
    sorted once, with the tile; the k best of each then meet by query.
    """
    spark = queries.sparkSession
    asked = queries.select("id", "v", F.lit(True).alias("asks"), F.monotonically_increasing_id().alias("number"))  # written below, so it stays
    both = durable(candidates.select("id", "v", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("number")).union(asked))
    counts = {(r["n"], r["asks"]): r["c"] for r in both.groupBy(F.size("v").alias("n"), "asks").agg(F.count("*").alias("c")).collect()}
    tiles, rows, bands = 0, [], []
    for n in sorted({n for n, _ in counts}):
        if (n, True) in counts and (n, False) in counts:
            made = {}
            for asks, per in ((False, tile_rows), (True, query_rows)):
                width = -(-counts[n, asks] // tile_size(counts[n, asks], per, TILE // max(1, n)))
                made[asks] = range(tiles, tiles + width)
                rows.append((n, asks, tiles, width))
                tiles += width
            bands += [(q, made[False][0], made[False][-1]) for q in made[True]]
    if not bands:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    spread = spark.createDataFrame(rows, "n int, asks boolean, first int, width int")
    tiled = both.withColumn("n", F.size("v")).join(F.broadcast(spread), ["n", "asks"])  # two rows for each vector length
    tiled = tiled.select((F.col("first") + F.pmod(F.xxhash64("id", "number"), F.col("width")).cast("int")).alias("tile"), "asks", "id", "v", "number")

    def blob(t: pa.Table) -> pa.Table:
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
        ids, numbers = (t.column(c).to_numpy().astype("<i8") for c in ("id", "number"))
        lists = b"" if t.column("asks")[0].as_py() else sorted_lists(x.reshape(len(ids), len(x) // len(ids))).astype("<i4").tobytes()
        made = {"ids": [ids.tobytes()], "numbers": [numbers.tobytes()], "rows": [x.tobytes()], "lists": [lists]}
        return pa.table({"tile": t.column("tile").slice(0, 1), "asks": t.column("asks").slice(0, 1)} | made)

    blobs = durable(pack_tiles(tiled, tiles, blob, "tile int, asks boolean, ids binary, numbers binary, rows binary, lists binary"))
    found = tile_pairs(blobs, bands).mapInArrow(by_pair(lambda tiles: _search(tiles, k)), "ask long, query_id long, id long, score long")
    by_query = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def integer_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of each component, x as double; rows with a null id, a null vector, or a null or non-finite component are left out."""
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(valid(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
