"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, by_pair, connected_components, durable, pack_tiles, roots, shuffle_partitions, slices, tile_pairs, tile_size

#: Shingles whose hashes are summed at a time, so that a very long text needs no more memory.
CHUNK = 1 << 16
#: Pairs compared at a time.
PAIRS = 1 << 21
#: Ids of dropped documents are broadcast up to so many; beyond, documents and ids are shuffled.
DROPPED = 4_000_000
#: Members of candidate groups are broadcast up to so many; beyond, documents and members are shuffled.
MEMBERS = 500_000
#: Rows of a tile, at most.
TILE = 1 << 18
#: Shingles verified in one group; those of a larger component are cut up.
GROUP = 1 << 21


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The kth further hash made of a hash, by multiplications and shifts in 64 bits."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, words: int = 4, parts: int = 1, seed: int = 42) -> list[int]:
    """Parts of 64 bits each, the first from XXH64 of the shingles, the others from hashes of it.

    A bit is 1 if set in over half the hashes. A-Z are lower-cased, words are runs without ASCII
    white space, a text of fewer words than a shingle is one shingle, and a text without words has
    the fingerprint zero.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * parts
    joined = b" ".join(tokens)
    ends = list(itertools.accumulate(len(w) + 1 for w in tokens))
    starts = [0, *ends[:-1]]
    stops = ends[min(words, len(tokens)) - 1 :]
    n, ones = len(stops), np.zeros((parts, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], "<u8")
        for k in range(parts):
            bits = (_mixed(h, k) if k else h).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[k] += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int(np.packbits(2 * o > n, bitorder="little").view("<u8")[0]) for o in ones]


def fingerprints(docs: DataFrame, words: int = 4, parts: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, f1, ...) with the fingerprint's parts as signed longs, one row per document."""
    schema = "id long, " + ", ".join(f"f{k} long" for k in range(parts))

    def run(part: pa.RecordBatch) -> dict:
        prints = np.array([fingerprint(t.as_py(), words, parts) for t in part.column(1)], np.uint64).view(np.int64)
        return {"id": part.column(0)} | {f"f{k}": prints[:, k] for k in range(parts)}

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(batches(run, schema), schema)


def _profile(prints: np.ndarray, radius: int) -> np.ndarray:
    """Population counts of each fingerprint: of its 16-bit words, or, for a radius too wide to tell these apart, of its parts."""
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16 if radius <= 8 else np.uint64)).astype(np.int16)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int):
    """Chunks (i, j) of all row pairs of a and b, (n, parts) uint64, within radius bits.

    Rows are grouped by the population counts of their words; two groups whose counts
    differ by more than the radius in all can hold no such pair and are skipped.
    """
    pa_, pb = _profile(a, radius), _profile(b, radius)
    groups_a, of_a = np.unique(pa_, axis=0, return_inverse=True)
    groups_b, of_b = np.unique(pb, axis=0, return_inverse=True)
    order_a, of_b = np.argsort(of_a, kind="stable"), of_b.ravel()
    bounds = np.searchsorted(of_a.ravel()[order_a], np.arange(len(groups_a) + 1))
    for g, profile in enumerate(groups_a):
        near = np.abs(groups_b - profile).sum(axis=1) <= radius
        if not near.any():
            continue
        cols = np.flatnonzero(near[of_b])
        rows, right = order_a[bounds[g] : bounds[g + 1]], b[cols]
        step = max(1, PAIRS // len(cols))
        for at in range(0, len(rows), step):
            left = a[rows[at : at + step]]
            bits = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
            if a.shape[1] > 1:
                bits = bits.astype(np.uint16)
                for k in range(1, a.shape[1]):
                    bits += np.bitwise_count(left[:, None, k] ^ right[None, :, k])
            i, j = np.nonzero(bits <= radius)
            if len(i):
                yield rows[at : at + step][i], cols[j]


def _links(tiles: list[dict], parts: int, radius: int) -> pa.Table:
    """Edges (a, b) of a spanning forest of the links between two tiles, or within one."""
    both = [np.frombuffer(t["rows"], "<i8").reshape(-1, parts + 1) for t in tiles]
    ids = np.concatenate([s[:, 0] for s in both])
    prints = [np.ascontiguousarray(s[:, 1:]).view(np.uint64) for s in both]
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    label, shift = None, len(both[0]) if len(both) > 1 else 0
    for i, j in close_pairs(prints[0], prints[-1], radius):
        label = roots(len(ids), place[i], place[j + shift], label)
    if label is None:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table({"a": ids[order][label[moved]], "b": ids[order][moved]})


def simhash_links(prints: DataFrame, radius: int, tile_rows: int = 16384) -> DataFrame:
    """Edges (a, b) between ids whose fingerprints differ by at most radius bits.

    prints: (id, f0, ...) with distinct fingerprints. The edges are a spanning forest of the
    links found in each pair of tiles: they join the same ids as all links do, and a group of n
    mutual near copies gives about n of them. A tile holds fingerprints of one population count,
    or of a few that few have, tile_rows of them, or more where that would make over 256 tiles, up
    to TILE; tile pairs whose population counts differ by more than the radius are not compared. Only the number of
    fingerprints for each population count reaches the driver.
    """
    spark = prints.sparkSession
    cols = [c for c in prints.columns if c.startswith("f")]
    parts = len(cols)
    prints = prints.withColumn("pop", sum((F.bit_count(c) for c in cols), F.lit(0)).cast("int"))
    counts = {r["pop"]: r["n"] for r in prints.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    tile_rows = tile_size(sum(counts.values()), tile_rows, TILE)
    first, chunks, tiles, room = {}, {}, [], 0
    for pop in sorted(counts):
        if counts[pop] <= room:  # joins the tile of the next smaller counts
            first[pop], chunks[pop] = len(tiles) - 1, 1
            tiles[-1] = (tiles[-1][0], pop)
            room -= counts[pop]
            continue
        first[pop], chunks[pop] = len(tiles), -(-counts[pop] // tile_rows)
        tiles += [(pop, pop)] * chunks[pop]
        room = tile_rows - counts[pop] if chunks[pop] == 1 else 0
    if not tiles:
        return spark.createDataFrame([], "a long, b long")
    base = F.array(*[F.lit(first.get(p, 0)) for p in range(64 * parts + 1)])
    width = F.array(*[F.lit(chunks.get(p, 1)) for p in range(64 * parts + 1)])
    at = F.col("pop") + 1
    tiled = prints.select((F.element_at(base, at) + F.pmod(F.xxhash64(*cols), F.element_at(width, at)).cast("int")).alias("tile"), "id", *cols)
    blobs = pack_tiles(tiled, len(tiles), lambda t: _blob(t, ["id", *cols]), "tile int, rows binary")
    lows = [low for low, _ in tiles]  # rising
    bands = [(x, x, bisect.bisect_right(lows, high + radius) - 1) for x, (_, high) in enumerate(tiles)]
    run = by_pair(lambda rows: _links(rows, parts, radius))
    return tile_pairs(durable(blobs), bands).mapInArrow(run, "a long, b long")


def _blob(table: pa.Table, cols: list[str]) -> pa.Table:
    rows = np.column_stack([table.column(c).to_numpy() for c in cols]).astype("<i8")
    return pa.table({"tile": table.column("tile").slice(0, 1), "rows": pa.array([rows.tobytes()], pa.binary())})


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, parts: int = 1, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = 16384) -> DataFrame:
    """(id, f0, ..., component): component is the smallest id reachable over links, its own included.

    Equal fingerprints are one node, so a group of copies of any size costs one row in the
    comparison. A null text counts as empty; empty texts all have the fingerprint zero and link.
    A repeated id has a row for each of its rows. A null id takes part in no link and has a null
    component. Other columns of docs are ignored. Without documents the result is empty.
    """
    prints = durable(fingerprints(docs, words, parts, id_col, text_col))
    cols = [f"f{k}" for k in range(parts)]
    nodes = durable(prints.where("id IS NOT NULL").groupBy(*cols).agg(F.min("id").alias("id")))
    component = connected_components(simhash_links(nodes, radius, tile_rows))
    nodes = nodes.join(component.withColumnRenamed("node", "id"), "id", "left").select(*cols, F.coalesce("component", "id").alias("component"))
    return prints.join(nodes, cols, "left").withColumn("component", F.when(F.col("id").isNotNull(), F.col("component")))


def hex_fingerprint(*cols: str):
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in cols])


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The XXH64 hashes of a text's distinct shingles, ascending; shingles are those of fingerprint, a text without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(itertools.accumulate(len(w) + 1 for w in tokens))
    digest = xxhash.xxh64_intdigest
    stops = ends[min(words, len(tokens)) - 1 :]
    return np.unique(np.fromiter((digest(joined[s : e - 1], seed) for s, e in zip([0, *ends], stops)), np.uint64, len(stops)))


def _sketch(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The fingerprint of a set of shingles, each counted once."""
    n, ones = len(hashes), np.zeros((parts, 64), np.int64)
    for at in range(0, n, CHUNK):
        for k in range(parts):
            h = hashes[at : at + CHUNK]
            bits = (_mixed(h, k) if k else h).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[k] += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<i8").ravel()


def _set_key(hashes: np.ndarray) -> int:
    """64 bits that stand for a set of shingles, signed."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), len(hashes)) - (1 << 63)


def _smallest(least: float) -> int:
    """The fewest shingles with which a set can have the similarity `least` to another."""
    return math.ceil(least / (1 - least) - 1e-9)


def shingle_sets(docs: DataFrame, words: int, parts: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """(id, s, n, f0, ...): the key and the number of a text's distinct shingles, and their fingerprint where it can be needed."""
    schema = "id long, s long, n int, " + ", ".join(f"f{k} long" for k in range(parts))
    few = _smallest(least)

    def run(part: pa.RecordBatch) -> dict:
        keys, sizes, prints = [], [], np.zeros((part.num_rows, parts), np.int64)
        for k, text in enumerate(part.column(1)):
            found = shingle_set(text.as_py(), words)
            keys.append(_set_key(found))
            sizes.append(len(found))
            if len(found) >= few:
                prints[k] = _sketch(found, parts)
        return {"id": part.column(0), "s": keys, "n": sizes} | {f"f{k}": prints[:, k] for k in range(parts)}

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(batches(run, schema), schema)


def _candidates(tiles: list[dict], parts: int, radius: int, least: float) -> pa.Table:
    """Edges (a, b) of a spanning forest of the candidate pairs between two tiles, or within one.

    The first half of the parts is compared for all pairs whose sizes allow `least`, the other for those within the radius.
    """
    both = [np.frombuffer(t["rows"], "<i8").reshape(-1, parts + 2) for t in tiles]
    both = [rows[np.argsort(rows[:, 1], kind="stable")] for rows in both]
    a, b, same = both[0], both[-1], len(both) == 1
    left, right = (np.ascontiguousarray(x[:, 2:]).view(np.uint64) for x in (a, b))
    ids = np.concatenate([x[:, 0] for x in both])
    shift, label, half = 0 if same else len(a), None, parts // 2
    step = max(1, PAIRS // max(1, len(b)))
    for at in range(0, len(a), step):
        sizes = a[at : at + step, 1]
        low = np.searchsorted(b[:, 1], math.ceil(sizes[0] * least - 1e-6))
        low = max(low, at) if same else low
        high = np.searchsorted(b[:, 1], math.floor(sizes[-1] / least + 1e-6), side="right")
        if low >= high:
            continue
        bits = np.zeros((len(sizes), high - low), np.uint16)
        for k in range(half):
            bits += np.bitwise_count(left[at : at + step, None, k] ^ right[None, low:high, k])
        i, j = np.nonzero(bits <= radius)
        i, j = i + at, j + low
        keep = np.bitwise_count(left[i, half:] ^ right[j, half:]).sum(axis=1) <= radius
        keep &= (np.minimum(a[i, 1], b[j, 1]) >= least * np.maximum(a[i, 1], b[j, 1]) - 1e-6) & ((i != j) if same else True)
        if keep.any():
            label = roots(len(ids), i[keep], j[keep] + shift, label)
    if label is None:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return pa.table({"a": ids[label[moved]], "b": ids[moved]})


def candidate_links(nodes: DataFrame, radius: int, least: float, tile_rows: int = 16384) -> DataFrame:
    """Edges (a, b) between keys of sets that may have the similarity `least`: a spanning forest for each pair of tiles.

    nodes: (s, n, f0, ...). A tile holds sets of about one size; tiles, and rows within, whose
    sizes differ too much are not compared. The driver sees a count for each twentieth of size.
    """
    spark = nodes.sparkSession
    cols = [c for c in nodes.columns if c.startswith("f")]
    nodes = nodes.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / math.log(1.05)).cast("int"))
    counts = {r["step"]: r for r in nodes.groupBy("step").agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).collect()}
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    tile_rows = tile_size(sum(r["rows"] for r in counts.values()), tile_rows, TILE)
    first, chunks, tiles, room = {}, {}, [], 0
    for step, r in sorted(counts.items()):
        if r["rows"] <= room:
            first[step], chunks[step] = len(tiles) - 1, 1
            tiles[-1] = (tiles[-1][0], r["high"])
            room -= r["rows"]
            continue
        first[step], chunks[step] = len(tiles), -(-r["rows"] // tile_rows)
        tiles += [(r["low"], r["high"])] * chunks[step]
        room = tile_rows - r["rows"] if chunks[step] == 1 else 0
    base, width = (F.array(*[F.lit(of.get(k, 1)) for k in range(max(counts) + 1)]) for of in (first, chunks))
    at = F.col("step") + 1
    tiled = nodes.select((F.element_at(base, at) + F.pmod(F.xxhash64("s"), F.element_at(width, at)).cast("int")).alias("tile"), "s", "n", *cols)
    blobs = pack_tiles(tiled, len(tiles), lambda t: _blob(t, ["s", "n", *cols]), "tile int, rows binary")
    lows = [low for low, _ in tiles]  # rising
    bands = [(x, x, bisect.bisect_right(lows, high / least + 1e-6) - 1) for x, (_, high) in enumerate(tiles)]
    run = by_pair(lambda rows: _candidates(rows, len(cols), radius, least))
    return tile_pairs(durable(blobs), bands).mapInArrow(run, "a long, b long")


def alike(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set the place of the first that it reaches over pairs of the exact Jaccard similarity `least`.

    What has been reached is not compared again, so a group of mutual near copies is compared about once.
    """
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat, ends = flat.ravel(), np.cumsum(size)
    mark, label = np.zeros(flat.max() + 1, bool), np.arange(len(sets))
    todo, rest = label.copy(), flat
    while len(todo):
        queue, root = [todo[0]], todo[0]
        todo, rest = todo[1:], rest[size[todo[0]] :]
        while queue and len(todo):
            at = queue.pop()
            mine = flat[ends[at] - size[at] : ends[at]]
            mark[mine] = True
            shared = np.add.reduceat(mark[rest], np.cumsum(size[todo]) - size[todo], dtype=np.int64)
            mark[mine] = False
            near = shared * (1 + least) >= least * (size[todo] + size[at]) - 1e-6
            if near.any():
                label[todo[near]] = root
                queue += todo[near].tolist()
                rest = rest[np.repeat(~near, size[todo])]
                todo = todo[~near]
    return label


def _verified(table: pa.Table, least: float) -> pa.Table:
    """Edges (a, b) of a spanning forest of the sets (s, shingles) of each component that are alike."""
    held: dict[int, dict[int, np.ndarray]] = {}
    for c, s, shingles in zip(table.column("component").to_pylist(), table.column("s").to_pylist(), table.column("shingles")):
        held.setdefault(c, {})[s] = np.frombuffer(shingles.as_buffer(), "<u8")
    a, b = [], []
    for sets in held.values():
        keys = list(sets)
        for k, root in enumerate(alike([sets[s] for s in keys], least)):
            if k != root:
                a.append(keys[root])
                b.append(keys[k])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def verified_links(docs: DataFrame, members: DataFrame, words: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) between keys of sets that have the similarity `least`, out of the members (id, s, n, component) of candidate components.

    A component of up to GROUP shingles is verified in one group; a larger one is cut into parts
    that all meet each other. Only the members' texts are read again.
    """
    spark = docs.sparkSession
    weights = members.groupBy("component").agg(F.sum("n").alias("n"))
    large = {r["component"]: -(-r["n"] // GROUP) for r in weights.where(F.col("n") > GROUP).collect()}
    total, count = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    base = max(4 * shuffle_partitions(spark), -(-2 * total // GROUP))
    first, at = [], base
    for c, chunks in large.items():
        first.append((c, at, chunks))
        at += chunks * chunks
    members = members.join(F.broadcast(spark.createDataFrame(first, "component long, base long, chunks long")), "component", "left")
    mine = F.pmod(F.xxhash64("s"), F.col("chunks"))
    jobs = F.when(F.col("chunks").isNull(), F.array(F.pmod(F.xxhash64("component"), F.lit(base)))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.col("base") + F.least(k, mine) * F.col("chunks") + F.greatest(k, mine))
    )
    members = members.select("id", "s", "component", jobs.alias("jobs"))
    if count <= MEMBERS:
        members = F.broadcast(members)  # counted just above
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(members, "id")
    schema = "s long, component long, jobs array<long>, shingles binary"

    def run(part: pa.RecordBatch) -> dict:
        sets = [shingle_set(t.as_py(), words) for t in part.column(0)]
        keep = np.array([_set_key(x) == s.as_py() for x, s in zip(sets, part.column(1))], bool)
        rows = part.filter(pa.array(keep))
        return {"s": rows.column(1), "component": rows.column(2), "jobs": rows.column(3), "shingles": [x.astype("<u8").tobytes() for x, k in zip(sets, keep) if k]}

    sets = texts.select("text", "s", "component", "jobs").mapInArrow(batches(run, schema), schema)
    dealt = sets.select(F.explode("jobs").alias("job"), "s", "component", "shingles")
    return dealt.groupBy("job").applyInArrow(lambda t: _verified(t, least), "a long, b long")


def _keyed(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """docs with the key _lattica_s of each text's set of shingles."""
    schema = docs.select("*", F.lit(0).cast("long").alias("_lattica_s")).schema
    at = docs.columns.index(text_col)

    def run(parts):
        for part in slices(parts):
            keys = pa.array([_set_key(shingle_set(t.as_py(), words)) for t in part.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, "_lattica_s"])

    return docs.mapInArrow(run, schema)


def keep_one(docs: DataFrame, words: int = 5, radius: int = 38, parts: int = 2, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """docs without all but one document, the one of the smallest id, of each group of near copies.

    Near copies are texts whose sets of distinct word shingles have the Jaccard similarity `least`,
    and what is joined by chains of such pairs. Fingerprints of the sets only find candidates:
    where the similarity is J, hence the cosine about 2J / (1 + J), each bit differs with the
    probability acos(cosine) / pi, at J = 0.8 in 19 of 128 bits with a deviation of 4, unrelated
    texts in 64 with one of 6. So the radius 38, met by two fingerprints of 64 * parts bits, loses
    few pairs in a million (of sets of four and five, some in a thousand). Every link is then made
    by the exact similarity, up to equal 64-bit hashes. Equal sets are one node, and those too
    small for any other partner, as of an empty or short text, link in no other way.
    Rows with a null id all stay; of rows with one id that are near copies one does.
    """
    prints = durable(shingle_sets(docs, words, 2 * parts, least, id_col, text_col)).where("id IS NOT NULL")
    cols = [f"f{k}" for k in range(2 * parts)]
    nodes = durable(prints.groupBy("s", "n", *cols).agg(F.min("id").alias("id"), F.count("*").alias("rows")))
    candidates = connected_components(candidate_links(nodes.where(F.col("n") >= _smallest(least)).select("s", "n", *cols), radius, least))
    members = durable(nodes.select("s", "n", "id").join(candidates.withColumnRenamed("node", "s"), "s"))
    component = connected_components(durable(verified_links(docs, members, words, least, id_col, text_col)))
    nodes = nodes.select("s", "id", "rows").join(component.withColumnRenamed("node", "s"), "s", "left").where("component IS NOT NULL OR rows > 1")
    nodes = durable(nodes.select("s", "id", F.coalesce("component", "s").alias("component")))
    kept = nodes.groupBy("component").agg(F.min(F.struct("id", "s")).alias("kept"))
    nodes = nodes.join(kept, "component").select("s", "kept")
    dropped = durable(prints.select("id", "s").join(nodes, "s").where(F.struct("id", "s") != F.col("kept")).select("id", "s").distinct())
    few = dropped.count() <= DROPPED
    repeated = durable(prints.groupBy("id").count().where("count > 1").select("id"))
    gone = dropped.select(F.col("id").alias(id_col))
    if repeated.isEmpty():
        return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)  # counted just above
    gone = gone.unionByName(repeated.select(F.col("id").alias(id_col))).distinct()
    out = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    more = _keyed(docs.join(repeated.select(F.col("id").alias(id_col)), id_col).select(*docs.columns), words, text_col)
    more = more.join(dropped.select(F.col("id").alias(id_col), F.col("s").alias("_lattica_s")), [id_col, "_lattica_s"], "left_anti")
    more = more.groupBy(id_col, "_lattica_s").agg(F.min_by(F.struct(*docs.columns), F.coalesce(text_col, F.lit(""))).alias("_lattica_row")).select("_lattica_row.*")
    return out.unionByName(more)
