import numpy as np
import pytest

from lattica.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute_links(vectors, threshold=0.9):
    good = {i: np.asarray(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / (np.sqrt(good[a] @ good[a]) * np.sqrt(good[b] @ good[b])) >= threshold}


def make(n=120, dims=16, seed=0):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(12, dims))
    out = [(base[draw.integers(12)] + draw.normal(size=dims) * draw.choice([0.05, 0.3, 0.6])).astype(np.float32).tolist() for _ in range(n)]
    return [*out, out[0], out[0], [2 * x for x in out[1]], None, [0.0] * dims, [float("nan")] * dims, [None] * dims, [float("inf")] * dims, [], [1.0, 2.0], [1.0, 2.1]]


@pytest.mark.parametrize("tile_rows", [16, 8192])
def test_links_and_components(spark, tile_rows):
    rows = [(5000 - 3 * k, v) for k, v in enumerate(make())]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = {r.id: r for r in embed_dedup.embedding_duplicates(df, tile_rows=tile_rows).collect()}
    links = brute_links([(i, None if v is None else v) for i, v in rows])
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].n_links == sum(a == i for a, _ in links)
        assert (got[i].component, got[i].kept) == (find(i), find(i) == i)


def test_bounds_lose_no_pair():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 8)) * np.exp(draw.normal(size=(300, 1)) * 20)
    q = embed_dedup.Quantised(x)
    got = {(int(i), int(j)) for I, J in embed_dedup.similar(q, q, 0.9, True) for i, j in zip(I, J)}
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.9}
    assert got == want and want


def test_no_vectors(spark):
    assert embed_dedup.embedding_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, 0, ""), (None, [1.0], 0, "")], SCHEMA)
    assert {(r.id, r.n_links, r.kept) for r in embed_dedup.embedding_duplicates(only).collect()} == {(1, 0, True), (None, 0, True)}


def brute_top(rows, k):
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("tile_rows,query_rows", [(10, 1), (16384, 512)])
def test_top_k(spark, tile_rows, query_rows):
    rows = [(7 * k if k % 2 else 50 * k, v) for k, v in enumerate(make(150, 6, 2))]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    vectors = topk.integer_vectors(df)
    got = topk.top_k(vectors.where("id % 50 = 0"), vectors, 5, tile_rows, query_rows)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "id", "score").collect()) == brute_top(rows, 5)


def test_top_k_ties_and_few(spark):
    rows = [(50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (100, [0.0, 0.0]), (7, None)]
    vectors = topk.integer_vectors(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA))
    got = topk.top_k(vectors.where("id % 50 = 0"), vectors, 5).collect()
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == brute_top(rows, 5)
    assert topk.top_k(vectors.where("false"), vectors).count() == 0


def test_threshold_algorithm_stops_early():
    draw = np.random.default_rng(1)
    x = draw.integers(-50, 50, (4000, 3))
    x[5] = [1000, 1000, -1000]
    lists = topk.Lists(np.arange(4000), x)
    ids, scores = lists.search(-1, np.array([3, 2, -1]), 1)
    assert ids.tolist() == [5] and scores.tolist() == [6000]
    big = topk.Lists(np.arange(3), np.array([[1 << 30], [(1 << 30) + 1], [5]]))
    assert big.search(-1, np.array([1 << 30]), 2)[0].tolist() == [1, 0]


def test_repeated_query_rows_are_ranked_apart(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [0.5, 0.0]), (3, [0.5, 0.0]), (2, [0.25, 0.0])]
    vectors = topk.integer_vectors(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA))
    got = topk.top_k(vectors.where("id = 50"), vectors, 2, tile_rows=2, query_rows=1).collect()
    assert sorted(tuple(r) for r in got) == 2 * [(50, 1, 3, 32768)] + 2 * [(50, 2, 3, 32768)]
