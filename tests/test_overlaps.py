"""Overlap joins in crowded cubes, cut into tiles, and over odd rows, against all pairs."""

import itertools

import numpy as np
import pytest

from lattica.operators import particles

BOX = "set_id long, id long, " + ", ".join(f"{e} double" for e in particles.ENDS)


def random_boxes(n: int, seed: int) -> list[tuple]:
    """Of two sets, most in one cube; ids come twice, and some ends are null or the wrong way round."""
    draw = np.random.default_rng(seed)
    out = []
    for k in range(n):
        low = draw.uniform(-0.3, 1.3, 3) if k % 5 == 0 else draw.uniform(0.05, 0.2, 3)
        high = low + draw.uniform(-0.01, 0.15, 3)
        out.append((k % 7 == 0, int(draw.integers(0, n)) if k % 3 == 0 else n + k, *map(float, low), *map(float, high)))
    return out + [(0, 3, None, 0.1, 0.1, 0.2, 0.2, 0.2), (0, None, 0.1, 0.1, 0.1, 0.2, 0.2, 0.2), (0, 4, 0.1, 0.1, 0.1, 0.2, 0.2, None), (None, 5, 0.1, 0.1, 0.1, 0.2, 0.2, 0.2)]


def all_pairs(rows: list[tuple]) -> list[tuple]:
    whole = [r for r in rows if None not in r]
    return sorted((int(a[0]), a[1], b[1]) for a, b in itertools.permutations(whole, 2) if a[0] == b[0] and a[1] < b[1] and all(a[2 + k] <= b[5 + k] and b[2 + k] <= a[5 + k] for k in range(3)))


@pytest.mark.parametrize("tile, few, cells", [(1 << 13, 256, 1 << 19), (16, 1, 64), (40, 8, 1 << 19)])
def test_overlapping_in_tiles(spark, monkeypatch, tile, few, cells):
    for name, value in (("TILE", tile), ("FEW", few), ("CELLS", cells)):
        monkeypatch.setattr(particles, name, value)
    rows = random_boxes(240, seed=4)
    made = particles.overlapping(spark.createDataFrame([(None if r[0] is None else int(r[0]), *r[1:]) for r in rows], BOX), 0.25)
    assert sorted(tuple(r) for r in made.collect()) == all_pairs(rows)
    assert particles.overlapping(spark.createDataFrame([], BOX), 0.25).count() == 0


def test_box_pairs_need_no_join_of_items(spark):
    """A join made every pair of a cube a row before any was tested."""
    from conftest import DATA

    import lattica.plans.queries as q

    assert "Join" not in q.QUERIES["aabb_pairs"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


def test_overlap_counts(spark, monkeypatch):
    """Counted without a row for each pair."""
    from collections import Counter

    monkeypatch.setattr(particles, "TILE", 32)
    rows = random_boxes(240, seed=9)
    made = particles.overlap_counts(spark.createDataFrame([(None if r[0] is None else int(r[0]), *r[1:]) for r in rows], BOX), 0.25)
    count = Counter((s, k) for s, a, b in all_pairs(rows) for k in (a, b))
    assert {(r.set_id, r.id): r.overlap for r in made.collect()} == count


def random_hulls(n: int, seed: int) -> list[np.ndarray]:
    """Octahedra, cubes, and hulls of 5 to 9 points anywhere, small and large."""
    draw, out = np.random.default_rng(seed), []
    signs = np.array(list(itertools.product((-1.0, 1.0), repeat=3)))
    tips = np.concatenate([np.eye(3), -np.eye(3)])
    for k in range(n):
        shape = (tips, signs, draw.normal(size=(int(draw.integers(5, 10)), 3)))[k % 3]
        turn = np.linalg.qr(draw.normal(size=(3, 3)))[0] if k % 2 else np.eye(3)
        out.append(shape @ turn * draw.choice([1e-7, 0.05, 0.1]) + draw.uniform(0, 0.6, 3))
    return out


@pytest.mark.parametrize("tile, shapes", [(1 << 13, 16), (16, 0)])
def test_convex_collisions_by_many(spark, monkeypatch, tile, shapes):
    """Hulls of any number of points, tested many at a time, as by one at a time; a null coordinate meets nothing."""
    monkeypatch.setattr(particles, "TILE", tile)
    monkeypatch.setattr(particles, "SHAPES", shapes)
    shapes = random_hulls(90, seed=6)
    rows = [(0, k, s.tolist()) for k, s in enumerate(shapes)] + [(0, 1000, [[0.1, None, 0.1], *shapes[1].tolist()])]
    items = spark.createDataFrame(rows, "set_id long, id long, points array<array<double>>")
    hulls = [particles.convex_hull(s) for s in shapes]
    boxes = [(v.min(axis=0), v.max(axis=0)) for v, _ in hulls]
    pairs = [(a, b) for a, b in itertools.combinations(range(90), 2) if (boxes[a][0] <= boxes[b][1]).all() and (boxes[b][0] <= boxes[a][1]).all()]
    met = [(a, b) for a, b in pairs if not particles.separated(hulls[a][0], hulls[b][0], hulls[a][1], hulls[b][1])]
    assert 0 < len(met) < len(pairs)
    assert sorted((r.a, r.b) for r in particles.convex_collisions(items, 0.25).collect()) == met


def test_hulls_of_one_shape_share_their_triangles(monkeypatch):
    """One hull is made point by point, not one for each item."""
    import pyarrow as pa

    made, real = [], particles.convex_hull
    monkeypatch.setattr(particles, "convex_hull", lambda p: made.append(1) or real(p))
    tips = np.concatenate([np.eye(3), -np.eye(3)])
    centres = np.random.default_rng(1).uniform(0, 1, (500, 3))
    hulls = particles.Hulls(pa.array([(tips * (0.01 + k / 1000) + c).ravel().tolist() for k, c in enumerate(centres)]))
    assert len(made) == 1 and np.allclose(np.abs(hulls.normals), 3**-0.5)


def test_overlap_volumes_by_many(spark, monkeypatch):
    """Ellipsoids and boxes, turned or not, many pairs at a time, as by one at a time; nulls share nothing."""
    from lattica.operators import sdf

    monkeypatch.setattr(particles, "TILE", 16)
    draw, turned = np.random.default_rng(8), []
    for k in range(60):
        turn = draw.normal(size=4) if k % 3 else np.array([0.0, 0, 0, 1])
        turned.append(sdf.Primitive(draw.uniform(0.03, 0.15, 3), draw.uniform(0, 0.5, 3), turn, ("box", "ellipsoid")[k % 2]))
    columns = "set_id long, id long, kind string, " + ", ".join(f"{c} double" for c in ("px", "py", "pz", "qx", "qy", "qz", "qw", "sx", "sy", "sz"))
    rows = [(0, k, None if k == 1 else i.kind, *map(float, (*i.position, *i.turn, *i.size))) for k, i in enumerate(turned)]
    rows.append((0, 1000, "box", 0.2, 0.2, 0.2, 0.0, 0.0, 0.0, 1.0, 0.1, 0.1, None))
    found = {r.id: r.shared for r in sdf.overlap_volumes(spark.createDataFrame(rows, columns), 0.3).collect()}
    assert found.keys() <= set(range(60))
    assert [found.get(k, 0.0) for k in range(60)] == pytest.approx(sdf.overlaps(turned).tolist(), abs=1e-12)


def test_volumes_of_boxes_need_no_octree(monkeypatch):
    """Of boxes along the axes the overlap is the volume, and one call answers for all pairs."""
    import pyarrow as pa

    from lattica.operators import sdf

    draw, n = np.random.default_rng(2), 200
    columns = {"kind": ["box"] * n} | {f"p{a}": draw.uniform(0, 0.4, n) for a in "xyz"} | {f"q{a}": np.full(n, float(a == "w")) for a in "xyzw"} | {f"s{a}": draw.uniform(0.05, 0.2, n) for a in "xyz"}
    rows = pa.table(columns)
    i, j = np.triu_indices(n, 1)
    one = [sdf.Primitive(*(np.array([r[f"{c}{a}"] for a in "xyz"]) for c in "sp"), kind="box") for r in rows.to_pylist()]
    some = draw.choice(len(i), 300, replace=False)
    want = [sdf.volume_of(sdf.intersection([one[x], one[y]]), *box, 3) if (box := sdf.meet(one[x].bounds(), one[y].bounds())) else 0.0 for x, y in zip(i[some], j[some])]
    monkeypatch.setattr(sdf, "_octree_volumes", None)
    held = sdf.Primitives(rows)
    assert sdf.shared_volumes(held, held, i, j, 3)[some] == pytest.approx(want, rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("share, points", [(1 << 13, 1 << 18), (8, 100)])
def test_raster_of_large_sets(spark, monkeypatch, share, points):
    """A set dealt over tasks, some voxels of some items at a time, as by all items at once; nulls hold nothing."""
    from lattica.operators import sdf

    monkeypatch.setattr(sdf, "SHARE", share)
    monkeypatch.setattr(sdf, "POINTS", points)
    draw, sets = np.random.default_rng(3), {}
    for k in range(50):
        turn = draw.normal(size=4) if k % 2 else np.array([0.0, 0, 0, 1])
        sets.setdefault(k % 2 if k < 48 else 7, []).append(sdf.Primitive(draw.uniform(0.02, 0.4, 3), draw.uniform(-1.2, 1.2, 3), turn))
    columns = "set_id long, id long, " + ", ".join(f"{c} double" for c in ("px", "py", "pz", "qx", "qy", "qz", "qw", "sx", "sy", "sz"))
    rows = [(n, k, *map(float, (*i.position, *i.turn, *i.size))) for n, held in sets.items() for k, i in enumerate(held)]
    rows += [(1, 100, None, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5, 0.5, 0.5), (8, 100, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5, None, 0.5)]
    made = sdf.rasterize_sets(spark.createDataFrame(rows, columns), (12, 10, 8)).collect()
    found = {r.volume_id: np.frombuffer(r.data, np.uint8).reshape(r.dz, r.dy, r.dx) for r in made}
    assert len(made) == len(found) == 4 and not found[8].any()
    for n, held in sets.items():
        want = sdf.rasterize(held, np.full(3, -1.0), np.full(3, 1.0), (12, 10, 8))
        assert (found[n] == want).all() and (want.any() or n == 7)


def test_raster_holds_no_row_of_distances_for_each_item():
    """20,000 items of 4096 voxels, whose distances all at once take 655 MB."""
    import tracemalloc

    import pyarrow as pa

    from lattica.operators import sdf

    draw, n = np.random.default_rng(2), 20_000
    rows = pa.table({f"p{a}": draw.uniform(-1, 1, n) for a in "xyz"} | {f"q{a}": np.full(n, float(a == "w")) for a in "xyzw"} | {f"s{a}": draw.uniform(0.02, 0.2, n) for a in "xyz"})
    data = np.zeros(4096, np.uint8)
    tracemalloc.start()
    sdf.fill(data, sdf.Primitives(rows), np.full(3, -1.0), np.full(3, 1.0), (16, 16, 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert data.any() and peak < 200e6
