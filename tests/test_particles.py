import itertools
import math

import numpy as np
import pytest

from lattica.graph import connected_components
from lattica.operators import particles, reshape, sdf


def test_spheres_do_not_overlap(spark):
    made = particles.place_spheres(30, 0.05, 0.1, seed=3)
    assert len(made) == 30
    for a, b in itertools.combinations(made, 2):
        assert np.linalg.norm(a[:3] - b[:3]) >= a[3] + b[3]
    assert (made[:, :3] - made[:, 3:] >= 0).all() and (made[:, :3] + made[:, 3:] <= 1).all()
    assert len(particles.place_spheres(500, 0.2, 0.2, seed=3, max_tries=50)) == 0
    assert particles.place_spheres(5, 0.1, 0.1, 1).tolist() == particles.place_spheres(5, 0.1, 0.1, 1).tolist()


def test_poisson_disk():
    points = particles.poisson_disk(0.3, 10, seed=1)
    assert len(points) == 10 and ((points >= 0) & (points < 1)).all()


def test_hull_and_separation():
    cube = np.array(list(itertools.product((0.0, 1.0), repeat=3)))
    v, f = particles.convex_hull(np.vstack([cube, [[0.5, 0.5, 0.5]]]))
    assert len(v) == 8 and len(f) == 12
    volume = sum(np.dot(v[a], np.cross(v[b], v[c])) for a, b, c in f) / 6
    assert volume == pytest.approx(1.0)
    assert particles.separated(v, v + [1.5, 0, 0], f, f) and not particles.separated(v, v + [0.5, 0.5, 0], f, f)
    with pytest.raises(ValueError):
        particles.convex_hull(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.0]]))


def test_hull_raster(spark):
    cube = [[float(c) / 2 for c in p] for p in itertools.product((0, 1), repeat=3)]
    made = particles.rasterize_hulls(spark.createDataFrame([(0, 0, cube)], "set_id long, id long, points array<array<double>>"), (8, 8, 8))
    assert made.count() == 64


def test_sdf_volume_and_pack():
    ball = sdf.Primitive(np.full(3, 0.5), np.zeros(3))
    low, high = np.full(3, -1.0), np.full(3, 1.0)
    assert sdf.volume_of(sdf.union([ball]), low, high, 6) == pytest.approx(math.pi / 6, rel=0.02)
    assert sdf.total_volume([ball], low, high) == pytest.approx(math.pi / 6, rel=0.03)
    other = sdf.Primitive(np.full(3, 0.5), np.array([0.5, 0.0, 0.0]))
    shared = sdf.overlaps([ball, other], 5)
    lens = math.pi * (4 * 0.5 + 0.5) * (2 * 0.5 - 0.5) ** 2 / 12
    assert shared[0] == shared[1] == pytest.approx(lens, rel=0.1)
    raster = sdf.rasterize([ball], low, high, (16, 16, 16))
    assert (raster == 255).mean() == pytest.approx(math.pi / 48, rel=0.1)
    assert sdf.rasterize([ball, other], low, high, (8, 8, 8), overlap=True).max() in (0, 255)
    items, run = sdf.pack(3, (0.3, 0.3, 0.3), seed=2, max_iter=8)
    assert len(items) == 3 and run.history == sorted(run.history, reverse=True)
    box = sdf.Primitive(np.array([0.5, 0.4, 0.3]), np.zeros(3), kind="box")
    assert box.distance(np.array([[1.0, 0, 0], [0, 0, 0]])) == pytest.approx([0.5, -0.3])


def test_temperatures():
    assert sdf.temperature("linear", 0, 10) == 1 and sdf.temperature("quadratic", 5, 10) == 0.25
    assert sdf.accept(1.0, 0.5, 0.1) == 1 and 0 < sdf.accept(0.5, 0.6, 0.1) < 1 and sdf.accept(0.5, 0.6, 0) == 0


def test_windows_and_crops():
    assert reshape.window_origins((64, 64, 64), (32, 32, 32), (32, 32, 32)) == [[0]] * 3
    assert reshape.window_origins((64, 64, 64), (32, 32, 32), (32, 32, 32), inclusive_end=True) == [[0, 32]] * 3
    assert reshape.clamp_crop((4, 4, 4), (2, 2, 2), (9, 9, 9)) == ((2, 2, 2), (2, 2, 2))
    with pytest.raises(ValueError):
        reshape.clamp_crop((4, 4, 4), (4, 0, 0), (1, 1, 1))
    assert reshape.aspect_size((8, 8, 8), (1.0, 0.5, 2.0)) == (8, 4, 8)


def test_components(spark):
    draw = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2060)] + [(5, 5)]
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {a: root(a) for a in {v for e in edges if e[0] != e[1] for v in e}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_meshes_as_arrays():
    from lattica.functions import meshes

    cube = np.array(list(itertools.product((0.0, 2.0), repeat=3)))
    v, f = particles.convex_hull(cube)
    faces = f.tolist()
    assert meshes.area(v, faces) == pytest.approx(24.0)
    assert meshes.bounds(meshes.normalized(v))[0].tolist() == [-0.5] * 3
    assert np.allclose(np.abs(meshes.normals(v, faces)).sum(axis=1), 1)
    turned = meshes.transformed(v, (1, 0, 0), (0, 0, 0.5**0.5, 0.5**0.5), (2, 1, 1))
    assert np.allclose(meshes.bounds(turned), ([-1, 0, 0], [1, 4, 2]))
    assert meshes.triangle_array(v, meshes.flipped(faces)).shape == (12, 3, 3)
    with pytest.raises(ValueError):
        meshes.triangle_array(v, [[0, 1, 2, 3]])
    assert np.allclose(meshes.sphere_point(np.pi / 2, 0), [1, 0, 0])


def test_most_spheres():
    assert particles.most_spheres(0.45, 1, 50) >= 1 and particles.most_spheres(0.05, 1, most=20) == 20


def test_options(tmp_path):
    from lattica.plans import options

    defaults = {"size": 32, "render": {"on": True, "scale": 1.0}}
    path = str(tmp_path / "o.json")
    options.save(path, {"render": {"scale": 2}})
    assert options.load(path, defaults) == {"size": 32, "render": {"on": True, "scale": 2}}
    for wrong in ({"sise": 1}, {"size": "big"}):
        with pytest.raises(ValueError):
            options.merged(defaults, wrong)


@pytest.mark.parametrize("name", ["sphere_analytic_tau_whole", "argmax_overlap_whole"])
def test_sphere_queries_cover_the_table(spark, name):
    """On sf0.01, whose 2000 spheres fill over the unit cube; sf0.001 has only 200."""
    import duckdb
    from conftest import DATA, same

    import lattica.plans.queries as q

    folder = str(DATA).replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    same(q.QUERIES[name](spark, folder).toPandas(), con.sql(q.ORACLE_SQL[name]).df())
    if name == "sphere_analytic_tau_whole":
        assert q.QUERIES[name](spark, folder).first().n == spark.read.parquet(f"{folder}/part.parquet").count()
