"""Values derived by hand for small masks, and properties that hold for any."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from lattica.operators import diffusion, segment, surface
from lattica.operators.diffusion import Stack, bicgstab, cg, stack_tortuosity
from lattica.plans import actions
from lattica.volumes import SMALL, pack, parse_directions, to_bricks, to_voxels

z, y, x = np.indices((4, 4, 4))
CASES = [
    (z < 0, 1, 1.0, 1.0, 1.0, 1.0, 0.0),
    (y >= 2, 0.5, 0.999000999, 0.999000999, 150.409896933, 0.5, 1.0),
    (x >= 2, 0.5, 150.409896933, 250.416211087, 0.999000999, None, 1.0),
    ((x > 0) & (x < 3) & (y > 0) & (y < 3) & (z > 0) & (z < 3), 0.875, 1.046507589, 1.046507589, 1.046507589, 0.862854345, 0.433012702),
    ((x == 1) & (y == 1) & (z == 1), 0.984375, 1.001707913, 1.00151779, 1.001707913, 0.969240159, 0.0),
    ((x + 2 * y + 3 * z) % 5 == 0, 0.796875, 1.051401348, 1.035147720, 1.043576321, 0.705150288, 0.233253175),
]


@pytest.mark.parametrize("case", CASES, ids=["pore", "parallel", "series", "block", "voxel", "planes"])
def test_golden_values(case):
    solid, porosity, *taus, loose, area = case
    mask = np.where(solid, 255, 0)[None]
    assert (mask == 0).mean() == porosity
    for solve in (cg, bicgstab):
        for name, tau in zip(("X_POS", "X_NEG", "Y_POS"), taus):
            s = Stack(mask, name)
            found, good, _ = solve(s, 1e-10)
            assert good.all()
            assert stack_tortuosity(mask, s, found, good)[0] == pytest.approx(tau, rel=1e-6)
    s = Stack(mask, "X_POS")
    found, good, _ = cg(s, 1e-10)
    value = stack_tortuosity(mask, s, found, good, True)[0]
    assert np.isnan(value) if loose is None else value == pytest.approx(loose, rel=1e-6)
    assert surface.stack_area(mask)[0] == pytest.approx(area, abs=1e-8)


def test_area_of_a_block():
    c, b, a = np.indices((8, 8, 8))
    inside = (a > 1) & (a < 6) & (b > 1) & (b < 6) & (c > 1) & (c < 6)
    assert surface.stack_area(np.where(inside, 255, 0)[None])[0] == pytest.approx(1.013583261)


def test_every_case_closes():
    """Each cut edge of a case belongs to its triangles, and triangles of whole and empty cells are none."""
    made = surface.cases()
    assert made[0] == [] and made[255] == []
    for case, triangles in enumerate(made):
        cut = {k for k, (p, q) in enumerate(surface.EDGES) if (case >> p & 1) != (case >> q & 1)}
        assert {e for t in triangles for e in t} == cut


masks = arrays(np.uint8, (5, 4, 3), elements=st.sampled_from([0, 255]))


@settings(max_examples=40, deadline=None)
@given(masks)
def test_residual_and_agreement(mask):
    s = Stack(mask[None], "Z_POS")
    a, ok_a, _ = cg(s, 1e-9)
    b, ok_b, _ = bicgstab(s, 1e-9)
    assert ok_a.all() and ok_b.all()
    r = s.b - s.times(a)
    assert (r * r).sum() <= 1e-17 * (s.b * s.b).sum()
    assert np.allclose(a, b, atol=1e-5)


@settings(max_examples=40, deadline=None)
@given(masks)
def test_labels(mask):
    labels = segment.label_stack(mask[None])[0]
    assert ((labels > 0) == (mask == 0)).all()
    turned = segment.label_stack(mask.transpose(2, 0, 1)[None])[0]
    assert labels.max() == turned.max()
    firsts = [np.flatnonzero(labels.ravel() == k)[0] for k in range(1, labels.max() + 1)]
    assert firsts == sorted(firsts)


def test_pores_that_touch_at_edges_stay_apart():
    mask = np.full((1, 4, 4, 4), 255)
    mask[0, 0, 0, 0] = mask[0, 3, 3, 3] = mask[0, 0, 1, 1] = 0
    labels = segment.label_stack(mask)[0]
    assert (labels[0, 0, 0], labels[0, 1, 1], labels[3, 3, 3]) == (1, 2, 3)
    touches = actions.faces_of(labels[None])[0]
    assert touches[:, 1].tolist() == [False, True, False, True, False, True]
    assert touches[:, 3].tolist() == [True, False, True, False, True, False]


def _bricks(spark, masks):
    rows = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(masks)], "id long, m array<int>")
    return pack(rows, SMALL, "id", "m")


def test_relational_solver_agrees(spark):
    solid = [np.where(c[0], 255, 0) for c in CASES[3:5]]
    bricks = _bricks(spark, solid)
    vox = to_voxels(bricks)
    system = diffusion.system(vox, SMALL, "X_POS")
    found, steps = diffusion.solve_relational(system, SMALL, 1e-4, 12)
    ours = {tuple(r[:4]): r[4] for r in found.select("volume_id", "x", "y", "z", "c").collect()}
    for k, mask in enumerate(solid):
        c, _, _ = cg(Stack(mask[None], "X_POS"), 1e-8)
        for (v, a, b, d), value in ours.items():
            if v == k:
                assert value == pytest.approx(c[0, d, b, a], abs=2e-3)


def test_actions(spark):
    bricks = _bricks(spark, [np.where(c[0], 255, 0) for c in CASES])
    tau = {(r.ID, r.dir): r.tau for r in actions.tau(bricks, ["X_POS", "X_NEG"], tolerance=1e-9).collect()}
    assert tau["5", "X_NEG"] == pytest.approx(1.03514772, rel=1e-5)
    alpha = actions.alpha(bricks, ["X_POS"], segments=True).toPandas().set_index(["ID", "dir"])
    assert alpha.loc[("3", "DIR_NONE"), "rad"] == pytest.approx(0.433012702)
    assert {r.ID: r.radBasic for r in actions.alpha_basic(bricks).collect()}["1"] == pytest.approx(1.0)
    cut = actions.slices(bricks, (2, 2, 2), (2, 2, 2)).count()
    assert cut == 6 * 3  # the last window is left out along each axis
    assert actions.slices(bricks, (2, 2, 2), (2, 2, 2), inclusive_end=True).count() == 6 * 8 * 3
    again = to_bricks(to_voxels(bricks), SMALL)
    assert sorted(bytes(r.data) for r in again.collect()) == sorted(bytes(r.data) for r in bricks.collect())


def test_direction_flags():
    assert parse_directions("x-") == ["X_POS"] and parse_directions("yz") == ["Y_POS", "Z_POS"]
    assert parse_directions("neg") == ["X_NEG", "Y_NEG", "Z_NEG"] and parse_directions("?") == ["X_POS"]


def test_partition_meshes(spark):
    mask = np.full((4, 4, 4), 255)
    mask[:, 1, :2] = 0  # touches the near end of x only, and both ends of z
    mask[1, 3, :] = 0  # both ends of x
    vox = to_voxels(segment.label_bricks(_bricks(spark, [mask]))).withColumnRenamed("v", "label")
    made = actions.partition_meshes(vox.withColumn("label", vox.label.cast("long")), SMALL, "x")
    assert made["pos"][0].count() == 0 and made["neg"][0].count() > 0 and made["neg"][1].count() > 0


def test_tortuosity_by_joins_agrees(spark, monkeypatch):
    """Volumes whose solver does not fit into a task are solved by joins, with the same figures."""
    from lattica.operators import diffusion
    from lattica.plans import actions
    from lattica.volumes import BRICK

    draw = np.random.default_rng(4)
    rows = [(k, 4, 3, 5, "<u1", np.where(draw.random((5, 3, 4)) < 0.4, 255, 0).astype(np.uint8).tobytes()) for k in range(3)]
    bricks = spark.createDataFrame(rows, BRICK)
    small = {(r.ID, r.dir): (r.tau, r.porosity) for r in actions.tau(bricks, ["X_POS", "Y_NEG"], tolerance=1e-8).collect()}
    monkeypatch.setattr(actions, "MEMORY", 1)
    large = {(r.ID, r.dir): (r.tau, r.porosity) for r in actions.tau(bricks, ["X_POS", "Y_NEG"], tolerance=1e-8).collect()}
    assert large.keys() == small.keys() and len(small) == 6
    for key, figures in small.items():
        assert large[key] == pytest.approx(figures, rel=1e-5)
    assert actions.tau(bricks, ["X_POS"], oversubscribe=True).count() == 3
    assert diffusion.memory_needed(10, "BICGSTAB", np.float32) == 360


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_within_groups_of_any_size(spark, partitions):
    from lattica.graph import numbered

    draw = np.random.default_rng(2)
    rows = [(int(g), int(k)) for g, k in zip(draw.integers(0, 3, 500), draw.permutation(500))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(tuple(r) for r in numbered(spark.createDataFrame(rows, "g long, k long"), "g", ["k"], "place").select("g", "k", "place").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, seen = [], {}
    for g, k in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want.append((g, k, seen[g]))
    assert got == want
    assert numbered(spark.createDataFrame([], "g long, k long"), "g", ["k"], "place").count() == 0


@pytest.mark.parametrize("finish", [0, 20, 1 << 17])
@pytest.mark.parametrize("kind", ["long", "string", "struct<g: long, k: string>"])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, finish, kind):
    from lattica import graph

    monkeypatch.setattr(graph, "FINISH", finish)
    draw = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 120, (100, 2))] + [(200 + k, 201 + k) for k in range(30)]
    name = {"long": lambda k: k, "string": lambda k: f"{k:04d}"}.get(kind, lambda k: (k // 50, f"{k:04d}" if k % 50 else None))
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"a {kind}, b {kind}")
    label = graph.roots(300, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    want = {name(k): name(int(label[k])) for pair in pairs if pair[0] != pair[1] for k in pair}
    plain = lambda v: tuple(v) if isinstance(v, tuple) else v
    got = {plain(r.node): plain(r.component) for r in graph.connected_components(edges).collect()}
    assert got == want
