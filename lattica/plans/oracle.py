"""SQL, as DuckDB reads it, for the queries that SQL can express."""

from __future__ import annotations

from ..operators.surface import CORNERS, EDGES, ISO, cases

H = 0.25  # the grid step of the small volumes
XYZ = ("x", "y", "z")

EV = """ev AS MATERIALIZED (
    SELECT vec_id::BIGINT AS volume_id, (i % 4)::INT AS x, ((i // 4) % 4)::INT AS y, (i // 16)::INT AS z, embedding[i + 1]::DOUBLE AS v
    FROM embeddings, range(0, 64) t(i)
), evm AS MATERIALIZED (SELECT volume_id, x, y, z, (CASE WHEN v < 0 THEN 0 ELSE 255 END)::INT AS v FROM ev)"""

LV = """lvc AS (
    SELECT (l_partkey % 32)::INT AS x, (l_suppkey % 32)::INT AS y, (l_orderkey % 32)::INT AS z, count(*) AS n FROM lineitem GROUP BY ALL
), grid AS (
    SELECT (i % 32)::INT AS x, ((i // 32) % 32)::INT AS y, (i // 1024)::INT AS z FROM range(0, 32768) t(i)
), lv AS (SELECT 0::BIGINT AS volume_id, x, y, z, coalesce(n, 0)::DOUBLE AS v FROM grid LEFT JOIN lvc USING (x, y, z)),
lvm AS (SELECT volume_id, x, y, z, (CASE WHEN v * 32768 >= (SELECT count(*) FROM lineitem) THEN 255 ELSE 0 END)::INT AS v FROM lv)"""

PT = """pt AS (
    SELECT p_partkey::BIGINT AS id, (p_partkey * 37 % 101) / 101.0::DOUBLE AS px, (p_partkey * 53 % 103) / 103.0::DOUBLE AS py,
           (p_partkey * 71 % 107) / 107.0::DOUBLE AS pz, p_size / 1000.0::DOUBLE AS r FROM part
)"""

#: 6-connected pore components of the small masks, numbered by their first voxel.
CCL = f"""{EV}, p AS (SELECT volume_id, x, y, z, x + 4 * y + 16 * z AS i FROM evm WHERE v = 0),
e AS (SELECT a.volume_id, a.i AS a, b.i AS b FROM p a JOIN p b ON a.volume_id = b.volume_id AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
reach AS (SELECT volume_id, i, i AS root FROM p UNION SELECT e.volume_id, e.b, r.root FROM reach r JOIN e ON r.volume_id = e.volume_id AND r.i = e.a),
rooted AS (SELECT volume_id, i, min(root) AS root FROM reach GROUP BY ALL),
ccl AS (
    SELECT m.volume_id, m.x, m.y, m.z, coalesce(l.label, 0)::BIGINT AS label FROM evm m LEFT JOIN (
        SELECT volume_id, i, dense_rank() OVER (PARTITION BY volume_id ORDER BY root) AS label FROM rooted
    ) l ON l.volume_id = m.volume_id AND l.i = m.x + 4 * m.y + 16 * m.z
), faces AS (
    SELECT volume_id, label, bool_or(x = 3) AS x_pos, bool_or(x = 0) AS x_neg, bool_or(y = 3) AS y_pos, bool_or(y = 0) AS y_neg,
           bool_or(z = 3) AS z_pos, bool_or(z = 0) AS z_neg FROM ccl WHERE label > 0 GROUP BY ALL
), allfaces AS (SELECT *, x_pos AND x_neg AND y_pos AND y_neg AND z_pos AND z_neg AS dir_none FROM faces),
info AS (
    SELECT volume_id, label, min(x)::INT AS min_x, min(y)::INT AS min_y, min(z)::INT AS min_z, (max(x) + 1)::INT AS max_x, (max(y) + 1)::INT AS max_y,
           (max(z) + 1)::INT AS max_z, count(*) AS voxel_num FROM ccl WHERE label > 0 GROUP BY ALL
), infob AS (SELECT *, min_x = 0 OR min_y = 0 OR min_z = 0 OR max_x = 4 OR max_y = 4 OR max_z = 4 AS at_boundary FROM info)"""


def neighbour_columns(dims: int, boundary: str, column: str = "v", prefix: str = "") -> str:
    """Select items for the six neighbours by window functions."""
    out = []
    for a in XYZ:
        others = ", ".join(b for b in XYZ if b != a)
        over = f"OVER (PARTITION BY volume_id, {others} ORDER BY {a})"
        whole = f"OVER (PARTITION BY volume_id, {others} ORDER BY {a} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        for side, step, far in (("neg", "lag", "last_value"), ("pos", "lead", "first_value")):
            value = f"{step}({column}) {over}"
            if boundary == "clamp":
                value = f"coalesce({value}, {column})"
            elif boundary == "periodic":
                value = f"coalesce({value}, {far}({column}) {whole})"
            out.append(f"{value} AS {prefix}{a}_{side}")
    return ", ".join(out)


def cells(source: str, key: str = "volume_id") -> str:
    """CTEs that end in `cells` (key, x, y, z, f0 .. f7, cubeindex)."""
    ctes, names, previous = [f"m0 AS (SELECT {key}, x, y, z, v / 255.0::DOUBLE AS v FROM {source})"], ["v"], "m0"
    for k, a in enumerate(XYZ):
        others = ", ".join(b for b in XYZ if b != a)
        over = f"OVER (PARTITION BY {key}, {others} ORDER BY {a})"
        items, made = [], []
        for n in names:
            items += [f"(coalesce(lag({n}) {over}, {n}) + {n}) / 2 AS {n}0", f"({n} + coalesce(lead({n}) {over}, {n})) / 2 AS {n}1"]
            made += [f"{n}0", f"{n}1"]
        ctes.append(f"m{k + 1} AS (SELECT {key}, x, y, z, {', '.join(items)} FROM {previous})")
        names, previous = made, f"m{k + 1}"
    at = ["v" + "".join(map(str, c)) for c in CORNERS]
    index = " + ".join(f"(CASE WHEN {n} < {ISO} THEN {1 << k} ELSE 0 END)" for k, n in enumerate(at))
    corners = ", ".join(f"{n} AS f{k}" for k, n in enumerate(at))
    ctes.append(f"cells AS (SELECT {key}, x, y, z, {corners}, ({index})::INT AS cubeindex FROM m3)")
    return ", ".join(ctes)


def areas(source: str, dims: int, key: str = "volume_id") -> str:
    """CTEs that end in `areas` (key, area)."""
    rows = ", ".join(f"({k}, {t[0]}, {t[1]}, {t[2]})" for k, made in enumerate(cases()) for t in made)

    def coordinate(k: int) -> str:
        items = []
        for p, q in EDGES:
            way = CORNERS[q][k] - CORNERS[p][k]
            t = f"(CASE WHEN f{p} = f{q} THEN 0 ELSE ({ISO} - f{p}) / nullif(f{q} - f{p}, 0) END)"
            items.append(f"({XYZ[k]} + {CORNERS[p][k]}" + (f" + {t} * {way}" if way else "") + f")::DOUBLE / {dims}")
        return f"[{', '.join(items)}]"

    lists = ", ".join(f"{coordinate(k)} AS p{a}" for k, a in enumerate(XYZ))
    side = lambda name, e: ", ".join(f"p{a}[{e} + 1] - p{a}[e0 + 1] AS {name}{a}" for a in XYZ)
    return f"""{cells(source, key)}, tri(cubeindex, e0, e1, e2) AS (VALUES {rows}),
points AS (SELECT {key}, cubeindex, {lists} FROM cells WHERE cubeindex NOT IN (0, 255)),
sides AS (SELECT {key}, {side("u", "e1")}, {side("w", "e2")} FROM points JOIN tri USING (cubeindex)),
areas AS (SELECT {key}, sum(0.5 * sqrt((uy * wz - uz * wy) ** 2 + (uz * wx - ux * wz) ** 2 + (ux * wy - uy * wx) ** 2)) AS area FROM sides GROUP BY {key})"""


def diffusion(axis: int, sign: int) -> str:
    """CTEs that end in `sys`: the system of the small masks along an axis."""
    step = f"{H}::DOUBLE"
    inner = {f"{a}{s[0]}": f"(v + {a}_{s}) / 2 * {step}" for a in XYZ for s in ("pos", "neg")}
    coefficients = ", ".join(f"coalesce({v}, 0) AS c_{k}" for k, v in inner.items())
    diagonal = " ".join(f"- coalesce({v}, {f'v * {step} * 2' if k[0] == XYZ[axis] else '0'})" for k, v in inner.items())
    a = XYZ[axis]
    begin, end = (1, 0) if sign > 0 else (0, 1)
    rhs = f"CASE WHEN {a} = 0 THEN -(v * {step} * 2) * {begin} WHEN {a} = 3 THEN -(v * {step} * 2) * {end} ELSE 0 END"
    start = f"1 - {a} / 5.0::DOUBLE" if sign > 0 else f"{a} / 5.0::DOUBLE"
    return f"""{EV}, d AS (SELECT volume_id, x, y, z, CASE WHEN v > 0 THEN 0.001::FLOAT::DOUBLE ELSE 1::DOUBLE END AS v FROM evm),
nb AS (SELECT *, {neighbour_columns(4, 'none')} FROM d),
sys AS (SELECT volume_id, x, y, z, {coefficients}, 0 {diagonal} AS c_diag, {rhs} AS rhs, {start} AS x0 FROM nb)"""


#: CTEs that end in `summed` (volume_id, x, y, z, nx, ny, nz, l): the merged vertices of the small masks' surfaces.
VERTICES = f"""{areas('evm', 4)}, corners AS (
    SELECT volume_id, unnest([e0, e1, e2]) AS e, px, py, pz, py[e1 + 1] AS y1, py[e0 + 1] AS y0, py[e2 + 1] AS y2, pz[e1 + 1] AS z1, pz[e0 + 1] AS z0, pz[e2 + 1] AS z2,
        px[e1 + 1] AS x1, px[e0 + 1] AS x0, px[e2 + 1] AS x2 FROM points JOIN tri USING (cubeindex)
), placed AS (
    SELECT volume_id, round(px[e + 1] - 0.5, 9) + 0.0 AS x, round(py[e + 1] - 0.5, 9) + 0.0 AS y, round(pz[e + 1] - 0.5, 9) + 0.0 AS z,
        (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM corners
), summed AS (SELECT volume_id, x, y, z, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz, sqrt(sum(nx) ** 2 + sum(ny) ** 2 + sum(nz) ** 2) AS l FROM placed GROUP BY volume_id, x, y, z)"""
