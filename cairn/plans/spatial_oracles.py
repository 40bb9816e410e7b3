"""SQL twins of ``spatial_queries``."""

from __future__ import annotations

from itertools import permutations

from cairn.plans.oracles import CELLS, MATRIX, ORACLE_SQL, RAYS, TRACED, TREE, USAGE, r, u

CORNERS = [f"{v}_{a}" for v in "abc" for a in "xyz"]  # "by" alone would be a keyword
TRIANGLES = f"""triangles AS (
  SELECT coalesce(label::VARCHAR, 'none') AS object_id, vec_id * 7 + t AS face_id, {', '.join(f'embedding[t * 9 + {n + 1}]::DOUBLE AS {c}' for n, c in enumerate(CORNERS))}
  FROM embeddings, range(7) g(t))"""


def _transport() -> str:
    """The least of all ways to give the sinks' five units (two of the first) to sources that send 2, 2 and 1."""
    ways = sorted(set(permutations((0, 0, 1, 1, 2))))
    sums = ", ".join(" + ".join(f"c{s}{max(0, n - 1)}" for n, s in enumerate(w)) for w in ways)
    at = lambda n, a: f"embedding[g * 21 + {n * 3 + 'xyz'.index(a) + 1}]::DOUBLE"
    dist = lambda s, t: " + ".join(f"({at(s, a)} - {at(t + 3, a)}) * ({at(s, a)} - {at(t + 3, a)})" for a in "xyz")
    costs = ", ".join(f"floor(sqrt({dist(s, t)}) * 100 + 0.5::DOUBLE)::BIGINT AS c{s}{t}" for s in range(3) for t in range(4))
    return f"WITH p AS (SELECT vec_id || ':' || g AS key, {costs} FROM embeddings, range(3) x(g) WHERE vec_id IS NOT NULL) SELECT key, 5::BIGINT AS units, least({sums}) AS cost, 0::BIGINT AS gap FROM p"


def _mesh() -> str:
    box = ", ".join(f"min(least(a_{x}, b_{x}, c_{x})) AS lo{x}, max(greatest(a_{x}, b_{x}, c_{x})) AS hi{x}" for x in "xyz")
    unit = ", ".join(f"({v}_{x} - lo{x}) / pitch AS {v}_{x}" for v in "abc" for x in "xyz")
    side = {s: [f"({q}_{x} - {p}_{x})" for x in "xyz"] for s, (p, q) in {"e": "ab", "f": "bc", "g": "ca"}.items()}
    cross = lambda p, q: [f"({p[1]} * {q[2]} - {p[2]} * {q[1]})", f"({p[2]} * {q[0]} - {p[0]} * {q[2]})", f"({p[0]} * {q[1]} - {p[1]} * {q[0]})"]
    axes = [cross(side["e"], side["f"])] + [cross([f"{float(n == m)}::DOUBLE" for m in range(3)], s) for s in side.values() for n in range(3)]
    made = ", ".join(f"{c} AS n{k}{x}" for k, a in enumerate(axes) for c, x in zip(a, "xyz"))
    along = lambda k, v: " + ".join(f"n{k}{x} * {v}_{x}" for x in "xyz")
    reach = lambda k: f"(abs(n{k}x) + abs(n{k}y) + abs(n{k}z)) * {0.5 + 1e-9!r}::DOUBLE"
    ends = ", ".join(f"least({', '.join(along(k, v) for v in 'abc')}) - {reach(k)} AS lo{k}, greatest({', '.join(along(k, v) for v in 'abc')}) + {reach(k)} AS hi{k}" for k in range(len(axes)))
    tests = " AND ".join(f"n{k}x * (i + 0.5::DOUBLE) + n{k}y * (j + 0.5::DOUBLE) + n{k}z * (k + 0.5::DOUBLE) BETWEEN lo{k} AND hi{k}" for k in range(len(axes)))
    cells = " AND ".join(f"{c} BETWEEN greatest(0, least(15, floor(least(a_{x}, b_{x}, c_{x})))) AND greatest(0, least(15, floor(greatest(a_{x}, b_{x}, c_{x}))))" for c, x in zip("ijk", "xyz"))
    return f"""WITH {TRIANGLES}, boxes AS (SELECT object_id, {box} FROM triangles GROUP BY object_id),
      scaled AS (SELECT *, greatest(hix - lox, hiy - loy, hiz - loz) / 16.0::DOUBLE AS pitch FROM boxes),
      unit AS (SELECT object_id, {unit} FROM triangles JOIN scaled USING (object_id) WHERE pitch > 0),
      axes AS (SELECT *, {made} FROM unit), ends AS (SELECT *, {ends} FROM axes)
      SELECT DISTINCT object_id, i, j, k FROM ends, range(16) a(i), range(16) b(j), range(16) c(k) WHERE {cells} AND {tests}"""


#: Neighbour behind each face, and its corners anticlockwise from outside.
FACES = {
    0: ((-1, 0, 0), ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0))), 1: ((1, 0, 0), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1))),
    2: ((0, -1, 0), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1))), 3: ((0, 1, 0), ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0))),
    4: ((0, 0, -1), ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0))), 5: ((0, 0, 1), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))),
}
CUBES = f"""{CELLS}, sides(face, di, dj, dk) AS (VALUES {', '.join(f'({f}, {a}, {b}, {c})' for f, ((a, b, c), _) in FACES.items())}),
corners(face, corner, ci, cj, ck) AS (VALUES {', '.join(f'({f}, {n}, {a}, {b}, {c})' for f, (_, four) in FACES.items() for n, (a, b, c) in enumerate(four))}),
quads AS (
  SELECT e.object_id, e.i, e.j, e.k, face, row_number() OVER (PARTITION BY e.object_id ORDER BY e.i, e.j, e.k, face) - 1 AS quad
  FROM cells e CROSS JOIN sides LEFT JOIN cells n ON n.object_id = e.object_id AND n.i = e.i + di AND n.j = e.j + dj AND n.k = e.k + dk WHERE n.object_id IS NULL),
spots AS (SELECT object_id, quad, corner, i + ci AS x, j + cj AS y, k + ck AS z FROM quads JOIN corners USING (face)),
vertices AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY x, y, z) - 1 AS vid FROM (SELECT DISTINCT object_id, x, y, z FROM spots)),
four AS (
  SELECT object_id, quad, {', '.join(f'max(vid) FILTER (corner = {n}) AS v{n}' for n in range(4))}
  FROM spots JOIN vertices USING (object_id, x, y, z) GROUP BY object_id, quad),
faces AS (SELECT object_id, 2 * quad AS fid, v0 AS a, v1 AS b, v2 AS c FROM four UNION ALL SELECT object_id, 2 * quad + 1, v0, v2, v3 FROM four)"""

BOXES = f"""{CELLS}, boxes AS (
  SELECT object_id, min(k) - 8.0::DOUBLE AS lo_x, min(j) - 8.0::DOUBLE AS lo_y, min(i) - 8.0::DOUBLE AS lo_z, max(k) - 7.0::DOUBLE AS hi_x, max(j) - 7.0::DOUBLE AS hi_y, max(i) - 7.0::DOUBLE AS hi_z
  FROM cells GROUP BY object_id)"""


def _side_points(source: str) -> str:
    """``source`` with a hashed point ``ox, oy, oz`` of side ``face_id`` of its box."""
    low, high = (["lo_x", "lo_y", "lo_z"], ["hi_x", "hi_y", "hi_z"])
    key = ("object_id", "view_id", "face_id", "n")
    at = []
    for n, a in enumerate("xyz"):
        spread = lambda s, n=n: f"{low[n]} + {u(f'42{s}', *key)} * ({high[n]} - {low[n]})"
        # the first of the side's own axes draws u, the second v
        own = f"CASE WHEN face_id // 2 = 0 THEN {spread('u')} ELSE {spread('v')} END" if n == 1 else spread("u" if n == 0 else "v")
        at.append(f"CASE WHEN face_id // 2 = {n} THEN CASE WHEN face_id % 2 = 1 THEN {high[n]} ELSE {low[n]} END ELSE {own} END AS o{a}")
    return f"SELECT *, {', '.join(at)} FROM {source}"


DIRECTIONS = "sin(e) * cos(a) AS ux, sin(e) * sin(a) AS uy, cos(e) AS uz"
SPHERE = f"""WITH {BOXES}, views AS (
  SELECT x * 3 + y AS view_id, {DIRECTIONS} FROM (SELECT x, y, pi() * (0.1::DOUBLE + 0.8::DOUBLE * x / 2) AS e, y * 2 * pi() / 3 AS a FROM range(3) p(x), range(3) q(y))),
far AS (
  SELECT boxes.*, view_id, face_id, n, (lo_x + hi_x) / 2 + radius * ux AS cx, (lo_y + hi_y) / 2 + radius * uy AS cy, (lo_z + hi_z) / 2 + radius * uz AS cz
  FROM (SELECT *, greatest(hi_x - lo_x, hi_y - lo_y, hi_z - lo_z) AS radius FROM boxes) boxes, views, range(6) f(face_id), range(2) m(n)
  WHERE (CASE face_id // 2 WHEN 0 THEN ux WHEN 1 THEN uy ELSE uz END) * (CASE WHEN face_id % 2 = 1 THEN 1 ELSE -1 END) <= -1e-9),
placed AS ({_side_points('far')}),
way AS (SELECT *, sqrt((cx - ox) * (cx - ox) + (cy - oy) * (cy - oy) + (cz - oz) * (cz - oz)) AS d FROM placed)
SELECT object_id, view_id, face_id, n, {', '.join(f"{r(f'o{a}')} AS o{a}, {r(f'(c{a} - o{a}) / d')} AS d{a}" for a in 'xyz')} FROM way"""
FACE_RAYS = f"""WITH {BOXES}, src AS (SELECT boxes.*, 0 AS view_id, face_id, n FROM boxes, range(6) f(face_id), range(5) m(n)), placed AS ({_side_points('src')})
SELECT object_id, 0::BIGINT AS view_id, face_id, n, {', '.join(f"{r(f'o{a}')} AS o{a}, {r(f'CASE WHEN face_id // 2 = {n} THEN CASE WHEN face_id % 2 = 1 THEN -1 ELSE 1 END ELSE 0 END')} AS d{a}" for n, a in enumerate('xyz'))} FROM placed"""

REACH = f"{BOXES}, reaches AS (SELECT *, greatest(abs(lo_x), abs(lo_y), abs(lo_z), abs(hi_x), abs(hi_y), abs(hi_z)) AS reach FROM boxes)"


def _patches() -> str:
    """Four by four patches on each side +X, -X, +Y, -Y, +Z, -Z of every object's box; u is the side's first own axis and runs fastest."""
    pick = lambda axis, e: f"CASE {axis} WHEN 0 THEN {e}_x WHEN 1 THEN {e}_y ELSE {e}_z END"
    steps = ", ".join(f"{pick(f'{c}a', 'lo')} AS {c}0, ({pick(f'{c}a', 'hi')} - {pick(f'{c}a', 'lo')}) / 4 AS {c}s" for c in "uv")
    centre = ", ".join(f"CASE {n} WHEN axis THEN CASE face_id % 2 WHEN 0 THEN hi_{a} ELSE lo_{a} END WHEN ua THEN (u_min + u_max) / 2 ELSE (v_min + v_max) / 2 END AS center_{a}" for n, a in enumerate("xyz"))
    normal = ", ".join(f"CASE axis WHEN {n} THEN CASE face_id % 2 WHEN 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ELSE 0.0::DOUBLE END AS normal_{a}" for n, a in enumerate("xyz"))
    return f"""{REACH}, ids AS (SELECT n AS patch_id, n // 16 AS face_id, n % 16 AS local_idx, n % 4 AS u, n % 16 // 4 AS v, n // 32 AS axis, CASE n // 32 WHEN 0 THEN 1 ELSE 0 END AS ua, CASE n // 32 WHEN 2 THEN 1 ELSE 2 END AS va FROM range(96) g(n)),
      steps AS (SELECT *, {steps} FROM reaches, ids), spans AS (SELECT *, u0 + u * us AS u_min, u0 + (u + 1) * us AS u_max, v0 + v * vs AS v_min, v0 + (v + 1) * vs AS v_max, us * vs AS area FROM steps),
      mid AS (SELECT *, {centre}, {normal} FROM spans)"""


PATCHES = _patches()
#: Directions from the camera at (4, 3, 2), which looks at the origin, with z up: forward, right, above.
CAMERA = """camera AS (SELECT -4 / sqrt(29.0::DOUBLE) AS fx, -3 / sqrt(29.0::DOUBLE) AS fy, -2 / sqrt(29.0::DOUBLE) AS fz, -3 / 5.0::DOUBLE AS rx, 4 / 5.0::DOUBLE AS ry),
  frame AS (SELECT *, ry * fz AS ux, -rx * fz AS uy, rx * fy - ry * fx AS uz FROM camera)"""


def _gauss(seed: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u(f'{seed}r', 'ray_id')})) * cos(2 * pi() * {u(f'{seed}a', 'ray_id')}))"


ASKED = """asked AS (
  SELECT printf('%04d', p_partkey) AS box_id, p_partkey % 5 AS lx, p_size % 4 AS ly, p_partkey % 9 AS lz, p_partkey % 5 + 4 + p_size % 9 AS hx, p_size % 4 + 4 + p_size % 8 AS hy, p_partkey % 9 + 4 + p_size % 5 AS hz FROM part)"""
INSIDE = " AND ".join(f"global_position_{a} >= l{a} AND global_position_{a} + size <= h{a}" for a in "xyz")
POSITIONS = ", ".join(f"global_position_{a}" for a in "xyz")
#: Squares of the net by face: row and column.
NET = "net(face, nr, nc) AS (VALUES (0, 1, 2), (1, 1, 0), (2, 0, 1), (3, 2, 1), (4, 1, 1), (5, 1, 3))"

SPATIAL = {
    "exact_transport": _transport(),
    "mesh_cells": _mesh(),
    "cube_mesh": f"""WITH {CUBES} SELECT object_id, n_vertices, vertex_sum, n_faces, face_sum
        FROM (SELECT object_id, count(*) AS n_vertices, sum((vid + 1) * (x * 289 + y * 17 + z))::BIGINT AS vertex_sum FROM vertices GROUP BY object_id)
        JOIN (SELECT object_id, count(*) AS n_faces, sum((fid + 1) * (a * 3 + b * 5 + c * 7))::BIGINT AS face_sum FROM faces GROUP BY object_id) USING (object_id)""",
    "stl_roundtrip": f"""WITH {TRIANGLES} SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY face_id) - 1 AS face_id, {', '.join(f'{r(c)} AS "{c.replace("_", "")}"' for c in CORNERS)} FROM triangles""",
    "rays_of_level": f"""WITH {TRACED} SELECT 1::BIGINT AS level, object_id AS hash, ray_id, hit, ray_id % 6 AS face_id, ray_id % 36 AS view_id, {r('distance::FLOAT', 3)} AS distance FROM traced WHERE ray_id % 3 = 1""",
    "manifest_build": f"""WITH {TREE}, o AS (SELECT object_id, object_id::INT AS n FROM objects),
        lost AS (SELECT DISTINCT object_id FROM tree WHERE NOT is_empty AND hash LIKE '3%' AND (object_id::INT % 7 <> 0 OR global_position_z < 8)),
        latest AS (SELECT object_id, count(*) AS n_cells FROM cells WHERE object_id::INT % 7 <> 0 OR k < 8 GROUP BY object_id), early AS (SELECT object_id, count(*) AS n_before FROM cells WHERE object_id::INT % 2 = 0 GROUP BY object_id)
        SELECT o.object_id, CASE WHEN lost.object_id IS NOT NULL THEN 3 WHEN n % 2 = 0 AND n % 7 <> 0 THEN 1 ELSE 2 END::BIGINT AS made_in, coalesce(n_cells, 0) AS n_cells, n_before
        FROM o LEFT JOIN latest USING (object_id) LEFT JOIN early USING (object_id) LEFT JOIN lost ON lost.object_id = o.object_id""",
    "blocks_in_boxes": f"WITH {TREE}, {ASKED} SELECT box_id, object_id, level, {POSITIONS}, hash FROM tree JOIN asked ON box_id = object_id WHERE {INSIDE}",
    "block_descendants": f"""WITH {TREE}, top AS (SELECT object_id, level, {', '.join(f'global_position_{a} AS l{a}, global_position_{a} + size AS h{a}' for a in 'xyz')} FROM tree WHERE level = 1 AND octant_index = 0)
        SELECT top.level || ':' || lx || ':' || ly || ':' || lz AS box_id, tree.object_id, tree.level, octant_index, {POSITIONS}, is_empty FROM tree JOIN top ON tree.object_id = top.object_id AND tree.level > top.level WHERE {INSIDE}""",
    "sketched_levels": f"WITH {TREE} SELECT level, count(*) AS total, count(DISTINCT hash) AS exact, true AS within_margin, true AS union_agrees FROM tree GROUP BY level",
    "cube_nets": f"""WITH {MATRIX}, v AS (SELECT structure, out_idx // 4 AS patch_id, sum(value) AS x FROM matrix WHERE out_idx % 4 = 0 AND in_idx % 4 = 0 GROUP BY ALL), {NET},
        spots AS (SELECT face * 4 + b * 2 + a AS patch_id, nr * 2 + 1 - b AS "row", nc * 2 + a AS col FROM net, range(2) p(a), range(2) q(b)),
        every AS (SELECT structure, "row", col, {r('coalesce(x, 0)')} AS x FROM (SELECT DISTINCT structure FROM v) s CROSS JOIN spots LEFT JOIN v USING (structure, patch_id))
        SELECT structure, "row", {', '.join(f'max(x) FILTER (col = {n}) AS c{n}' for n in range(8))} FROM every GROUP BY structure, "row" """,
    "octant_badges": f"""WITH {USAGE} SELECT object_id, level, {POSITIONS}, CASE WHEN tree.is_empty THEN 'empty' WHEN trivial THEN 'trivial'
        WHEN bit_count(mask) = 1 THEN CASE mask WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END || ' only'
        ELSE 'shared: ' || array_to_string(list_filter([CASE WHEN mask & 4 > 0 THEN 'test' END, CASE WHEN mask & 1 > 0 THEN 'train' END, CASE WHEN mask & 2 > 0 THEN 'val' END], lambda x: x IS NOT NULL), ', ') END AS badge
        FROM tree JOIN contents USING (hash)""",
    "views_sphere": f"""WITH {REACH}, placed AS (SELECT object_id, e * 6 + a AS view_id, 2 * reach AS d, 0.1 * pi() + e * (0.8 * pi() / 5) AS elev, a * (2 * pi() / 6) AS azim FROM reaches, range(6) x(e), range(6) y(a))
        SELECT object_id, view_id, {r('d * sin(elev) * cos(azim)')} AS px, {r('d * sin(elev) * sin(azim)')} AS py, {r('d * cos(elev)')} AS pz FROM placed""",
    "turntable_views": f"WITH {REACH} SELECT object_id, n AS view_id, {r('2 * reach * cos(n * (2 * pi() / 8))')} AS px, {r('2 * reach * sin(n * (2 * pi() / 8))')} AS py, {r('0.6::DOUBLE * reach')} AS pz FROM reaches, range(8) g(n)",
    "rays_orthographic": f"""WITH {REACH} SELECT object_id, "row", col, {r('-reach + col * (2 * reach / 7)')} AS ox, {r('-reach + "row" * (2 * reach / 5)')} AS oy, {r('3 * reach')} AS oz, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, -1.0::DOUBLE AS dz
        FROM reaches, range(6) a("row"), range(8) b(col)""",
    "raster_of_one_column": f"""WITH {REACH} SELECT object_id, "row", 0::BIGINT AS col, {r('-reach')} AS ox, {r('-reach + "row" * (2 * reach / 5)')} AS oy, {r('3 * reach')} AS oz, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, -1.0::DOUBLE AS dz
        FROM reaches, range(6) a("row")""",
    "rays_perspective": f"""WITH {REACH}, {CAMERA}, p AS (SELECT object_id, reach, "row", col, frame.*, (2 * (col + 0.5::DOUBLE) / 8 - 1) * (8 / 6.0::DOUBLE * tan(pi() / 6)) AS sx, (1 - 2 * ("row" + 0.5::DOUBLE) / 6) * tan(pi() / 6) AS sy
          FROM reaches, frame, range(6) a("row"), range(8) b(col)),
        v AS (SELECT *, fx + sx * rx + sy * ux AS vx, fy + sx * ry + sy * uy AS vy, fz + sy * uz AS vz FROM p)
        SELECT object_id, "row", col, {r('4 * reach')} AS ox, {r('3 * reach')} AS oy, {r('2 * reach')} AS oz, {', '.join(f"{r(f'v{a} / sqrt(vx * vx + vy * vy + vz * vz)')} AS d{a}" for a in 'xyz')} FROM v""",
    "boundary_patches": f"""WITH {PATCHES} SELECT object_id, patch_id, face_id, local_idx, {', '.join(f'{r(c)} AS {c}' for c in ('center_x', 'center_y', 'center_z', 'normal_x', 'normal_y', 'normal_z', 'area', 'u_min', 'u_max', 'v_min', 'v_max'))} FROM mid""",
    "patch_points": f"""WITH {PATCHES}, p AS (SELECT *, u_min + {u('u', 'object_id', 'patch_id')} * (u_max - u_min) AS pu, v_min + {u('v', 'object_id', 'patch_id')} * (v_max - v_min) AS pv FROM mid)
        SELECT object_id, patch_id, {', '.join(f"{r(f'CASE {n} WHEN axis THEN center_{a} WHEN ua THEN pu ELSE pv END')} AS {a}" for n, a in enumerate('xyz'))} FROM p""",
    "patch_solid_angle": f"""WITH {PATCHES}, d AS (SELECT *, center_x - 20 AS x, center_y - 3 AS y, center_z + 12.5 AS z FROM mid), c AS (SELECT *, x * x + y * y + z * z AS r2, -(x * normal_x + y * normal_y + z * normal_z) / sqrt(x * x + y * y + z * z) AS cosine FROM d)
        SELECT object_id, patch_id, {r('CASE WHEN cosine <= 0 THEN 0 ELSE area * cosine / r2 END')} AS solid_angle FROM c""",
    "sphere_grid": """WITH g AS (SELECT printf('%04d', p_partkey) AS object_id, i, j, k FROM part, range(16) a(i), range(16) b(j), range(16) c(k) WHERE (i - 8) * (i - 8) + (j - 8) * (j - 8) + (k - 8) * (k - 8) <= (p_size % 9) * (p_size % 9))
        SELECT object_id, count(*) AS n, sum(i * 10000 + j * 100 + k)::BIGINT AS checksum FROM g GROUP BY object_id""",
    "rays_sphere": SPHERE,
    "rays_all_faces": FACE_RAYS,
    "add_noise": f"""WITH {RAYS}, g AS (SELECT ray_id, {', '.join(f"{a} + 0.01::DOUBLE * {_gauss(f'42{a}')} AS {a}" for a in ('ox', 'oy', 'oz', 'dx', 'dy', 'dz'))} FROM rays),
        s AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM g)
        SELECT ray_id, {', '.join(f"{r(f'o{a}')} AS o{a}, {r(f'd{a} / n')} AS d{a}" for a in 'xyz')} FROM s""",
    # power iteration, long enough for the energies' gap
    "spectral_radius": f"""WITH RECURSIVE {MATRIX}, t AS MATERIALIZED (SELECT structure, out_idx, in_idx, abs(value) AS value FROM matrix),
        x(n, structure, idx, x) AS (
          SELECT 0, structure, in_idx, 1.0::DOUBLE FROM t GROUP BY ALL
          UNION ALL
          SELECT n, structure, idx, y / sqrt(sum(y * y) OVER (PARTITION BY structure))
          FROM (SELECT n + 1 AS n, t.structure, out_idx AS idx, sum(value * x) AS y FROM x JOIN t ON t.structure = x.structure AND t.in_idx = x.idx WHERE n < 60 GROUP BY ALL)),
        last AS (SELECT structure, idx, x FROM x WHERE n = 60),
        made AS (SELECT t.structure, out_idx AS idx, sum(value * x) AS y FROM t JOIN last ON t.structure = last.structure AND t.in_idx = last.idx GROUP BY ALL)
        SELECT structure, {r('sum(x * y)')} AS spectral_radius, 0.0::DOUBLE AS residual FROM last JOIN made USING (structure, idx) GROUP BY structure""",
}
ORACLE_SQL.update(SPATIAL)
