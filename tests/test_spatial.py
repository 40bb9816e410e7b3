"""Transport, spectra, meshes, file commits, versions, containment, sketches and pictures against brute force."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import layout, mesh, morton, octree, raygen, rays, registry, sketches, spectrum, transport
from cairn.plans.manifest import Dataset
from cairn.sources import archives, files, stl

T9 = ", ".join(f"{c} double" for c in stl.CORNERS)


# transport


def problems(spark, costs, supplies, demands):
    pairs = [(k, i, j, c) for k, m in costs.items() for i, row in enumerate(m) for j, c in enumerate(row) if c is not None]
    sources = [(k, i, s) for k, v in supplies.items() for i, s in enumerate(v)]
    sinks = [(k, j, s) for k, v in demands.items() for j, s in enumerate(v)]
    frames = (pairs, "key string, src int, dst int, cost int"), (sources, "key string, src int, supply int"), (sinks, "key string, dst int, demand int")
    return [spark.createDataFrame(*f) for f in frames]


def least(m, supply, demand):
    slots = [j for j, d in enumerate(demand) for _ in range(d)]
    ways = set(itertools.permutations([i for i, s in enumerate(supply) for _ in range(s)]))
    return min(sum(m[i][j] for i, j in zip(w, slots)) for w in ways if all(m[i][j] is not None for i, j in zip(w, slots)))


def test_exact_transport(spark):
    rng = random.Random(5)
    costs, supplies, demands = {}, {}, {}
    for n in range(12):
        supplies[f"r{n}"], demands[f"r{n}"] = rng.choice([([3, 2], [1, 1, 3]), ([2, 2, 1], [2, 1, 1, 1]), ([5], [2, 3]), ([1, 2, 2], [5])])
        costs[f"r{n}"] = [[rng.randrange(-5, 40) for _ in demands[f"r{n}"]] for _ in supplies[f"r{n}"]]
    # ties, a zero weight, a pair that isn't allowed
    costs["ties"], supplies["ties"], demands["ties"] = [[1, 1, 1]] * 3, [2, 1, 1], [1, 2, 1]
    costs["zero"], supplies["zero"], demands["zero"] = [[0, 9], [4, 1]], [0, 2], [1, 1]
    costs["bars"], supplies["bars"], demands["bars"] = [[None, 9], [4, 1]], [1, 1], [1, 1]
    plan, certificate = transport.exact_transport(*problems(spark, costs, supplies, demands))
    for r in certificate.collect():
        assert (r.cost, r.gap) == (least(costs[r.key], supplies[r.key], demands[r.key]), 0)
    sent = {k: np.zeros((len(supplies[k]), len(demands[k])), int) for k in costs}
    for r in plan.collect():
        sent[r.key][r.src, r.dst] += r.units
    for k, m in sent.items():
        assert m.sum(1).tolist() == supplies[k] and m.sum(0).tolist() == demands[k]


def test_transport_refuses(spark):
    for costs, supply, demand in (([[1]], [1], [2]), ([[1]], [-1], [-1]), ([[None], [1]], [1, 1], [2])):
        with pytest.raises(ValueError):
            transport.exact_transport(*problems(spark, {"k": costs}, {"k": supply}, {"k": demand}))
    none = [f.limit(0) for f in problems(spark, {"k": [[1]]}, {"k": [1]}, {"k": [1]})]
    assert not transport.exact_transport(*none)[1].collect()


# spectra


def test_leading_eigenvalues(spark):
    rng = np.random.default_rng(1)
    n, basis = 9, np.random.default_rng(2).normal(size=(9, 9))
    turn = np.diag([0.1] * n)
    turn[:2, :2] = [[1, 2], [-2, 1]]
    matrices = {
        "real": basis @ np.diag([5, -3, 1.2] + [0.1] * (n - 3)) @ np.linalg.inv(basis), "turns": basis @ turn @ np.linalg.inv(basis),
        "zero": np.zeros((n, n)), "nilpotent": np.diag(np.ones(n - 1), 1), "positive": rng.random((n, n)),
    }
    rows = [(k, i, j, float(m[i, j])) for k, m in matrices.items() for i in range(n) for j in range(n)]
    t = spark.createDataFrame(rows, "structure string, out_idx int, in_idx int, value double")
    values, vectors = spectrum.leading_eigenvalues(t, 2, 90)
    found = {(r.structure, r.nth): r for r in values.collect()}
    for k, m in matrices.items():
        want = max(np.linalg.eigvals(m), key=lambda z: (abs(z), z.imag))
        r = found[(k, 0)]
        assert r.converged and abs(complex(r.eigenvalue, r.imaginary)) == pytest.approx(abs(want), abs=1e-5)
    assert found[("turns", 0)].imaginary == pytest.approx(2) and ("turns", 1) not in found
    assert found[("real", 1)].eigenvalue == pytest.approx(-3)
    left = {(r.structure, r.nth): r.residual for r in spectrum.residuals(t, values, vectors).collect()}
    v = {k: np.zeros(n) for k in left}
    for r in vectors.collect():
        if (r.structure, r.nth) in v:
            v[(r.structure, r.nth)][r.idx] = r.right
    for (k, nth), x in v.items():
        assert left[(k, nth)] == pytest.approx(np.linalg.norm(matrices[k] @ x - found[(k, nth)].eigenvalue * x), abs=1e-9)
        assert not found[(k, nth)].converged or left[(k, nth)] < 1e-5
    assert not spectrum.leading_eigenvalues(t.limit(0))[0].collect()


# meshes


def test_cells_of_triangles(spark):
    rng = np.random.default_rng(1)
    side = 12
    shapes = rng.random((150, 9)) * side
    shapes[:40] = np.floor(shapes[:40])  # on the cells' borders
    shapes[40] = [3.0, 3, 3] * 3  # a point
    shapes[41] = [1.0, 1, 1, 9, 7, 5, 5, 4, 3]  # a line
    rows = [(str(n % 5), n, *map(float, t)) for n, t in enumerate(shapes)]
    want = set()
    for o, _, *t in rows:
        p = np.array(t).reshape(3, 3)
        low, high = (np.clip(np.floor(f(p, 0)), 0, side - 1).astype(int) for f in (np.min, np.max))
        sides = [p[1] - p[0], p[2] - p[1], p[0] - p[2]]
        at = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(low, high)], indexing="ij"), -1).reshape(-1, 3)
        keep = np.ones(len(at), bool)
        for a in [np.cross(sides[0], sides[1]), *(np.cross(e, s) for s in sides for e in np.eye(3))]:
            reach, on, c = np.abs(a).sum() * (0.5 + 1e-9), p @ a, (at + 0.5) @ a
            keep &= (c >= on.min() - reach) & (c <= on.max() + reach)
        want |= {(o, *map(int, x)) for x in at[keep]}
    got = mesh.passed_cells(spark.createDataFrame(rows, f"object_id string, face_id int, {T9}"), side)
    assert {tuple(r) for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().toString()


def test_cube_mesh_encloses_its_cells(spark):
    grid = np.random.default_rng(3).random((2, 5, 4, 3)) < 0.5
    rows = [(f"o{o}", int(i), int(j), int(k)) for o, i, j, k in np.argwhere(grid)]
    vertices, faces = mesh.cube_mesh(spark.createDataFrame(rows + rows[:3], "object_id string, i int, j int, k int"))
    v, f = vertices.collect(), faces.collect()
    for o, g in enumerate(grid):
        at = {r.vid: np.array([r.x, r.y, r.z]) for r in v if r.object_id == f"o{o}"}
        tri = [(r.fid, r.a, r.b, r.c) for r in f if r.object_id == f"o{o}"]
        pairs = sum((np.diff(g.astype(int), axis=a) == 0)[np.take(g, range(g.shape[a] - 1), a)].sum() for a in range(3))
        assert len(tri) == 2 * (6 * g.sum() - 2 * pairs)
        assert sorted(at) == list(range(len(at))) and {x for t in tri for x in t[1:]} == set(at)
        assert sorted(t[0] for t in tri) == list(range(len(tri)))
        assert sum(at[a] @ np.cross(at[b], at[c]) for _, a, b, c in tri) / 6 == pytest.approx(g.sum())


def test_cube_mesh_over_long_rows_meets_words_where_objects_are(spark, sf_dir):
    """A mesh of rows over several words is closed, and the query shuffles neither corners nor faces and writes nothing."""
    from cairn.plans import stages
    from cairn.plans.queries import QUERIES

    rng = np.random.default_rng(8)
    cells = {(int(i), int(j), int(k)) for i, j in itertools.product(range(2), range(3)) for k in np.flatnonzero(rng.random(200) < 0.6)} | {(4, 0, 61), (6, 0, 62), (8, 0, 123)}
    vertices, faces = mesh.cube_mesh(spark.createDataFrame([("o", *c) for c in cells], "object_id string, i int, j int, k int"))
    at = {r.vid: (r.x, r.y, r.z) for r in vertices.collect()}
    assert [at[n] for n in range(len(at))] == sorted(at.values())
    tri = {r.fid: (r.a, r.b, r.c) for r in faces.collect()}
    shown = [(c, f) for c in sorted(cells) for f, (way, _) in enumerate(mesh.FACES) if tuple(np.add(c, way)) not in cells]
    want = {}
    for n, (c, f) in enumerate(shown):
        four = [tuple(np.add(c, [int(x) for x in p]).tolist()) for p in mesh.FACES[f][1]]
        want |= {2 * n: (four[0], four[1], four[2]), 2 * n + 1: (four[0], four[2], four[3])}
    assert {n: tuple(at[v] for v in t) for n, t in tri.items()} == want
    before = stages.written()
    plan = QUERIES["cube_mesh"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert stages.written() == before and "ENSURE_REQUIREMENTS" not in plan


# files


def test_stl_source(spark, tmp_path):
    t = spark.range(400).select((F.col("id") % 3).cast("string").alias("object_id"), F.expr("int(id div 3)").alias("face_id"), *[F.sin(F.col("id") * (n + 1)).cast("float").cast("double").alias(c) for n, c in enumerate(stl.CORNERS)])
    stl.write_stl(t, str(tmp_path / "m"))
    assert sorted(os.listdir(tmp_path / "m")) == ["0.stl", "1.stl", "2.stl"]
    (tmp_path / "m/bad.stl").write_bytes(b"nothing")
    (tmp_path / "m/cut.stl").write_bytes((tmp_path / "m/0.stl").read_bytes()[:-50])
    (tmp_path / "m/text.stl").write_text("solid t facet normal 0 0 1 outer loop vertex 0 0 0 vertex 1 0 0 vertex 0 1 1 endloop endfacet endsolid")
    good, bad = files.read_stl(spark, str(tmp_path / "m"), 25)
    assert good.rdd.getNumPartitions() > 10
    assert good.where("object_id <> 'text'").exceptAll(t).isEmpty() and t.exceptAll(good).isEmpty()
    assert good.where("object_id = 'text'").count() == 1 and {r.object_id for r in bad.collect()} == {"bad", "cut"}
    with pytest.raises(Exception, match="no such path"):
        files.read_stl(spark, str(tmp_path / "none"))[0].collect()
    stl.write_stl(t.where("object_id = '1'"), str(tmp_path / "m"))  # in place of all that was there
    assert os.listdir(tmp_path / "m") == ["1.stl"]


def contents(spark, n=600):
    number = F.col("id")
    columns = [(number * k).cast("float").alias(c) for k, c in enumerate(("ox", "oy", "oz", "dx", "dy", "dz", "distance"))]
    return spark.range(n).select((number % 2).cast("int").alias("level"), F.concat(F.lit("ab"), number % 5).alias("hash"), number.cast("int").alias("ray_id"), *columns, *[F.lit(k).alias(c) for k, c in enumerate(("hit", "face_id", "view_id"))])


def test_archives(spark, tmp_path):
    rays_of = contents(spark)
    archives.write_rays(rays_of, str(tmp_path / "r"), most=250)
    assert sorted(os.listdir(tmp_path / "r")) == ["level_0", "level_1"]
    assert {"ab0_rays.npz", "ab0_rays-0001.npz", "ab0_rays-0002.npz"} <= {*os.listdir(tmp_path / "r/level_0/ab")}
    back = archives.read_archives(spark, str(tmp_path / "r"), "rays")
    assert back.drop("error").exceptAll(rays_of).isEmpty() and rays_of.exceptAll(back.drop("error")).isEmpty()
    (tmp_path / "r/level_1/ab/abx_rays.npz").write_bytes(b"x")
    errors = back.where("error IS NOT NULL").collect()
    assert [(r.level, r.hash, r.ray_id) for r in errors] == [(1, "abx", None)]
    assert back.where("level = 0").count() == 300 and back.where("level = 1 AND hash IN ('ab1', 'ab3')").count() == 120
    assert not back.where("level = 7").collect() and back.where("level = 1 AND hash = 'abx'").count() == 1
    assert files.read_ray_archives(spark, str(tmp_path / "r")).count() == 600


def test_archive_reader_opens_what_filters_ask_for(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    archives.write_rays(contents(spark, 50), str(tmp_path / "r"))
    reader = archives.ArchiveReader({"path": str(tmp_path / "r"), "kind": "rays"})
    other = GreaterThan(("ray_id",), 3)
    assert list(reader.pushFilters([EqualTo(("level",), 1), EqualTo(("hash",), "ab3"), other])) == [other]
    assert [uri.rsplit("/", 3)[1:] for p in reader.partitions() for uri, _ in p.found] == [["level_1", "ab", "ab3_rays.npz"]]


def test_archives_need_no_setting(spark, tmp_path):
    was = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        archives.write_rays(contents(spark, 50), str(tmp_path / "r"))
        assert files.read_ray_archives(spark, str(tmp_path / "r")).where("level = 1").count() > 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", was)


def test_failed_jobs_leave_no_archives(spark, tmp_path):
    broken = contents(spark).withColumn("distance", F.expr("if(ray_id = 599, raise_error('stop'), distance)"))
    with pytest.raises(Exception, match="stop"):
        archives.write_rays(broken, str(tmp_path / "r"))
    assert not os.path.exists(tmp_path / "r") or not os.listdir(tmp_path / "r")
    maps = spark.range(40).selectExpr("'a' AS object_id", "1 AS view_id", "int(id div 4) AS row", "int(id % 4) AS col", "float(id) AS distance", "int(id % 2) AS hit").where("row <> 3 OR col <> 3")
    archives.write_distance_maps(maps, str(tmp_path / "m"), most=4)
    assert sorted(os.listdir(tmp_path / "m/a")) == ["view_001-0001.npz", "view_001-0002.npz", "view_001.npz"]
    got = files.read_distance_maps(spark, str(tmp_path / "m"))
    assert got.exceptAll(maps).isEmpty() and maps.exceptAll(got).isEmpty()


def test_bundles_hold_many_contents(spark, tmp_path):
    rays_of = contents(spark)
    archives.write_rays(rays_of.repartition(3), str(tmp_path / "r"), bundled=True)
    assert sorted(os.listdir(tmp_path / "r")) == ["level_0", "level_1"]
    assert os.listdir(tmp_path / "r/level_0") == ["bundles"] and len(os.listdir(tmp_path / "r/level_0/bundles")) == 3  # a file a task, not one a content
    back = archives.read_archives(spark, str(tmp_path / "r"), "rays")
    assert back.drop("error").exceptAll(rays_of).isEmpty() and rays_of.exceptAll(back.drop("error")).isEmpty()
    assert back.where("level = 0").count() == 300 and back.where("level = 1 AND hash IN ('ab1', 'ab3')").count() == 120 and back.where("hash = 'ab9'").isEmpty()
    (tmp_path / "r/level_1/bundles/x_rays.npz").write_bytes(b"x")
    assert [(r.level, r.hash, r.ray_id) for r in back.where("error IS NOT NULL").collect()] == [(1, None, None)]
    archives.write_rays(rays_of, str(tmp_path / "r"))  # in place of the bundles
    back = archives.read_archives(spark, str(tmp_path / "r"), "rays")
    assert back.count() == 600 and back.where("error IS NOT NULL").isEmpty() and not os.listdir(tmp_path / "r/level_1/bundles")
    maps = spark.range(500).selectExpr("concat('o', id % 7) AS object_id", "int(id % 3) AS view_id", "int(id div 21) AS row", "int(id % 5) AS col", "float(id) AS distance", "int(id % 2) AS hit")
    archives.write_distance_maps(maps.repartition(2), str(tmp_path / "m"), bundled=True)
    got = files.read_distance_maps(spark, str(tmp_path / "m"))
    assert len(os.listdir(tmp_path / "m/bundles")) == 2 and got.exceptAll(maps).isEmpty() and maps.exceptAll(got).isEmpty()
    assert got.where("object_id = 'o3' AND view_id = 1").count() == maps.where("object_id = 'o3' AND view_id = 1").count() > 0


def test_broken_mesh_archives_are_rows(spark, tmp_path):
    np.savez(tmp_path / "m.npz", vertices=np.eye(3), faces=np.array([[0, 1, 2]]))
    np.savez(tmp_path / "other.npz", x=np.eye(3))
    (tmp_path / "bad.npz").write_bytes(b"no archive")
    good, bad = files.scan_mesh_archives(spark, str(tmp_path))
    assert [(r.object_id, r.ax, r.by, r.cz) for r in good.collect()] == [("m", 1, 1, 1)] and [r.object_id for r in bad.collect()] == ["bad"]


def test_edges_over_long_rows(spark):
    from cairn.operators import sparse

    rng = np.random.default_rng(7)
    grids = {"a": rng.random((3, 3, 140)) < 0.6, "b": rng.random((2, 3, 62)) < 0.5, "full": np.ones((2, 2, 63), bool)}
    rows = [(o, *map(int, at)) for o, g in grids.items() for at in np.argwhere(g)]
    cells = spark.createDataFrame(rows + rows[:5], "object_id string, i int, j int, k int")
    number = {}
    for o, g in grids.items():
        number |= {(o, *map(int, at)): n for n, at in enumerate(np.argwhere(g))}
    assert {(r.object_id, r.z, r.y, r.x): r.node_id for r in sparse.nodes(cells).collect()} == number
    for kind in (6, 18, 26):
        want = sorted((o, n, number[(o, i + a, j + b, k + c)]) for (o, i, j, k), n in number.items() for a, b, c in [*sparse.offsets(kind), (0, 0, 0)] if (o, i + a, j + b, k + c) in number)
        assert sorted(map(tuple, sparse.edges(cells, kind, loops=True).collect())) == want


# versions


def test_versions(spark, tmp_path):
    path = str(tmp_path / "d")
    grid = spark.createDataFrame([(o, i, j, 0) for n, o in enumerate("abc") for i in range(4) for j in range(n + 1)], "object_id string, i int, j int, k int")
    made = []

    def cells(todo):
        made.append(sorted(r.object_id for r in todo.collect()))
        return grid.join(todo, "object_id", "left_semi")

    def sources(**of):
        return spark.createDataFrame(list(of.items()), "object_id string, source_hash string")

    one = Dataset(spark, path).update(sources(a="1", b="1"), cells, 8, 4)
    assert one.version == 1 and made == [["a", "b"]]
    assert one.update(sources(a="1", b="1"), cells, 8, 4).version == 1 and len(made) == 1
    two = one.update(sources(a="1", b="2", c="1"), cells, 8, 4)
    assert made[1:] == [["b", "c"]] and {r.object_id: r.made_in for r in two.manifest().collect()} == {"a": 1, "b": 2, "c": 2}
    assert {r.object_id for r in Dataset(spark, path, 1).tree().collect()} == {"a", "b"}  # still whole
    # a build that stops before its manifest is in place
    with pytest.raises(RuntimeError):
        two.update(sources(a="9", b="2", c="1"), lambda todo: (_ for _ in ()).throw(RuntimeError()), 8, 4)
    assert Dataset(spark, path).version == 2
    # an object's source is gone, and so are the blocks of the first run
    fs, p = two._fs(f"{path}/runs/{two.runs()[0]}/blocks")
    fs.delete(p, True)
    assert {(r.object_id, r.change) for r in two.differences(sources(a="1", b="2")).collect()} == {("a", "broken"), ("b", "broken"), ("c", "removed")}
    three = two.update(sources(a="1", b="2"), cells, 8, 4)
    assert made[2:] == [["a", "b"]] and three.differences(sources(a="1", b="2")).isEmpty()
    assert {r.object_id for r in three.tree().collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        two.update(sources(a="7", b="2"), cells, 8, 4)  # version 3 is there already
    with pytest.raises(ValueError):
        three.update(sources(a="1").union(sources(a="2")), cells, 8, 4)
    # nothing to make, only an object to leave out
    four = three.update(sources(a="1"), cells, 8, 4)
    assert {r.object_id for r in four.tree().collect()} == {"a"} and four.differences(sources(a="1")).isEmpty()
    five = four.update(sources(a="1", b="2"), cells, 8, 4)  # its contents are still there
    assert {r.object_id: r.made_in for r in five.manifest().collect()} == {"a": 3, "b": 5} and five.differences(sources(a="1", b="2")).isEmpty()
    three = five
    assert len(three.vacuum(keep=1)) == 1 and three.versions() == [5] and three.differences(sources(a="1", b="2")).isEmpty()


def test_words_are_cells_and_maps_without_changes_are_read_without_a_join(spark, tmp_path):
    rng = np.random.default_rng(3)
    cells = spark.createDataFrame([(o, *map(int, c)) for o in "ab" for c in rng.integers(0, 32, (300, 3))], "object_id string, i int, j int, k int").distinct()
    objects = spark.createDataFrame([("a",), ("b",), ("none",)], "object_id string")
    words = octree.words(cells)
    assert sorted(map(tuple, octree.unpacked(words).collect())) == sorted(map(tuple, cells.collect()))
    for made in (lambda x: octree.subdivide(x, objects, 32, 2), lambda x: octree.unique_blocks(x, 32, 2)):
        assert sorted(map(repr, made(words).collect())) == sorted(map(repr, made(cells).collect()))
    sources = objects.withColumn("source_hash", F.lit("1"))
    one = Dataset(spark, str(tmp_path / "d")).update(sources, lambda todo: words.join(todo, "object_id", "left_semi"), 32, 4)
    assert "Join" not in one.tree()._jdf.queryExecution().optimizedPlan().toString()
    two = one.update(sources.withColumn("source_hash", F.expr("if(object_id = 'a', '2', '1')")), lambda todo: cells.where("k < 9").join(todo, "object_id", "left_semi"), 32, 4)
    of = lambda d: sorted(map(repr, d.tree().where("object_id = 'a'").collect()))
    first = of(one)
    assert first != of(two) and len(first) == len(of(two)) == 8 + 64 + 512
    three = two.update(sources, lambda todo: cells.join(todo, "object_id", "left_semi"), 32, 4)
    assert of(three) == first
    three.vacuum(keep=1)  # without the manifests of its runs
    assert of(Dataset(spark, three.path)) == first


def test_lost_blocks_are_made_again_in_a_third_version(spark, sf_dir):
    from cairn.plans.queries import QUERIES

    rows = QUERIES["manifest_build"](spark, sf_dir).collect()
    assert {r.made_in for r in rows} == {1, 2, 3} and all(r.n_before is None or r.n_cells <= r.n_before for r in rows)


def test_command_line(spark, tmp_path, capsys):
    from cairn.cli import main

    (tmp_path / "in").mkdir()
    for n, name in enumerate("ab"):
        np.save(tmp_path / f"in/{name}.npy", np.indices((8, 8, 8)).sum(0) < 5 + n)
    args = ["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--format", "npz", "--resolution", "8", "--no-solid"]
    main(["update", *args])
    np.save(tmp_path / "in/b.npy", np.indices((8, 8, 8)).sum(0) < 3)
    main(["update", *args])
    assert "version 1: 2 objects" in (said := capsys.readouterr().out) and "version 2: 2 objects" in said
    assert {r.object_id: r.made_in for r in Dataset(spark, str(tmp_path / "out")).manifest().collect()} == {"a": 1, "b": 2}
    for bad in (["build", "--output", "x"], ["nothing", "--output", "x"], ["update", "--input", "x"]):
        with pytest.raises(SystemExit):
            main(bad)


# rays, containment, sketches, pictures


def test_rays_of_boxes(spark):
    boxes = spark.createDataFrame([("a", -8.0, -8.0, -8.0, 8.0, 8.0, 8.0), ("flat", 0.0, 0.0, 0.0, 4.0, 2.0, 0.0), ("point", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("null", None, 0.0, 0.0, 1.0, 1.0, 1.0)], "object_id string, " + ", ".join(f"{c} double" for c in raygen.BOX))
    got = raygen.sphere_rays(boxes, 4, 9)
    whole = rays.sphere_rays(spark, 4, 9, 8.0)
    # the same cameras and sides as the sampler of one box; points differ by the object's name
    mine = got.where("object_id = 'a'")
    assert mine.select("view_id", "face_id", "n").exceptAll(whole.select("view_id", "face_id", "n")).isEmpty() and mine.count() == whole.count()
    for r in mine.collect():
        assert max(abs(r.ox), abs(r.oy), abs(r.oz)) == pytest.approx(8) and r.dx**2 + r.dy**2 + r.dz**2 == pytest.approx(1)
    assert {r.object_id for r in got.collect()} == {"a", "flat"}
    faces = raygen.face_rays(boxes, 2).where("object_id = 'a'").collect()
    assert len(faces) == 12 and all(sum(abs(c) == 8 for c in (r.ox, r.oy, r.oz)) == 1 for r in faces)


def test_containment(spark):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([("a", int(i), int(j), int(k)) for i, j, k in rng.integers(0, 16, (60, 3))], "object_id string, i int, j int, k int").distinct()
    tree = octree.subdivide(cells, cells.select("object_id").distinct(), 16, 2)
    asked = [(str(n), "a", *map(int, low), *map(int, low + size)) for n, (low, size) in enumerate(zip(rng.integers(-2, 12, (25, 3)), rng.integers(0, 14, (25, 3))))]
    asked += [("all", "a", 0, 0, 0, 16, 16, 16), ("other", "b", 0, 0, 0, 16, 16, 16), ("null", "a", None, 0, 0, 16, 16, 16)]
    boxes = spark.createDataFrame(asked, "box_id string, object_id string, lo_x int, lo_y int, lo_z int, hi_x int, hi_y int, hi_z int")
    rows = tree.collect()
    want = {
        (box, r.level, r.global_position_x, r.global_position_y, r.global_position_z)
        for box, o, *e in asked for r in rows
        if o == r.object_id and None not in e and all(e[n] <= r[f"global_position_{a}"] and r[f"global_position_{a}"] + r.size <= e[n + 3] for n, a in enumerate("xyz"))
    }
    got = [(r.box_id, r.level, r.global_position_x, r.global_position_y, r.global_position_z) for r in morton.contained_blocks(tree, boxes, 16, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    below = morton.descendants(tree, tree.where("level = 1 AND octant_index = 5"), 16, 2)
    assert below.count() == 8 + 64 and below.where("level = 2").count() == 8


def test_sketches_merge(spark):
    tree = spark.range(30_000).select((F.col("id") % 40).cast("string").alias("object_id"), F.lit(1).alias("level"), F.sha2((F.col("id") % 9000).cast("string"), 256).alias("hash"), F.lit(False).alias("is_empty"), F.lit(4).alias("size"))
    of = sketches.object_sketches(tree)
    half = F.col("object_id").cast("int") < 20
    row = sketches.estimates(sketches.merged(sketches.level_sketches(of.where(half)), of.where(~half))).first()
    exact = registry.level_stats(tree).first()
    assert row.total == exact.total and abs(row.unique - exact.unique) <= row.margin and row.margin < 0.06 * exact.unique


def test_pictures(spark):
    patches = spark.createDataFrame([("s", p, float(p)) for p in range(24)] + [("t", 3, 1.0)], "structure string, patch_id int, value double")
    rows = {(r.structure, r.row): r.columns for r in layout.cube_net(patches, 2, "value").collect()}
    assert len(rows) == 12 and rows[("s", 0)] == [None, None, 10.0, 11.0, None, None, None, None] and rows[("s", 3)] == [4.0, 5.0, 16.0, 17.0, 0.0, 1.0, 20.0, 21.0]
    assert rows[("t", 2)] == [0.0] * 4 + [0.0, 1.0] + [0.0] * 2
    tree = spark.createDataFrame([(h, h == "e") for h in "etabcz"], "hash string, is_empty boolean")
    known = spark.createDataFrame([("e", 7, True), ("t", 7, True), ("a", 1, False), ("b", 5, False), ("c", 7, False)], "hash string, mask int, trivial boolean")
    assert {r.hash: r.badge for r in layout.octant_badges(tree, known).collect()} == {"e": "empty", "t": "trivial", "a": "train only", "b": "shared: test, train", "c": "shared: test, train, val", "z": "unknown"}


def test_transport_rounds_broadcast_nothing(spark):
    pairs = spark.range(2).selectExpr("string(id div 10) AS key", "0L AS src", "id AS dst", "1 + 4 * id AS cost")
    sources = spark.range(1).selectExpr("string(id div 10) AS key", "0L AS src", "2L AS supply")
    sinks = spark.range(2).selectExpr("string(id div 10) AS key", "id AS dst", "1L AS demand")
    held = spark.createDataFrame([], "key string, dst long, src long, cost long, price long, units long")
    prices = sinks.withColumn("first_price", F.lit(0).cast("long"))
    rounds = transport._round(pairs, sources, prices, held, 1)
    assert "Broadcast" not in rounds._jdf.queryExecution().executedPlan().toString()
    plan, certificate = transport.exact_transport(pairs, sources, sinks)
    assert sorted(map(tuple, plan.collect())) == [("0", 0, 0, 1), ("0", 0, 1, 1)]
    assert "Broadcast" not in certificate._jdf.queryExecution().executedPlan().toString()


def test_folders_of_objects_are_found_below_the_asked_path(spark, tmp_path):
    from cairn.sources import sinks

    path = tmp_path / "object_base" / "found"  # a name above the asked path is no object
    rows = spark.createDataFrame([(f"object_{n}", "x") for n in range(300)], "folder string, value string")
    sinks.write_folders(rows, str(path))
    for extra in ("folder=object_a/part.txt", "deep/object_b/in/part.txt", "_hidden/object_c/part.txt", "object_d/.part", "other/part.txt", "object_file"):
        (path / extra).parent.mkdir(parents=True, exist_ok=True)
        (path / extra).write_text("x")
    (path / "object_empty").mkdir()
    assert sorted(r.object_id for r in files.discover_objects(spark, str(path)).collect()) == sorted([*map(str, range(300)), "a", "b"])


def test_maps_as_json_take_a_file_a_task(spark, sf_dir, tmp_path):
    from cairn import schemas
    from cairn.plans import queries
    from cairn.sources import sinks

    path, tree = tmp_path / "maps", queries.tree(spark, sf_dir)
    sinks.write_tree_json(tree, str(path))
    parts = [p for p in path.rglob("*") if p.suffix in (".txt", ".gz") and p.name[0] != "."]
    assert 0 < len(parts) <= tree.rdd.getNumPartitions() and all(p.suffix == ".gz" for p in parts)
    columns = [c.split()[0] for c in schemas.SUBDIVISION_MAP.split(", ")]
    want = sorted(map(tuple, tree.select(*columns).collect()))
    assert sorted(map(tuple, sinks.read_tree_json(spark, str(path)).collect())) == want
    sinks.write_ndjson(tree, str(path))
    assert all(p.suffix == ".gz" for p in path.glob("part-*"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "map.json").write_text('[\n {"object_id": "7", "level": 1},\n {"object_id": "7", "level": 2}\n]')
    assert sinks.read_tree_json(spark, str(tmp_path / "one"), multiline=True).count() == 2


def test_unique_blocks_are_listed_after_they_are_made_unique(spark):
    grid = np.random.default_rng(11).random((16, 16, 16)) < 0.3
    at = [tuple(map(int, c)) for c in np.argwhere(grid)]
    cells = spark.createDataFrame([(o, *c) for o in ("a", "b", "c") for c in at], "object_id string, i int, j int, k int")
    for resolution, least in ((16, 2), (32, 4)):  # 32: also blocks of 16 cells a side, which aren't made of bits
        each = octree.blocks(cells, resolution, least).withColumn("hash", octree.content_hash()).select("level", "hash", "size", "occ")
        want = sorted(map(tuple, each.distinct().collect()))
        unique = octree.unique_blocks(cells, resolution, least)
        assert sorted(map(tuple, unique.collect())) == want


def test_frequent_contents_are_sent_to_their_blocks(spark, monkeypatch):
    rows = [(f"o{n:02}", 1, h, n, 0, 0, n % 2 == 0) for n in range(40) for h in ("empty", f"h{n % 7}", "unknown")]
    tree = spark.createDataFrame(rows, "object_id string, level int, hash string, global_position_x int, global_position_y int, global_position_z int, is_empty boolean")
    known = tree.where("hash <> 'unknown'").groupBy("level", "hash").agg(F.count("*").alias("count"))
    uses = {"empty": 40, "unknown": 0} | {f"h{x}": len(range(x, 40, 7)) for x in range(7)}
    for most in (20_000, 3, 1):
        monkeypatch.setattr(registry, "FREQUENT", most)
        out = registry.with_registry(tree, known)
        assert "Broadcast" in out._jdf.queryExecution().executedPlan().toString()
        got = out.select("object_id", "hash", "uses").collect()
        assert sorted(map(tuple, got)) == sorted((o, h, uses[h]) for o, _, h, *_ in rows)
        new = registry.new_flags(tree).where("is_new").select("hash", "object_id").collect()
        assert dict(map(tuple, new)) == {"empty": "o00", "unknown": "o00"} | {f"h{x}": f"o{x:02}" for x in range(7)} and len(new) == 9


def test_rays_meet_bricks_and_not_cells(spark):
    rng = np.random.default_rng(12)
    grid = rng.random((40, 40, 40)) < 0.4
    cells = spark.createDataFrame([("g", *map(int, c)) for c in np.argwhere(grid)], "object_id string, i int, j int, k int")
    origin = rng.normal(size=(60, 3))
    origin *= 50 / np.linalg.norm(origin, axis=1, keepdims=True)
    way = rng.uniform(-12, 12, (60, 3)) - origin
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    rows = [(n, "g" if n % 10 else "none", *map(float, o), *map(float, w)) for n, (o, w) in enumerate(zip(origin, way, strict=True))]
    rows += [(60, "g", 90.0, 90.0, 90.0, 1.0, 0.0, 0.0), (61, "g", 0.25, 0.25, -60.0, 0.0, 0.0, 1.0), (62, "g", 0.3, 0.2, 0.1, 0.6, 0.8, 0.0)]
    ray = spark.createDataFrame(rows, "ray_id long, object_id string, ox double, oy double, oz double, dx double, dy double, dz double")
    got, want = ({r.ray_id: r.distance for r in f(ray, cells, 40).collect()} for f in (rays.trace_cells, rays.trace))
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 63 and got[60] == 0 and got[61] > 0
    assert rays.crossed_bricks(ray, 40).groupBy("ray_id").count().agg(F.max("count")).first()[0] <= 7  # of 3 by 3 by 3
    assert rays.crossed_bricks(ray, 16).count() == 63
