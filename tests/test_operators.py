"""Invariants on small grids, against numpy and by hand."""

import hashlib
import math
import struct

import numpy as np
import pytest

from cairn.functions.columns import level_sizes, sh_order
from cairn.operators import dataset, harmonics, mesh, metadata, morph, octree, patches, rays, registry, scatter, sparse, splits, transfer, transforms, voxel
from pyspark.sql import functions as F

CELLS = "object_id string, i int, j int, k int"


def grid_cells(spark, grid, name="0000"):
    return spark.createDataFrame([(name, *map(int, c)) for c in np.argwhere(grid)], CELLS)


def names(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "object_id string")


def test_levels():
    assert level_sizes(128, 4) == [128, 64, 32, 16, 8, 4]
    with pytest.raises(ValueError):
        level_sizes(12, 4)
    assert [sh_order(n) for n in (1, 4, 9, 25)] == [0, 1, 2, 4]
    with pytest.raises(ValueError):
        sh_order(8)


@pytest.mark.parametrize("size,least", [(16, 4), (32, 2), (32, 8)])
def test_octree_equals_numpy(spark, size, least):
    grid = np.random.default_rng(3).random((size,) * 3) < 0.2
    grid[: size // 2, : size // 2, : size // 2] = True
    grid[size // 2 :, size // 2 :, size // 2 :] = False
    want = {}
    for level, s in list(enumerate(level_sizes(size, least)))[1:]:
        for a in range(0, size, s):
            for b in range(0, size, s):
                for c in range(0, size, s):
                    block = np.ascontiguousarray(grid[a : a + s, b : b + s, c : c + s])
                    octant = (a // s % 2) * 4 + (b // s % 2) * 2 + c // s % 2
                    want[level, a, b, c] = (octant, hashlib.sha256(block.tobytes()).hexdigest(), not block.any(), bool(block.all()))
    tree = octree.subdivide(grid_cells(spark, grid), names(spark, "0000"), size, least).collect()
    got = {(r.level, r.global_position_x, r.global_position_y, r.global_position_z): (r.octant_index, r.hash, r.is_empty, r.is_full) for r in tree}
    assert got == want and len(tree) == len(want)


def test_objects_without_cells_are_subdivided(spark):
    tree = octree.subdivide(spark.createDataFrame([], CELLS), names(spark, "a", "b"), 16, 4)
    assert tree.where("is_empty").count() == tree.count() == 2 * 72
    assert {(r.level, r.unique, r.total, r.empty) for r in registry.level_stats(tree).collect()} == {(1, 1, 16, 1), (2, 1, 128, 1)}


def test_one_changed_cell_leaks_all_but_its_blocks(spark):
    grid = np.random.default_rng(123).random((8, 8, 8)) > 0.5
    other = grid.copy()
    other[6, 6, 6] ^= True
    cells = grid_cells(spark, grid, "0000").union(grid_cells(spark, other, "0001"))
    tree = octree.subdivide(cells, names(spark, "0000", "0001"), 8, 4)
    assigned = splits.assign_splits(names(spark, "0000", "0001"), 0.5, 0.5, 0.0)
    assert {r.split for r in assigned.collect()} == {"train", "val"}
    p = {r.object_id: r for r in splits.purity(splits.hash_usage(tree, assigned)).collect()}
    assert all((r.total_subvolumes, r.pure, r.shared_other_split) == (8, 1, 7) for r in p.values())


def test_pairs_of_frequent_contents(spark):
    rows = [(n, 1, h, False, False) for n in range(1200) for h in ("a", "b", *(["c"] if n < 3 else []), "a")]
    tree = spark.createDataFrame([*rows, (0, 2, "d", False, False), (0, 1, "e", True, False)], "object_id int, level int, hash string, is_empty boolean, is_full boolean")
    got = {tuple(r) for r in metadata.cooccurrence(tree, 1).collect()}
    assert got == {("a", "b", 1200), ("a", "c", 3), ("b", "c", 3)}


def test_split_ratios(spark):
    splits.check_ratios(0.8, 0.2, 0.0)
    with pytest.raises(ValueError, match="sum to 1.0"):
        splits.check_ratios(0.8, 0.3, 0.0)
    with pytest.raises(ValueError, match="non-negative"):
        splits.check_ratios(0.8, -0.2, 0.4)
    seven = splits.assign_splits(names(spark, *map(str, range(7))), 0.8, 0.2, 0.0)
    assert {r.split: r.n_objects for r in splits.object_counts(spark, seven).collect()} == {"train": 5, "val": 1, "test": 1}


@pytest.mark.parametrize("size", [16, 64])
def test_sphere_and_full_grid_chords(spark, size):
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    full = names(spark, "full").withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis)).withColumn("k", F.explode(axis))
    cells = full.union(voxel.sphere(spark, size))
    ray = spark.createDataFrame([(n, o, 0.01, 0.02, -2.0 * size, 0.0, 0.0, 1.0) for n, o in enumerate(("full", "sphere", "none"))], "ray_id long, object_id string, ox double, oy double, oz double, dx double, dy double, dz double")
    for got in (rays.trace_cells(ray, cells, size),) + ((rays.trace(ray, cells, size),) if size <= 62 else ()):
        d = {r.object_id: r.distance for r in got.collect()}
        assert d["full"] == pytest.approx(size) and d["none"] == 0 and d["sphere"] == pytest.approx(size / 2, rel=0.15)


def test_edges_equal_numpy(spark):
    grid = np.random.default_rng(5).random((16, 16, 16)) < 0.3
    cells = grid_cells(spark, grid)
    for kind, reach in ((6, 1), (18, 2), (26, 3)):
        want = 0
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                for c in (-1, 0, 1):
                    if 0 < abs(a) + abs(b) + abs(c) <= reach:
                        q = np.zeros((18, 18, 18), bool)
                        q[1 + a : 17 + a, 1 + b : 17 + b, 1 + c : 17 + c] = grid
                        want += int((q[1:17, 1:17, 1:17] & grid).sum())
        assert sparse.edges(cells, kind).count() == want == sparse.neighbour_counts(cells, kind).first().num_edges
    with pytest.raises(ValueError):
        sparse.offsets(7)


def test_patches(spark):
    p = patches.boundary_patches(spark, (-1.0,) * 3, (1.0,) * 3, 4)
    rows = p.collect()
    assert len(rows) == 96 and sum(r.area for r in rows) == pytest.approx(24)
    assert all(r.normal_x**2 + r.normal_y**2 + r.normal_z**2 == 1 and r.center_x * r.normal_x + r.center_y * r.normal_y + r.center_z * r.normal_z == 1 for r in rows)
    d = patches.decode_index(spark.createDataFrame([(65,)], "patch_id int"), "patch_id", 8).first()
    assert (d.face_id, d.u, d.v, d.opposite_face) == (1, 1, 0, 0)
    inner = spark.createDataFrame([(0.1, 0.2, 0.3, 0.0, -1.0, 0.0), (1.0, 0.2, 0.3, 0.0, 1.0, 0.0)], "px double, py double, pz double, dx double, dy double, dz double")
    assert [r.exit_face for r in patches.exit_patch(inner, -1.0, 1.0, 4).collect()] == [3, 0]


def test_harmonics(spark):
    d = harmonics.sphere_directions(spark.range(50_000), "id")
    gram = {(r.a, r.b): r.product for r in harmonics.inner_products(d, 4).collect()}
    assert all(abs(v - (a == b)) < 0.08 for (a, b), v in gram.items()) and len(gram) == 625
    c = {r.sh_idx: r.coefficient for r in harmonics.project(d.withColumn("value", 1 + 0.5 * F.col("z"))).collect()}
    assert c[0] * 0.282095 == pytest.approx(1, abs=0.02) and c[2] * 0.488603 == pytest.approx(0.5, abs=0.02)
    e = spark.range(1).select(*[x.alias(n) for n, x in zip("xyz", harmonics.to_world([F.lit(0.0), F.lit(0.0), F.lit(1.0)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)]), strict=True)]).first()
    assert (e.x, e.y, e.z) == pytest.approx((0, 1, 0))


def test_optical_properties_and_scatter(spark):
    p = scatter.OpticalProperties(2, 0.5)
    assert (p.sigma_t, p.albedo, p.mean_free_path) == pytest.approx((2.5, 0.8, 0.4))
    for bad in ((-1, 1, 0), (0, 0, 0), (1, 1, 1.5)):
        with pytest.raises(ValueError):
            scatter.OpticalProperties(*bad)
    lit = spark.createDataFrame([("a", 0)], "structure string, in_idx int")
    empty = scatter.transfer_matrix(lit, spark.createDataFrame([], CELLS), 8, p, 1, 1, samples=200)
    rows = empty.collect()
    assert rows and all(r.out_idx != 0 for r in rows)  # nothing scatters back to the lit face


def test_fill_and_mesh(spark):
    grid = np.zeros((9, 9, 9), bool)
    grid[2:7, 2:7, 2:7] = True
    grid[3:6, 3:6, 3:6] = False
    assert voxel.fill_interior(grid_cells(spark, grid), 9).count() == 125
    corners = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    tris = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    rows = [("cube", n, *corners[a], *corners[b], *corners[c]) for n, (a, b, c) in enumerate(tris)]
    from cairn.sources.files import TRIANGLES

    solid = mesh.voxelize_mesh(spark.createDataFrame(rows, TRIANGLES), 8)
    assert solid.count() == 512
    assert mesh.voxelize_mesh(spark.createDataFrame(rows, TRIANGLES), 8, solid=False).count() == 512 - 216


def test_stl_and_build(spark, tmp_path):
    from cairn.plans.build import build
    from cairn.sources import files, sinks

    tri = struct.pack("<12fH", 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0)
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.stl").write_bytes(bytes(80) + struct.pack("<I", 1) + tri)
    (tmp_path / "m/b.stl").write_text("solid b\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 1\nendloop\nendfacet\nendsolid")
    (tmp_path / "m/c.stl").write_bytes(b"nothing")
    good, bad = files.read_stl(spark, str(tmp_path / "m"))
    assert {r.object_id for r in good.collect()} == {"a", "b"} and [r.object_id for r in bad.collect()] == ["c"]
    cells = mesh.voxelize_mesh(good, 16, solid=False)
    objects = good.select("object_id").distinct()
    first = build(spark, cells.where("object_id = 'a'"), objects.where("object_id = 'a'"), str(tmp_path / "out"), 16, 4).collect()
    again = build(spark, cells, objects, str(tmp_path / "out"), 16, 4).collect()
    assert {r.total for r in first} == {8, 64} and {r.total for r in again} == {16, 128}
    back = sinks.load_split_documents(spark.read.parquet(str(tmp_path / "out/splits")))
    assert back.select("object_id").distinct().count() == 2


def test_npz_and_rays(spark, tmp_path):
    from cairn.sources import files

    grid = np.zeros((4, 4, 4), np.float32)
    grid[1, 2, 3] = 0.7
    np.savez(tmp_path / "g.npz", occupancy=grid)
    assert [tuple(r) for r in files.read_grids(spark, str(tmp_path)).collect()] == [("g", 1, 2, 3)]
    (tmp_path / "r/level_2/ab").mkdir(parents=True)
    np.savez(tmp_path / "r/level_2/ab/abc_rays.npz", origins=np.zeros((2, 3)), directions=np.ones((2, 3)), distances=np.array([0, 1.5]), hits=np.array([0, 1], np.uint8))
    r = files.read_ray_archives(spark, str(tmp_path / "r")).orderBy("ray_id").collect()
    assert [(x.level, x.hash, x.hit, x.view_id) for x in r] == [(2, "abc", 0, -1), (2, "abc", 1, -1)]


def test_transforms_undo_themselves(spark):
    cells = grid_cells(spark, np.random.default_rng(1).random((8, 8, 8)) < 0.3)
    turn = names(spark, "0000").withColumn("turns", F.lit(1))
    four = cells
    for _ in range(4):
        four = transforms.rotate_cells(four, turn, 8)
    assert four.exceptAll(cells).isEmpty() and cells.exceptAll(four).isEmpty()
    flip = names(spark, "0000").selectExpr("object_id", "true flip_i", "false flip_j", "true flip_k")
    assert transforms.flip_cells(transforms.flip_cells(cells, flip, 8), flip, 8).exceptAll(cells).isEmpty()


def test_chunks_and_batches(spark):
    c = dataset.chunk_index(spark.createDataFrame([("a", 10), ("b", 0), ("c", 4)], "s string, n long"), ["s"], "n", 4)
    assert sorted((r.s, r.chunk_start, r.chunk_end) for r in c.collect()) == [("a", 0, 4), ("a", 4, 8), ("a", 8, 10), ("c", 0, 4)]
    b = dataset.batches(names(spark, *map(str, range(10))), "object_id", 4, drop_last=True)
    assert sorted(r.batch for r in b.collect()) == [0] * 4 + [1] * 4


def test_matrix_and_morph(spark):
    m = np.array([[0.0, 2.0, 0.0], [1.0, 0.0, 0.0], [0.0, -3.0, 4.0]])
    t = spark.createDataFrame([("s", int(a), int(b), float(m[a, b])) for a, b in np.argwhere(m)], "structure string, out_idx int, in_idx int, value double")
    s = transfer.statistics(t, 3).first()
    assert (s.min, s.max, s.mean, s.std, s.nnz_ratio) == pytest.approx((-3, 4, m.mean(), m.std(), 4 / 9))
    assert transfer.symmetry_error(t).first().symmetry_error == 3
    assert transfer.spectral_radius(t).first().spectral_radius == pytest.approx(4)
    pts = spark.createDataFrame([("k", n, float(n), 0.0, 0.0) for n in range(5)], "key string, id long, x double, y double, z double")
    plan = morph.sinkhorn(morph.distances(pts, pts, "key"), "key", 0.05)
    total = plan.agg(F.sum("weight"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")))).first()
    assert total[0] == pytest.approx(1, abs=1e-4) and total[1] > 0.99
    assert math.isclose(metadata.level_distribution(spark.createDataFrame([(1,), (1,)], "level int")).first()["count"], 2)


def test_stream(spark, tmp_path):
    from cairn.streaming import registry as stream

    tree = octree.subdivide(grid_cells(spark, np.ones((8, 8, 8), bool)), names(spark, "0000"), 8, 4)
    tree.select("object_id", "level", "octant_index", "position_x", "position_y", "position_z", "global_position_x", "global_position_y", "global_position_z", "hash", "is_empty").write.parquet(str(tmp_path / "in"))
    q = stream.keep_counts(stream.record_stream(spark, str(tmp_path / "in")), str(tmp_path / "counts"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["count"] for r in stream.read_counts(spark, str(tmp_path / "counts")).collect()] == [8]


def test_broken_and_mesh_archives(spark, tmp_path):
    from cairn.sources import files

    np.savez(tmp_path / "good.npz", voxels=np.ones((2, 2, 2), bool))
    np.savez(tmp_path / "flat.npz", voxels=np.ones(3))
    np.savez(tmp_path / "other.npz", something=np.ones(3))
    (tmp_path / "cut.npz").write_bytes(b"PK\x03\x04 not whole")
    cells, errors = files.scan_grids(spark, str(tmp_path))
    assert cells.count() == 8 and {r.object_id for r in errors.collect()} == {"flat", "other", "cut"}
    (tmp_path / "m").mkdir()
    np.savez(tmp_path / "m/a.npz", vertices=np.eye(3), faces=np.array([[0, 1, 2]]))
    (r,) = files.read_mesh_archives(spark, str(tmp_path / "m")).collect()
    assert (r.object_id, r.ax, r.by, r.cz, r.ay) == ("a", 1.0, 1.0, 1.0, 0.0)


def test_objects_without_a_split_and_samples_without_voxels_raise(spark):
    from cairn.operators import dataset, splits

    tree = spark.createDataFrame([("a", 1, "h", False, False), ("b", 1, "h", False, False)], "object_id string, level int, hash string, is_empty boolean, is_full boolean")
    assigned = spark.createDataFrame([("a", "train")], "object_id string, split string")
    with pytest.raises(Exception, match="no split is assigned to object b"):
        splits.hash_usage(tree, assigned).collect()
    samples = spark.createDataFrame([(1, "h")], "level int, hash string")
    assert dataset.existing_samples(samples, samples).count() == 1
    with pytest.raises(ValueError, match="no samples are left"):
        dataset.existing_samples(samples, samples.limit(0))


def test_reassigned_splits_reach_the_documents(spark, tmp_path):
    from cairn.plans.build import build, reassign_splits
    from cairn.sources import sinks

    cells = spark.createDataFrame([(f"{n:04d}", n % 8, n // 8, 3) for n in range(20)], "object_id string, i int, j int, k int")
    build(spark, cells, cells.select("object_id").distinct(), str(tmp_path), 8, 4)
    new = {r.object_id: r.split for r in reassign_splits(spark, str(tmp_path), (0.5, 0.25, 0.25), 7).collect()}
    back = {r.object_id: r.split for r in sinks.load_split_documents(spark.read.parquet(str(tmp_path / "splits"))).collect()}
    assert back == new and sorted(new.values()).count("train") == 10


def test_composition_documents_and_released_tables(spark, tmp_path):
    from cairn.operators import transforms
    from cairn.plans import stages
    from cairn.sources import sinks

    df = spark.range(5)
    assert transforms.compose()(df) is df
    assert transforms.compose(lambda d: d.where("id > 1"), lambda d: d.where("id < 4"))(df).count() == 2
    sinks.write_document(spark, str(tmp_path / "doc"), a=1, b=[2, "é"])
    assert sinks.read_document(spark, str(tmp_path / "doc")) == {"a": 1, "b": [2, "é"]}
    before = stages.written()
    gone, kept = stages.materialize(df, "gone"), stages.materialize(df, "kept")
    stages.release(spark, since=before, keep=kept)
    assert kept.count() == 5 and stages.written() == before + 1
    with pytest.raises(Exception):
        gone.count()


def test_objects_are_dealt_in_bounded_tasks_and_joined_where_they_are(spark, sf_dir, monkeypatch):
    from cairn.plans.queries import QUERIES
    from cairn.sources import adapters

    monkeypatch.setattr(adapters, "DEALT", 20)  # of 200 objects; four shuffle partitions
    assert adapters.cells(spark, sf_dir).rdd.getNumPartitions() == adapters.objects(spark, sf_dir).rdd.getNumPartitions() == 10
    for name in ("coo_to_dense", "sparse_edges_18", "sparse_stats", "upsample_diff"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan, name


def test_blocks_are_hashed_from_bits_where_they_are(spark, capsys):
    grid = np.random.default_rng(5).random((16, 16, 16)) < 0.1
    for size, least in ((16, 4), (16, 1), (8, 4), (4, 2)):
        part = grid[:size, :size, :size]
        objects = names(spark, "0000", "0001").repartition(3, "object_id")
        tree = octree.subdivide(grid_cells(spark, part).repartition(3, "object_id"), objects, size, least)
        for r in tree.where("object_id = '0000'").collect():
            x, y, z = r.global_position_x, r.global_position_y, r.global_position_z
            block = part[x : x + r.size, y : y + r.size, z : z + r.size]
            assert r.hash == hashlib.sha256(block.astype(np.uint8).tobytes()).hexdigest() and r.is_empty == (not block.any()) and r.is_full == bool(block.all())
    capsys.readouterr()
    octree.subdivide(grid_cells(spark, grid), names(spark, "0000"), 16, 4).explain()
    plan = capsys.readouterr().out
    assert "unhex" not in plan and "lpad" not in plan  # no strings of digits are made of the cells


def test_small_blocks_list_their_cells_once_and_from_bits(spark):
    rng, rows = np.random.default_rng(4), []
    for o, side in enumerate((16, 16, 9)):
        rows += [(f"o{o}", *map(int, c)) for c in np.argwhere(rng.random((side,) * 3) < 0.4)]
    cells = spark.createDataFrame(rows + rows[::3], "object_id string, i int, j int, k int")
    for least in (1, 2, 4, 8):
        want: dict[tuple, list[int]] = {}
        for level, s in ((n, 16 >> n) for n in range(1, 5) if 16 >> n >= least):
            for o, i, j, k in rows:
                want.setdefault((o, level, i // s, j // s, k // s, s), []).append((i % s * s + j % s) * s + k % s)
        found = octree.blocks(cells, 16, least)
        assert {tuple(r)[:6]: r.occ for r in found.select("object_id", "level", "bi", "bj", "bk", "size", "occ").collect()} == {b: sorted(c) for b, c in want.items()}
        assert "collect_" not in found._jdf.queryExecution().executedPlan().toString()


def test_registries_are_counted_once_written(spark, tmp_path):
    from cairn.plans.build import build

    cells = spark.createDataFrame([(o, i, j, 0) for n, o in enumerate("abc") for i in range(4) for j in range(n + 1)], "object_id string, i int, j int, k int")
    objects = spark.createDataFrame([(o,) for o in "abc"], "object_id string")
    got = build(spark, octree.words(cells), objects, str(tmp_path / "d"), 8, 4)
    tree = octree.subdivide(cells, objects, 8, 4)
    assert got.collect() == registry.level_stats(tree).collect() and "registry" in got.inputFiles()[0]
    assert sorted(map(repr, registry.overall_counts(registry.registry(tree)).collect())) == sorted(map(repr, registry.overall_stats(tree).collect()))


def test_nodes_are_numbered_where_their_objects_are(spark, sf_dir):
    from cairn.plans import stages
    from cairn.plans.queries import QUERIES

    before = stages.written()
    plan = QUERIES["sparse_edges_6"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert stages.written() == before and "ENSURE_REQUIREMENTS" not in plan


def test_lists_of_cells_are_not_broadcast(spark, sf_dir):
    from cairn.plans.queries import QUERIES

    assert "BroadcastExchange" not in QUERIES["monte_carlo_transfer"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_transfer_matrices_are_whole_and_cells_stay_where_they_are(spark, sf_dir):
    from cairn.plans.queries import QUERIES

    rows = QUERIES["monte_carlo_transfer"](spark, sf_dir)
    assert {n for _, n in rows.groupBy("structure").count().collect()} == {24}
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1]
    assert "MapInArrow" in plan and "ENSURE_REQUIREMENTS" not in plan[plan.index("MapInArrow") :].split("Initial Plan")[0]


def test_paths_do_not_depend_on_what_is_walked_beside_them(spark):
    p, rng = scatter.OpticalProperties(0.4, 0.1, 0.3), np.random.default_rng(5)
    grids = {"a": rng.random((6, 6, 6)) < 0.4, "b": rng.random((6, 6, 6)) < 0.7}
    grids["c"] = grids["a"]
    one = {s: scatter.simulate(g, np.arange(96), p, 2, 4, 50, 256, 42) for s, g in grids.items()}
    assert np.array_equal(one["a"][7:9], scatter.simulate(grids["a"], np.arange(7, 9), p, 2, 4, 50, 256, 42)) and not np.array_equal(one["a"], one["b"])
    cells = spark.createDataFrame([(s, *map(int, c)) for s, g in grids.items() for c in np.argwhere(g)], CELLS)
    lit = spark.createDataFrame([(s, n) for s in grids for n in range(96)], "structure string, in_idx int")
    got = {(r.structure, r.in_idx, r.out_idx): r.value for r in scatter.transfer_matrix(lit, cells, 6, p, 2, 4, samples=50).collect()}
    assert got == {(s, int(i), int(q * 4 + m)): v[i, q, m] for s, v in one.items() for i, q, m in np.argwhere(v)}
    # without cells light goes straight on to the border
    straight = scatter.simulate(np.zeros((6, 6, 6), bool), np.array([0]), p, 1, 1, 40_000, 256, 42)[0, :, 0]
    r, phi, y, z = np.sqrt(rng.random(40_000)), 2 * np.pi * rng.random(40_000), *rng.random((2, 40_000))
    d = np.stack([np.sqrt(1 - r * r), r * np.cos(phi), r * np.sin(phi)])
    out = (np.where(d > 0, 1.0, 0.0) - np.stack([0 * y, y, z])) / d
    axis = out.argmin(0)
    face = 2 * axis + (d[axis, np.arange(40_000)] < 0)
    face[axis == 0] = 1  # lit is +X
    want = np.bincount(face, np.abs(d[axis, np.arange(40_000)]), 6) / 40_000 * 0.282094791773878**2
    assert straight == pytest.approx(want, rel=0.05)


def test_rare_draws_are_those_of_the_uniform_numbers(spark):
    from cairn.functions.columns import rarely, uniform

    for p in (0.0, 0.01, 1 / 3, 0.999, 1.0):
        both = spark.range(5000).where(rarely(p, "jit", F.col("id")) != (uniform("jit", F.col("id")) < p))
        assert both.isEmpty() and (p in (0.0, 1.0) or not spark.range(5000).where(rarely(p, "jit", F.col("id"))).isEmpty())


def test_interiors_of_random_grids_equal_a_search(spark):
    rng, rows, want = np.random.default_rng(17), [], set()
    for n in range(60):
        solid = np.ones((8, 8, 8), bool)
        solid[1:-1, 1:-1, 1:-1] = False
        solid[1:-1, 1:-1, 1:-1] = rng.random((6, 6, 6)) < rng.choice([0.3, 0.6, 0.8])
        solid = np.pad(np.delete(solid, [0, 7][: n % 2], 0)[:8], ((0, n % 2), (0, 0), (0, 0)))
        outside, todo, wall = np.zeros((10, 10, 10), bool), [(0, 0, 0)], np.pad(solid, 1)
        while todo:
            at = todo.pop()
            if min(at) >= 0 and max(at) < 10 and not wall[at] and not outside[at]:
                outside[at] = True
                todo += [tuple(np.add(at, d * s)) for d in np.eye(3, dtype=int) for s in (-1, 1)]
        rows += [(str(n), *map(int, c)) for c in np.argwhere(solid)]
        want |= {(str(n), *map(int, c)) for c in np.argwhere(~outside[1:-1, 1:-1, 1:-1])}
    got = voxel.fill_interior(spark.createDataFrame(rows, "object_id string, i int, j int, k int"), 8).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
