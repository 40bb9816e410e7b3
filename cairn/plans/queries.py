"""The catalogue of queries: every operator over the whole tables of a scale factor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.columns import rounded, uniform
from cairn.operators import dataset, harmonics, metadata, morph, octree, patches, raygen, rays, registry, scatter, sparse, splits, transfer, transforms, voxel
from cairn.plans.stages import materialize, table
from cairn.sources import adapters as src

R, LEAST = src.GRID, 4
PATCHES, N_SH = 24, 4
N = PATCHES * N_SH
PER_FACE = N // 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and rounded doubles, so that engines agree."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType.simpleString()
        out.append((c.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else rounded(c.cast("double")) if kind in ("float", "double") else c).alias(f.name))
    return df.select(*out)


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
    return f


def tree(spark, d) -> DataFrame:
    return octree.subdivide(src.cells(spark, d), src.objects(spark, d), R, LEAST)


def usage(spark, d) -> DataFrame:
    return splits.hash_usage(tree(spark, d), splits.assign_splits(src.objects(spark, d)))


# voxels


@query
def voxelize_points(spark, d):
    return voxel.voxelize(src.points(spark, d), R)


@query
def voxel_pitch(spark, d):
    return voxel.voxel_pitch(src.points(spark, d), R).select("object_id", "pitch")


@query
def voxel_occupancy(spark, d):
    return voxel.occupancy(src.cells(spark, d), src.objects(spark, d), R)


@query
def grid_pad_crop(spark, d):
    sizes = src.objects(spark, d).select("object_id", F.lit(16).alias("ni"), F.lit(16).alias("nj"), F.lit(16).alias("nk"))
    small = voxel.pad_crop(src.cells(spark, d), sizes, 11)
    return small.groupBy("object_id").agg(F.count("*").alias("n"), F.sum(F.col("i") * 10000 + F.col("j") * 100 + F.col("k")).alias("checksum"))


@query
def upsample_diff(spark, d):
    c = src.cells(spark, d)
    return voxel.grid_difference(voxel.upsample(c.where("i < 8 and j < 8 and k < 8")), c)


@query
def silhouettes(spark, d):
    return voxel.silhouette(src.cells(spark, d), "k").groupBy("object_id").agg(F.count("*").alias("area"))


@query
def middle_slice(spark, d):
    return voxel.grid_slice(src.cells(spark, d), "i", 8).groupBy("object_id").agg(F.count("*").alias("n"))


@query
def point_clouds(spark, d):
    p = voxel.point_cloud(src.cells(spark, d))
    return p.groupBy("object_id").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), *[F.sum(F.col("weight") * F.col(a)).alias(f"mean_{a}") for a in "xyz"])


@query
def interior_fill(spark, d):
    return voxel.fill_interior(src.cells(spark, d), R).groupBy("object_id").agg(F.count("*").alias("n_filled"))


# octree and registry


@query
def octree_map(spark, d):
    return tree(spark, d).drop("size")


@query
def octree_lossless(spark, d):
    return octree.lossless(src.cells(spark, d), R, LEAST)


@query
def octree_children(spark, d):
    c = octree.children(materialize(tree(spark, d), "tree"))
    return c.groupBy("object_id", "level", "parent_hash").agg(F.count("*").alias("n_children"), F.count_if("is_empty").alias("n_empty"))


@query
def subvolume_hash(spark, d):
    return octree.hashed_blocks(src.cells(spark, d), R, LEAST).drop("n_cells")


@query
def subvolume_hash_lists(spark, d):
    b = octree.blocks(src.cells(spark, d), R, LEAST)
    return b.select("object_id", "level", "bi", "bj", "bk", octree.content_hash().alias("hash"))


@query
def registry_table(spark, d):
    return registry.registry(tree(spark, d))


@query
def registry_level_stats(spark, d):
    return registry.level_stats(tree(spark, d))


@query
def registry_overall(spark, d):
    return registry.overall_stats(tree(spark, d))


@query
def registry_new_per_object(spark, d):
    return registry.new_per_object(materialize(tree(spark, d), "tree"))


@query
def most_common_topk(spark, d):
    return registry.most_common(tree(spark, d), 5)


@query
def hash_frequency(spark, d):
    return registry.hash_frequency(tree(spark, d))


@query
def resume_missing(spark, d):
    t = materialize(tree(spark, d), "tree")
    return registry.missing(t, t.where("not is_full").select("level", "hash").distinct())


# metadata


@query
def object_complexity(spark, d):
    return metadata.object_complexity(tree(spark, d))


@query
def complexity_extremes(spark, d):
    return metadata.complexity_extremes(materialize(tree(spark, d), "tree"))


@query
def summary_statistics(spark, d):
    return metadata.summary(tree(spark, d))


@query
def empty_ratio(spark, d):
    return metadata.empty_ratio(tree(spark, d))


@query
def octant_distribution(spark, d):
    return metadata.octant_distribution(tree(spark, d))


@query
def level_hash_frequency(spark, d):
    return metadata.level_hash_frequency(tree(spark, d))


@query
def cooccurrence_pairs(spark, d):
    return metadata.cooccurrence(materialize(tree(spark, d), "tree"), 1)


@query
def common_contents(spark, d):
    return metadata.common_contents(tree(spark, d), 1, 1_000)


@query
def thing_first_wins(spark, d):
    things = table(spark, d, "events").select(F.col("user_id").alias("thing_id"), "event_id", "event_type")
    return metadata.first_wins(things, "thing_id", "event_id")


@query
def dedup_documents(spark, d):
    b = src.blobs(spark, d)
    return b.groupBy("level").agg(F.count("*").alias("total"), F.countDistinct("hash").alias("unique"), F.countDistinct("object_id").alias("objects"))


# splits


@query
def split_assignment(spark, d):
    return splits.assign_splits(src.objects(spark, d))


@query
def split_object_counts(spark, d):
    return splits.object_counts(spark, splits.assign_splits(src.objects(spark, d)))


@query
def hash_split_distribution(spark, d):
    return splits.distribution(usage(spark, d))


@query
def hash_split_distribution_full(spark, d):
    return splits.distribution(usage(spark, d), "empty_or_full")


@query
def object_purity(spark, d):
    return splits.purity(materialize(usage(spark, d), "usage"))


@query
def splits_using_hash(spark, d):
    return splits.splits_using(usage(spark, d))


@query
def objects_using_hash(spark, d):
    return splits.objects_using(usage(spark, d))


@query
def nontrivial_hashes_by_split(spark, d):
    return splits.nontrivial_by_split(materialize(usage(spark, d), "usage"))


@query
def subvolume_split_info(spark, d):
    return splits.subvolume_split_info(materialize(usage(spark, d), "usage"))


# training data


@query
def sample_collection(spark, d):
    o = src.objects(spark, d)
    return dataset.collect_samples(tree(spark, d), o, splits.assign_splits(o), "val")


@query
def level_distribution(spark, d):
    o = src.objects(spark, d)
    return metadata.level_distribution(dataset.collect_samples(tree(spark, d), o, splits.assign_splits(o), "train"))


def ray_counts(spark, d) -> DataFrame:
    return src.rays(spark, d).groupBy("object_id").agg(F.count("*").alias("n_rays"))


@query
def chunk_index(spark, d):
    return dataset.chunk_index(ray_counts(spark, d), ["object_id"], "n_rays", 4)


@query
def chunk_slice(spark, d):
    return dataset.fetch_chunk(dataset.numbered(src.rays(spark, d).select("object_id", "ray_id"), ["object_id"], ["ray_id"]), 1, 4)


@query
def batch_assign(spark, d):
    return dataset.batches(src.objects(spark, d), "object_id", 16)


@query
def collate_offsets(spark, d):
    sizes = voxel.occupancy(src.cells(spark, d), src.objects(spark, d), R).select("object_id", F.col("num_occupied").alias("num_nodes"))
    return dataset.collate(dataset.batches(src.objects(spark, d), "object_id", 16), sizes, "object_id")


@query
def sparse_coo(spark, d):
    return sparse.coo(src.cells(spark, d)).groupBy("object_id").agg(F.count("*").alias("n"), F.sum("feature").alias("total"), *[F.sum(a).alias(f"sum_{a}") for a in "xyz"])


def _edge_digest(e: DataFrame) -> DataFrame:
    return e.groupBy("object_id").agg(F.count("*").alias("n_edges"), F.sum(F.col("src") * 4096 + F.col("dst")).alias("checksum"))


@query
def sparse_edges_6(spark, d):
    return _edge_digest(sparse.edges(src.cells(spark, d), 6))


@query
def sparse_edges_18(spark, d):
    return sparse.neighbour_counts(src.cells(spark, d), 18)


@query
def sparse_edges_26(spark, d):
    return sparse.neighbour_counts(src.cells(spark, d), 26)


@query
def sparse_stats(spark, d):
    return sparse.sparse_statistics(src.cells(spark, d), src.objects(spark, d), R)


@query
def coo_to_dense(spark, d):
    c = sparse.to_dense(sparse.coo(src.cells(spark, d)))
    return c.groupBy("object_id").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total"))


def _cell_digest(c: DataFrame) -> DataFrame:
    return c.groupBy("object_id").agg(F.count("*").alias("n"), F.sum(F.col("i") * 10000 + F.col("j") * 100 + F.col("k")).alias("checksum"))


@query
def rotate90(spark, d):
    return _cell_digest(transforms.rotate_cells(src.cells(spark, d), transforms.quarter_turns(src.objects(spark, d)), R))


@query
def rotate90_rays(spark, d):
    return transforms.rotate_rays(src.rays(spark, d), transforms.quarter_turns(src.objects(spark, d))).select("ray_id", "turns", "ox", "oy", "dx", "dy")


@query
def flip(spark, d):
    return _cell_digest(transforms.flip_cells(src.cells(spark, d), transforms.flips(src.objects(spark, d)), R))


@query
def flip_rays(spark, d):
    return transforms.flip_rays(src.rays(spark, d), transforms.flips(src.objects(spark, d))).select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz")


@query
def normalize_origins(spark, d):
    return transforms.normalize_origins(src.rays(spark, d), R, 0.7).select("ray_id", "ox", "oy", "oz")


@query
def ray_subsample(spark, d):
    return transforms.subsample(src.rays(spark, d), "object_id", "ray_id", 3).select("object_id", "ray_id")


@query
def occupancy_jitter(spark, d):
    return _cell_digest(transforms.jitter(src.cells(spark, d), src.objects(spark, d), R, 0.01))


@query
def add_noise(spark, d):
    return transforms.add_noise(src.rays(spark, d)).select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz")


# rays


def reaches(spark, d) -> DataFrame:
    """``object_id, lo_x .. hi_z, reach``: every object's own box, and how far it extends from the grid's centre."""
    box = raygen.object_boxes(src.cells(spark, d), R)
    return box.withColumn("reach", F.greatest(*[F.abs(c) for c in raygen.BOX]))


@query
def views_sphere(spark, d):
    return rays.sphere_views(reaches(spark, d), 6, 2 * F.col("reach"))


@query
def rays_sphere(spark, d):
    return raygen.sphere_rays(raygen.object_boxes(src.cells(spark, d), R), 3, 6)


@query
def rays_all_faces(spark, d):
    return raygen.face_rays(raygen.object_boxes(src.cells(spark, d), R), 5)


@query
def rays_orthographic(spark, d):
    return rays.orthographic_rays(reaches(spark, d), 8, 6, 2 * F.col("reach"), 3 * F.col("reach"))


@query
def rays_perspective(spark, d):
    return rays.perspective_rays(reaches(spark, d), 8, 6, (4.0, 3.0, 2.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), size=F.col("reach"))


@query
def turntable_views(spark, d):
    return rays.turntable(reaches(spark, d), 8, 2 * F.col("reach"))


@query
def adaptive_samples(spark, d):
    return rays.adaptive_samples(tree(spark, d), 1000, 300)


@query
def trace_dda(spark, d):
    return rays.trace(src.rays(spark, d), src.cells(spark, d), R)


@query
def trace_dda_cells(spark, d):
    return rays.trace_cells(src.rays(spark, d), src.cells(spark, d), R)


@query
def trace_exit(spark, d):
    return rays.trace_exit(src.rays(spark, d), R)


def traced(spark, d) -> DataFrame:
    t = rays.trace(src.rays(spark, d), src.cells(spark, d), R)
    return t.withColumns({"view_id": F.col("ray_id") % 36, "face_id": F.col("ray_id") % 6, "level": (F.col("ray_id") % 3).cast("int")})


@query
def ray_stats_view(spark, d):
    return rays.ray_statistics(traced(spark, d), "view_id")


@query
def ray_stats_face(spark, d):
    return rays.ray_statistics(traced(spark, d), "face_id")


@query
def ray_stats_level(spark, d):
    return rays.ray_statistics(traced(spark, d), "level")


@query
def distance_normalize(spark, d):
    return rays.normalize_distance(traced(spark, d), F.col("level"), R).select("ray_id", "distance")


@query
def occlusion_field(spark, d):
    return rays.occlusion(traced(spark, d))


@query
def distance_mse(spark, d):
    t = rays.normalize_distance(traced(spark, d), F.col("level"), R).withColumn("guess", F.lit(0.1))
    return dataset.mean_squared_error(t, "distance", "guess", "level")


# patches and harmonics


def _patches(spark, d, per_face=4) -> DataFrame:
    low, high = ([F.col(f"{e}_{a}") for a in "xyz"] for e in ("lo", "hi"))
    return patches.boundary_patches(reaches(spark, d), low, high, per_face)


@query
def boundary_patches(spark, d):
    return _patches(spark, d)


@query
def patch_index_decode(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 384).alias("patch_id")).distinct()
    return patches.decode_index(li, "patch_id", 8)


@query
def patch_points(spark, d):
    at = [uniform(s, F.col("object_id"), F.col("patch_id")) for s in "uv"]
    return patches.sample_points(_patches(spark, d), *at)


@query
def exit_patch(spark, d):
    e = rays.trace_exit(src.rays(spark, d), R).join(src.rays(spark, d).select("ray_id", "dx", "dy", "dz"), "ray_id")
    return patches.exit_patch(e.drop("exit_face").withColumnsRenamed({"ex": "px", "ey": "py", "ez": "pz"}), -8.0, 8.0, 8).select("ray_id", "exit_face", "exit_patch")


@query
def patch_solid_angle(spark, d):
    return patches.solid_angle(_patches(spark, d), (20.0, 3.0, -12.5))


@query
def sh_basis(spark, d):
    b = harmonics.with_basis(src.directions(spark, d))
    return b.select("event_id", *[F.col("basis")[i].alias(f"y{i}") for i in range(9)])


@query
def sh_project(spark, d):
    return harmonics.project(src.directions(spark, d), "event_type")


@query
def sh_reconstruct(spark, d):
    e = src.directions(spark, d)
    return harmonics.reconstruct(e.drop("value"), harmonics.project(e, "event_type"), "event_type").select("event_id", "value")


@query
def sh_inner_products(spark, d):
    return harmonics.inner_products(src.directions(spark, d))


@query
def hg_sample(spark, d):
    e = table(spark, d, "events").select("event_id", uniform("u", F.col("event_id")).alias("u"), uniform("v", F.col("event_id")).alias("v"))
    x, y, z = harmonics.henyey_greenstein(F.lit(0.6), F.col("u"), F.col("v"))
    return e.select("event_id", x.alias("x"), y.alias("y"), z.alias("z"))


# transfer matrices


@query
def matrix_stats(spark, d):
    return transfer.statistics(src.matrix(spark, d), N)


@query
def matrix_column_sums(spark, d):
    return transfer.column_sums(src.matrix(spark, d))


@query
def matrix_column_statistics(spark, d):
    return transfer.column_sum_statistics(src.matrix(spark, d), N)


@query
def matrix_row_sums(spark, d):
    return transfer.row_sums(src.matrix(spark, d))


@query
def matrix_symmetry(spark, d):
    return transfer.symmetry_error(src.matrix(spark, d))


@query
def matrix_sparsity(spark, d):
    return transfer.sparsity(src.matrix(spark, d), N)


@query
def face_energy(spark, d):
    return transfer.face_energy(src.matrix(spark, d), PER_FACE)


@query
def face_transport(spark, d):
    return transfer.face_transport(src.matrix(spark, d), PER_FACE)


@query
def sh_coupling(spark, d):
    return transfer.sh_coupling(src.matrix(spark, d), N_SH)


@query
def matrix_diff(spark, d):
    return transfer.differences(materialize(src.matrix(spark, d), "matrix"), N)


@query
def view_radiance(spark, d):
    return transfer.view_radiance(src.matrix(spark, d), N_SH, PER_FACE, 1)


@query
def mean_radiance(spark, d):
    return transfer.mean_radiance(src.matrix(spark, d), N_SH, PATCHES, 6)


@query
def boundary_radiance(spark, d):
    light = spark.range(N).select(F.col("id").cast("int").alias("in_idx"), (1.0 / (F.col("id") + 1)).alias("amount"))
    return transfer.boundary_radiance(src.matrix(spark, d), light, N_SH)


@query
def exit_energy(spark, d):
    return transfer.exit_energy(src.matrix(spark, d), N_SH)


@query
def matrix_histogram(spark, d):
    return transfer.histogram(src.matrix(spark, d), -4.0, 2.0, 30)


def errors(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("w", F.col("l_discount") + 0.01)
    e = li.groupBy(F.col("l_returnflag").alias("structure"), (F.col("l_suppkey") % N).alias("in_idx"), (F.col("l_partkey") % PATCHES).alias("exit_patch")).agg(
        F.sum(F.col("w") * F.col("w")).alias("weight_sq_sum"), F.count("*").alias("sample_count"), F.sum("w").alias("s")
    )
    return e.withColumn("sh_energy", F.col("s") * F.col("s") * 0.9e-4)


@query
def sh_error_summary(spark, d):
    return transfer.error_summary(errors(spark, d), 100)


@query
def spectral_radius(spark, d):
    return transfer.spectral_radius(src.matrix(spark, d).withColumn("value", F.abs("value")))


@query
def monte_carlo_transfer(spark, d):
    """Whole transfer matrices: every incident condition of every object."""
    light = src.objects(spark, d).select(F.col("object_id").alias("structure"), F.explode(F.sequence(F.lit(0), F.lit(6 * N_SH - 1))).alias("in_idx"))
    out = scatter.transfer_matrix(light, src.cells(spark, d), R, scatter.OpticalProperties(0.3, 0.05, 0.2), 1, N_SH)
    return out.groupBy("structure", "in_idx").agg(F.count("*").alias("n_entries"))


# morphs


def plan(spark, d) -> DataFrame:
    """A sparse coupling between each embedding label's triples 0-9 and 10-19."""
    p = src.points(spark, d).withColumns({a: F.col(a) * 10 + 8 for a in "xyz"})
    s = p.where("t < 10").select("object_id", (F.col("vec_id") * 10 + F.col("t")).alias("src"), *[F.col(a).alias(f"s{a}") for a in "xyz"])
    t = p.where("t between 10 and 19").select("object_id", (F.col("vec_id") * 10 + F.col("t") - 10).alias("src"), F.col("t").cast("long").alias("dst"), *[F.col(a).alias(f"t{a}") for a in "xyz"])
    both = s.join(t, ["object_id", "src"])
    nxt = s.join(t.withColumn("src", F.col("src") + 1).withColumn("dst", F.col("dst") + 100), ["object_id", "src"])
    return both.withColumn("weight", F.lit(0.75)).unionByName(nxt.withColumn("weight", F.lit(0.25)))


@query
def barycentric_interp(spark, d):
    return morph.interpolate(plan(spark, d), 0.25, "object_id")


@query
def split_interp(spark, d):
    return morph.split_interpolate(plan(spark, d), 0.5, "object_id")


@query
def transport_cost(spark, d):
    p = plan(spark, d)
    gap = [F.col(f"s{a}") - F.col(f"t{a}") for a in "xyz"]
    return morph.transport_cost(p.withColumn("distance", F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])), "object_id")


@query
def raymap_splat(spark, d):
    return morph.splat_rays(plan(spark, d), 6, "object_id")


@query
def gaussian_splat(spark, d):
    p = src.points(spark, d).where("t < 20").withColumns({a: F.col(a) * 12 + 8 for a in "xyz"})
    return morph.splat_gaussian(p, "object_id", R, 0.7, 0.25)


@query
def morph_stats(spark, d):
    steps = morph.splat_rays(plan(spark, d), 6, "object_id")
    return morph.morph_statistics(steps, R, "object_id")


@query
def sinkhorn_plan(spark, d):
    p = src.points(spark, d).where("t < 20").groupBy("object_id", "t").agg(*[F.avg(a).alias(a) for a in "xyz"]).withColumn("id", F.col("t").cast("long"))
    pairs = morph.distances(p.where("t < 10"), p.where("t >= 10"), "object_id")
    return morph.transport_cost(morph.sinkhorn(pairs, "object_id", 0.05), "key")


from cairn.plans import more_queries, spatial_queries  # noqa: E402, F401  add their queries to these
