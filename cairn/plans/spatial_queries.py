"""Queries of transport, meshes, archives, versions, containment, sketches and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import layout, mesh, morton, octree, rays, sketches, splits, transfer, transport
from cairn.plans import queries as q
from cairn.plans.manifest import KINDS, Dataset
from cairn.plans.queries import LEAST, N_SH, PER_FACE, R, query
from cairn.plans.stages import materialize, new_path, sent, table
from cairn.sources import adapters as src
from cairn.sources import archives, sinks, stl


def triangles(spark, d):
    """``object_id, face_id, ax .. cz``: embeddings cut into seven triangles each, by label (null: its own object)."""
    e = table(spark, d, "embeddings").select(F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("object_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("t"))
    return e.select("object_id", (F.col("vec_id") * 7 + F.col("t")).cast("int").alias("face_id"), *[F.get("embedding", F.col("t") * 9 + n).cast("double").alias(c) for n, c in enumerate(stl.CORNERS)])


# transport


@query
def exact_transport(spark, d):
    """Every embedding is three problems of seven points: three sources that send 2, 2 and 1, four sinks that take 2, 1, 1 and 1."""
    e = table(spark, d, "embeddings").where("vec_id IS NOT NULL").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("g"))
    points = e.select(F.concat_ws(":", "vec_id", "g").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("id"), "embedding", "g")
    points = points.select("key", F.col("id").cast("long").alias("id"), *[F.get("embedding", F.col("g") * 21 + F.col("id") * 3 + n).cast("double").alias(a) for n, a in enumerate("xyz")])
    one, other = points.where("id < 3"), points.where("id >= 3")
    gap = [F.col(f"s{a}") - F.col(f"t{a}") for a in "xyz"]
    pairs = one.select("key", F.col("id").alias("src"), *[F.col(a).alias(f"s{a}") for a in "xyz"]).join(other.select("key", F.col("id").alias("dst"), *[F.col(a).alias(f"t{a}") for a in "xyz"]), "key")
    pairs = pairs.withColumn("distance", F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]))
    sources = one.select("key", F.col("id").alias("src"), F.when(F.col("id") < 2, 2).otherwise(1).alias("supply"))
    sinks = other.select("key", F.col("id").alias("dst"), F.when(F.col("id") == 3, 2).otherwise(1).alias("demand"))
    _, certificate = transport.exact_transport(transport.whole_costs(materialize(pairs, "pairs"), 2), sources, sinks)
    return certificate.select("key", "units", "cost", "gap")


# meshes and files


@query
def mesh_cells(spark, d):
    return mesh.voxelize_mesh(triangles(spark, d), R, solid=False)


@query
def cube_mesh(spark, d):
    vertices, faces = mesh.cube_mesh(src.cells(spark, d))
    v = vertices.groupBy("object_id").agg(F.count("*").alias("n_vertices"), F.sum((F.col("vid") + 1) * (F.col("x") * 289 + F.col("y") * 17 + F.col("z"))).alias("vertex_sum"))
    f = faces.groupBy("object_id").agg(F.count("*").alias("n_faces"), F.sum((F.col("fid") + 1) * (F.col("a") * 3 + F.col("b") * 5 + F.col("c") * 7)).alias("face_sum"))
    return v.join(f, "object_id")


@query
def stl_roundtrip(spark, d):
    path = new_path(spark, "stl")
    stl.write_stl(triangles(spark, d), path)
    return stl.read_stl(spark, path, triangles_per_task=50)[0]


@query
def rays_of_level(spark, d):
    """Rays of one level, read from archives of three, of which only that level's are opened."""
    path = new_path(spark, "rays")
    t = rays.trace(src.rays(spark, d), src.cells(spark, d), R, whole=True)
    contents = t.select(
        (F.col("ray_id") % 3).cast("int").alias("level"), F.col("object_id").alias("hash"), F.col("ray_id").cast("int").alias("ray_id"), *[F.col(f"{p}{a}").cast("float").alias(f"{p}{a}") for p in "od" for a in "xyz"],
        F.col("distance").cast("float").alias("distance"), "hit", (F.col("ray_id") % 6).cast("int").alias("face_id"), (F.col("ray_id") % 36).cast("int").alias("view_id"),
    )
    archives.write_rays(contents, path, most=5_000, bundled=True)
    back = archives.read_archives(spark, path, "rays").where("level = 1 AND error IS NULL")
    return back.select("level", "hash", "ray_id", "hit", "face_id", "view_id", F.round(F.col("distance").cast("double"), 3).alias("distance"))


@query
def manifest_build(spark, d):
    """Versions of one dataset: half of the objects; all, a seventh of them changed; then some blocks lost and made again.

    Each object with the version that it was last made in, and its cells by the
    latest version's blocks: those of its map, and of the first version's, still readable.
    """
    path = new_path(spark, "versions")
    cells, objects = materialize(octree.words(src.cells(spark, d)), "cells"), materialize(src.objects(spark, d), "objects")
    number = F.col("object_id").cast("int")
    before = objects.where(number % 2 == 0).select("object_id", F.sha2(F.concat("object_id", F.lit("a")), 256).alias("source_hash"))
    after = objects.select("object_id", F.sha2(F.concat("object_id", F.when(number % 7 == 0, "b").otherwise("a")), 256).alias("source_hash"))
    first = Dataset(spark, path).update(before, lambda todo: cells.join(todo, "object_id", "left_semi"), R, LEAST)
    less = cells.where((number % 7 != 0) | (F.col("bk") < 2))  # words of four cells a side, so those of k < 8
    second = first.update(after, lambda todo: less.join(todo, "object_id", "left_semi"), R, LEAST)

    for run in second.runs():  # of all runs, the contents whose hash begins with 3
        held = spark.read.schema(KINDS["blocks"]).parquet(f"{path}/runs/{run}/blocks")
        sinks.write_table(materialize(held.where(F.substring("hash", 1, 1) != "3"), "held"), f"{path}/runs/{run}/blocks", "level")
    third = second.update(after, lambda todo: less.join(todo, "object_id", "left_semi"), R, LEAST)
    sizes = sent(materialize(third.blocks().where("level = 1").select("level", "hash", F.size("occ").alias("n")), "sizes"))

    def counted(version, name):
        tree = version.tree().where("level = 1 AND NOT is_empty").select("object_id", "level", "hash")
        return tree.join(sizes, ["level", "hash"]).groupBy("object_id").agg(F.sum("n").alias(name))

    rows = third.manifest().select("object_id", "made_in")
    rows = rows.join(counted(third, "n_cells"), "object_id", "left").join(counted(Dataset(spark, path, 1), "n_before"), "object_id", "left")
    return rows.select("object_id", "made_in", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), "n_before")


# containment and sketches


def asked_boxes(spark, d):
    """A box for every object, that follows from its part."""
    p = table(spark, d, "part").select(F.format_string("%04d", "p_partkey").alias("object_id"), "p_partkey", "p_size")
    low = {"x": F.col("p_partkey") % 5, "y": F.col("p_size") % 4, "z": F.col("p_partkey") % 9}
    ends = [low[a].cast("int").alias(f"lo_{a}") for a in "xyz"] + [(low[a] + 4 + F.col("p_size") % m).cast("int").alias(f"hi_{a}") for a, m in zip("xyz", (9, 8, 5))]
    return p.select(F.col("object_id").alias("box_id"), "object_id", *ends)


@query
def blocks_in_boxes(spark, d):
    found = morton.contained_blocks(q.tree(spark, d), asked_boxes(spark, d), R, LEAST)
    return found.select("box_id", "object_id", "level", *[f"global_position_{a}" for a in "xyz"], "hash")


@query
def block_descendants(spark, d):
    """Blocks of any depth below the fullest octant of each object."""
    tree = materialize(q.tree(spark, d), "tree")
    found = morton.descendants(tree, tree.where("level = 1 AND octant_index = 0"), R, LEAST)
    return found.select("box_id", "object_id", "level", "octant_index", *[f"global_position_{a}" for a in "xyz"], "is_empty")


@query
def sketched_levels(spark, d):
    """Levels by sketches of objects, of two halves united and of all at once, beside the exact numbers of unique contents."""
    tree = materialize(q.tree(spark, d), "tree")
    of = materialize(sketches.object_sketches(tree), "sketches")
    half = F.col("object_id").cast("int") % 2 == 0
    two = sketches.estimates(sketches.merged(sketches.level_sketches(of.where(half)), of.where(~half)))
    whole = sketches.estimates(sketches.level_sketches(of)).select("level", F.col("unique").alias("at_once"))
    exact = tree.groupBy("level").agg(F.countDistinct("hash").alias("exact"))
    both = two.join(whole, "level").join(exact, "level")
    # estimates of unions may differ by rounding, as sketches of few contents are kept as lists
    agree = F.abs(F.col("unique") - F.col("at_once")) <= F.greatest(F.lit(1), F.col("margin") / 10)
    return both.select("level", "total", "exact", (F.abs(F.col("unique") - F.col("exact")) <= F.col("margin")).alias("within_margin"), agree.alias("union_agrees"))


# pictures


@query
def cube_nets(spark, d):
    net = layout.cube_net(transfer.view_radiance(src.matrix(spark, d), N_SH, PER_FACE), 2, "radiance")
    return net.select("structure", "row", *[F.round(F.get("columns", F.lit(n)), 6).alias(f"c{n}") for n in range(8)])


@query
def octant_badges(spark, d):
    tree = materialize(q.tree(spark, d), "tree")
    contents = materialize(splits.contents(splits.hash_usage(tree, splits.assign_splits(src.objects(spark, d)))), "contents")
    return layout.octant_badges(tree, contents).select("object_id", "level", *[f"global_position_{a}" for a in "xyz"], "badge")
