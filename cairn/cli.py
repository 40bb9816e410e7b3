"""Command line: ``python -m cairn.cli build|update|splits``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import mesh, metadata, voxel
from cairn.plans.build import build, reassign_splits
from cairn.plans.manifest import Dataset
from cairn.session import session
from cairn.sources import files


def update(spark: SparkSession, source: str, path: str, resolution: int, least: int, kind: str, solid: bool) -> Dataset:
    """The next version of the dataset at ``path``: objects whose file in ``source`` is new or has changed are made, those without a file left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    sources = found.select(name.alias("object_id"), F.sha2("content", 256).alias("source_hash"))

    def cells(todo: DataFrame) -> DataFrame:
        if kind == "stl":
            return mesh.voxelize_mesh(files.read_stl(spark, source)[0].join(todo, "object_id", "left_semi"), resolution, solid)
        grids = files.scan_grids(spark, source)[0].join(todo, "object_id", "left_semi")
        return voxel.fill_interior(grids, resolution) if solid else grids

    return Dataset(spark, path).update(sources, cells, resolution, least)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("command", choices=["build", "update", "splits"])
    p.add_argument("--input", help="folder of STL meshes or npz grids")
    p.add_argument("--output", required=True)
    p.add_argument("--resolution", type=int, default=128)
    p.add_argument("--min-resolution", type=int, default=4)
    p.add_argument("--format", choices=["stl", "npz"], default="stl")
    p.add_argument("--solid", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--split", type=float, nargs=3, default=[0.8, 0.1, 0.1], metavar=("TRAIN", "VAL", "TEST"))
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--start-object", help="the first object, in order of ids")
    p.add_argument("--num-objects", type=int, help="how many objects at most")
    a = p.parse_args(argv)
    spark = session()
    if a.command == "splits":
        reassign_splits(spark, a.output, a.split, a.seed).groupBy("split").count().show()
        return
    if not a.input:
        p.error(f"{a.command} needs --input")
    if a.command == "update":
        done = update(spark, a.input, a.output, a.resolution, a.min_resolution, a.format, a.solid)
        print(f"version {done.version}: {done.manifest().count()} objects")
        return
    if a.format == "stl":
        triangles, errors = files.read_stl(spark, a.input)
        for r in errors.limit(20).collect():
            print(f"{r.object_id}: {r.error}")
        cells = mesh.voxelize_mesh(triangles, a.resolution, a.solid)
        objects = triangles.select("object_id").distinct()
    else:
        cells, errors = files.scan_grids(spark, a.input)
        for r in errors.limit(20).collect():
            print(f"{r.object_id}: {r.error}")
        cells = voxel.fill_interior(cells, a.resolution) if a.solid else cells
        objects = cells.select("object_id").distinct()
    objects = metadata.objects_from(objects, a.start_object, a.num_objects)
    build(spark, cells, objects, a.output, a.resolution, a.min_resolution, a.split, a.seed).show()


if __name__ == "__main__":
    main()
