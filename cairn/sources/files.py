"""Readers for meshes, grids and rays in files of other tools."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.stages import partitions
from cairn.sources import archives, store
from cairn.sources.stl import read_stl  # noqa: F401  beside the other readers

TRIANGLES = "object_id string, face_id int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


def _object_id(path):
    """The file's name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def mesh(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles from ``vertices(object_id, vid, x, y, z)`` and ``faces(object_id, fid, a, b, c)``."""
    out = faces.select("object_id", F.col("fid").alias("face_id"), *[F.col(v).alias(f"_{v}") for v in "abc"])
    for v in "abc":
        corner = vertices.select("object_id", F.col("vid").alias(f"_{v}"), *[F.col(a).alias(f"{v}{a}") for a in "xyz"])
        out = out.join(corner, ["object_id", f"_{v}"])
    return out.select("object_id", "face_id", *[f"{v}{a}" for v in "abc" for a in "xyz"])


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all grids under ``path`` that can be read; see ``scan_grids``."""
    return scan_grids(spark, path)[0]


def scan_grids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cells of all ``.npz`` and ``.npy`` grids under ``path``, and ``object_id, error`` of the files that hold none.

    Values over zero (one half, for floats) are occupied. An archive's grid is
    the first of ``voxels``, ``occupancy``, ``data`` and ``arr_0`` that it has;
    a leading axis of length 1 is dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("path like '%.npz' or path like '%.npy'")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                try:
                    held = np.load(io.BytesIO(bytes(r.content)))
                    grid = held if isinstance(held, np.ndarray) else held[next(k for k in ("voxels", "occupancy", "data", "arr_0") if k in held.files)]
                    grid = grid[0] if grid.ndim == 4 else grid
                    if grid.ndim != 3:
                        raise ValueError(f"an array of {grid.ndim} axes")
                    at, error = np.argwhere(grid > (0.5 if grid.dtype.kind == "f" else 0)), None
                except Exception as e:  # noqa: BLE001  whatever a broken file raises becomes its row
                    at, error = np.full((1, 3), -1), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"object_id": r.object_id, "i": at[:, 0], "j": at[:, 1], "k": at[:, 2]}).assign(error=error)

    rows = files.select(_object_id("path").alias("object_id"), "content").mapInPandas(run, "object_id string, i int, j int, k int, error string")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("object_id", "error")


def read_mesh_archives(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of all meshes under ``path`` that can be read; see ``scan_mesh_archives``."""
    return scan_mesh_archives(spark, path)[0]


def scan_mesh_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triangles of all ``.npz`` meshes under ``path`` that hold ``vertices`` and ``faces``, and ``object_id, error`` of archives that can't be read.

    Archives without these arrays are no meshes and give nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("path like '%.npz'")
    corners = [f"{v}{a}" for v in "abc" for a in "xyz"]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    held = np.load(io.BytesIO(content.as_py()))
                    if not {"vertices", "faces"} <= {*held.files}:
                        continue
                    flat, error = held["vertices"].astype(float)[held["faces"].astype(int)].reshape(-1, 9), None
                except Exception as e:  # noqa: BLE001  whatever a broken file raises becomes its row
                    flat, error = np.full((1, 9), np.nan), f"{type(e).__name__}: {e}"
                n = len(flat)
                values = [pa.array([name] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(np.ascontiguousarray(flat[:, c])) for c in range(9)), pa.array([error] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(values, names=["object_id", "face_id", *corners, "error"])

    rows = files.select(_object_id("path").alias("object_id"), "content").mapInArrow(run, TRIANGLES + ", error string")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("object_id", "error")


def read_distance_maps(spark: SparkSession, path: str) -> DataFrame:
    """``object_id, view_id, row, col, distance, hit`` of the maps that ``archives.write_distance_maps`` wrote; see ``archives`` for those that can't be read."""
    return archives.read_archives(spark, path, "maps").where("error IS NULL").drop("error")


def read_ray_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rays of ``level_L/xx/HASH_rays.npz`` archives, with level and hash from the path; see ``archives`` for those that can't be read."""
    return archives.read_archives(spark, path, "rays").where("error IS NULL").drop("error")


def discover_objects(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the ``object_*`` folders (or partitions) under ``path``, by the files in them, which aren't read.

    The folders right under ``path`` are listed once, what is in them by tasks.
    """
    tops = spark.createDataFrame([(n,) for n in store.names(path)], "name string").repartition(partitions(spark))
    root = path.rstrip("/")

    def run(batches):
        for batch in batches:
            found = {m[1] for name in batch.column(0).to_pylist() for rest in store.inside(root, name) if (m := re.search(r"[/=]object_([^/]+)/", rest))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["object_id"])

    return tops.mapInArrow(run, "object_id string").distinct()
