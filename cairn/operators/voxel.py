"""Voxel grids as sparse relations: one row for each occupied cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.columns import number, template


def voxel_pitch(points: DataFrame, resolution: int) -> DataFrame:
    """``object_id``, the bounding box, its extents and ``pitch``: the largest extent over ``resolution``."""
    ends = [f("%s" % a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    box = points.groupBy("object_id").agg(*ends)
    for a in "xyz":
        box = box.withColumn(f"extent_{a}", F.col(f"max_{a}") - F.col(f"min_{a}"))
    return box.withColumn("pitch", F.greatest("extent_x", "extent_y", "extent_z") / F.lit(float(resolution)))


def voxelize(points: DataFrame, resolution: int) -> DataFrame:
    """Cells of ``resolution`` a side that hold a point, ``object_id, i, j, k``.

    The pitch is the object's own; points on the far border belong to the last
    cell, and an object of one point has the cell 0, 0, 0.
    """
    box = voxel_pitch(points, resolution).select("object_id", "pitch", *(f"min_{a}" for a in "xyz"))
    at = lambda a: F.least(F.lit(resolution - 1), F.when(F.col("pitch") > 0, F.floor((F.col(a) - F.col(f"min_{a}")) / F.col("pitch"))).otherwise(0)).cast("int")
    return points.join(box, "object_id").select("object_id", at("x").alias("i"), at("y").alias("j"), at("z").alias("k")).distinct()


def occupancy(cells: DataFrame, objects: DataFrame, resolution: int) -> DataFrame:
    """Occupied cells and their share for every object, those without cells included."""
    counts = cells.groupBy("object_id").agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return objects.join(counts, "object_id", "left").select("object_id", n.alias("num_occupied"), (n / float(resolution**3)).alias("occupancy_ratio"))


def pad_crop(cells: DataFrame, sizes: DataFrame, resolution: int) -> DataFrame:
    """Centre grids of ``sizes(object_id, ni, nj, nk)`` in a cube, cropping or padding each axis.

    A longer axis loses ``(n - R) // 2`` cells at its start, a shorter one
    gains ``(R - n) // 2``.
    """
    out = cells.join(sizes, "object_id")
    for a in "ijk":
        n = F.col(f"n{a}")
        shift = F.when(n > resolution, -F.expr(f"(n{a} - {resolution}) div 2")).otherwise(F.expr(f"({resolution} - n{a}) div 2"))
        out = out.withColumn(a, (F.col(a) + shift).cast("int")).where(F.col(a).between(0, resolution - 1))
    return out.select("object_id", "i", "j", "k")


def upsample(cells: DataFrame, factor: int = 2) -> DataFrame:
    """Every cell becomes ``factor`` cells along each axis."""
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    out = cells
    for a in "ijk":
        out = out.withColumn(f"d{a}", F.explode(step))
    return out.select("object_id", *[(F.col(a) * factor + F.col(f"d{a}")).alias(a) for a in "ijk"])


def grid_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells in one of two grids only, per object, also in percent of the right one's."""
    marked = left.select("object_id", "i", "j", "k", F.lit(1).alias("side")).union(right.select("object_id", "i", "j", "k", F.lit(2).alias("side")))
    cell = marked.groupBy("object_id", "i", "j", "k").agg(F.bit_or("side").alias("sides"))
    out = cell.groupBy("object_id").agg(F.count_if(F.col("sides") != 3).alias("n_xor"), F.count_if(F.col("sides").bitwiseAND(F.lit(2)) != 0).alias("n_right"))
    return out.withColumn("percent", F.when(F.col("n_right") > 0, 100.0 * F.col("n_xor") / F.col("n_right")))


def binarize(values: DataFrame, floating: bool = True) -> DataFrame:
    """Cells whose ``value`` exceeds one half, or zero for integral grids."""
    return values.where(F.col("value") > (0.5 if floating else 0)).select("object_id", "i", "j", "k")


def silhouette(cells: DataFrame, axis: str) -> DataFrame:
    """The projection of every object along ``axis``."""
    return cells.select("object_id", *[a for a in "ijk" if a != axis]).distinct()


def grid_slice(cells: DataFrame, axis: str, at: int) -> DataFrame:
    return cells.where(F.col(axis) == at)


def point_cloud(cells: DataFrame) -> DataFrame:
    """Cell centres as points ``x, y, z`` with uniform weights that sum to 1 per object."""
    weight = 1.0 / F.count("*").over(Window.partitionBy("object_id"))
    return cells.select("object_id", *[F.col(c).cast("double").alias(a) for c, a in zip("ijk", "xyz", strict=True)], weight.alias("weight"))


def sphere(source, resolution: int, radius=None) -> DataFrame:
    """The analytic ball around the grid's centre, a quarter of the grid in radius by default: one for a session, or one for every object of a table."""
    c, r = resolution / 2, number(resolution / 4 if radius is None else radius)
    axis = F.sequence(F.lit(0), F.lit(resolution - 1))
    rows, names = template(source)
    grid = rows if names else rows.select(F.lit("sphere").alias("object_id"))
    grid = grid.withColumn("_r", r).withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis)).withColumn("k", F.explode(axis))
    return grid.where((F.col("i") - c) ** 2 + (F.col("j") - c) ** 2 + (F.col("k") - c) ** 2 <= F.col("_r") * F.col("_r")).select("object_id", "i", "j", "k")


def _spread(free: int, seen: int, size: int) -> int:
    """The bits of ``free`` that steps along one axis or another join to those of ``seen``, in a cube of ``size`` bits a side."""
    while True:
        before = seen
        for step in (1, size, size * size):
            for up in (True, False):
                open_, by = free, step
                while by < size * step:  # bits move 1, 2, 4 ... places through open cells, so a whole row takes few steps
                    seen |= open_ & (seen << by if up else seen >> by)
                    open_ &= open_ << by if up else open_ >> by
                    by *= 2
        if seen == before:
            return seen


def fill_interior(cells: DataFrame, resolution: int) -> DataFrame:
    """Add the cells that no path of face neighbours joins to the grid's outside.

    One grid at a time, as bits of one integer; memory is that of one dense grid.
    """
    size = resolution + 2  # an empty border joins all of the outside, also where bits leave one row for the next

    def run(rows: pa.Table) -> pa.Table:
        i, j, k = (rows[a].to_numpy() + 1 for a in "ijk")
        solid = np.zeros(size**3, bool)
        solid[(i * size + j) * size + k] = True
        every = (1 << size**3) - 1
        free = every ^ int.from_bytes(np.packbits(solid, bitorder="little").tobytes(), "little")
        kept = every ^ _spread(free, 1, size)
        bits = np.unpackbits(np.frombuffer(kept.to_bytes(-(-(size**3) // 8), "little"), np.uint8), bitorder="little")
        at = np.flatnonzero(bits)
        found = [pa.array((at // d % size - 1).astype(np.int32)) for d in (size * size, size, 1)]
        return pa.Table.from_arrays([pa.repeat(rows["object_id"][0], len(at)), *found], names=["object_id", "i", "j", "k"])

    return cells.select("object_id", "i", "j", "k").groupBy("object_id").applyInArrow(run, "object_id string, i int, j int, k int")
