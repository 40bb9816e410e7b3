"""Augmentations of grids and rays; random ones draw from hashes and repeat exactly."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.columns import hash_bits, rarely, uniform


def quarter_turns(objects: DataFrame, p: float = 0.5, seed: str = "rot") -> DataFrame:
    """``object_id, turns``: 1 to 3 quarter turns with probability ``p``, else 0."""
    turns = (hash_bits(f"{seed}k", F.col("object_id")) % 3 + 1).cast("int")
    return objects.select("object_id", F.when(uniform(seed, F.col("object_id")) <= p, turns).otherwise(0).alias("turns"))


def rotate_cells(cells: DataFrame, turns: DataFrame, resolution: int) -> DataFrame:
    """Turn grids in their (j, k) plane, first axis towards the second."""
    m, t = resolution - 1, F.col("turns")
    j = F.when(t == 1, m - F.col("k")).when(t == 2, m - F.col("j")).when(t == 3, F.col("k")).otherwise(F.col("j"))
    k = F.when(t == 1, F.col("j")).when(t == 2, m - F.col("k")).when(t == 3, m - F.col("j")).otherwise(F.col("k"))
    return cells.join(turns, "object_id").select("object_id", "i", j.alias("j"), k.alias("k"))


def rotate_rays(rays: DataFrame, turns: DataFrame) -> DataFrame:
    """Turn origins and directions about z by the same quarter turns."""
    cos = F.when(F.col("turns") == 0, 1.0).when(F.col("turns") == 2, -1.0).otherwise(0.0)
    sin = F.when(F.col("turns") == 1, 1.0).when(F.col("turns") == 3, -1.0).otherwise(0.0)
    out = rays.join(turns, "object_id")
    turned = {}
    for p in "od":
        x, y = F.col(f"{p}x"), F.col(f"{p}y")
        turned |= {f"{p}x": cos * x - sin * y, f"{p}y": sin * x + cos * y}
    return out.withColumns(turned)


def flips(objects: DataFrame, p: float = 0.5, seed: str = "flip") -> DataFrame:
    """``object_id, flip_i, flip_j, flip_k``: which axes to mirror."""
    return objects.select("object_id", *[(uniform(f"{seed}{a}", F.col("object_id")) < p).alias(f"flip_{a}") for a in "ijk"])


def flip_cells(cells: DataFrame, flip: DataFrame, resolution: int) -> DataFrame:
    return cells.join(flip, "object_id").select("object_id", *[F.when(F.col(f"flip_{a}"), resolution - 1 - F.col(a)).otherwise(F.col(a)).alias(a) for a in "ijk"])


def flip_rays(rays: DataFrame, flip: DataFrame) -> DataFrame:
    out = rays.join(flip, "object_id")
    return out.withColumns({f"{p}{x}": F.when(F.col(f"flip_{a}"), -F.col(f"{p}{x}")).otherwise(F.col(f"{p}{x}")) for p in "od" for a, x in zip("ijk", "zyx", strict=True)})


def normalize_origins(rays: DataFrame, resolution: int, voxel_size: float = 1.0) -> DataFrame:
    half = resolution * voxel_size / 2
    return rays.withColumns({f"o{a}": F.col(f"o{a}") / half for a in "xyz"})


def subsample(rays: DataFrame, key: str, row: str, k: int, seed: str = "sub") -> DataFrame:
    """At most ``k`` rays of every ``key``, drawn by hash."""
    order = Window.partitionBy(key).orderBy(hash_bits(seed, F.col(row)), F.col(row))
    return rays.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def add_noise(rays: DataFrame, origin: float = 0.01, direction: float = 0.01, seed: int = 42, key: str = "ray_id") -> DataFrame:
    """Gaussian noise on origins and directions, which stay unit vectors; it follows from seed and ``key`` alone, so a task run again adds the same."""
    gauss = lambda s: F.sqrt(-2.0 * F.ln(1.0 - uniform(f"{seed}{s}r", F.col(key)))) * F.cos(2 * math.pi * uniform(f"{seed}{s}a", F.col(key)))
    out = rays.withColumns({f"{p}{a}": F.col(f"{p}{a}") + size * gauss(f"{p}{a}") for p, size in (("o", origin), ("d", direction)) for a in "xyz"})
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return out.withColumn("_n", size).withColumns({f"d{a}": F.col(f"d{a}") / F.col("_n") for a in "xyz"}).drop("_n")


def jitter(cells: DataFrame, objects: DataFrame, resolution: int, p: float, seed: str = "jit") -> DataFrame:
    """Flip every cell of the grid, occupied or not, with probability ``p``."""
    axis = F.sequence(F.lit(0), F.lit(resolution - 1))
    grid = objects.select("object_id")
    for a in "ijk":
        grid = grid.withColumn(a, F.explode(axis))
    turned = grid.where(rarely(p, seed, *[F.col(c) for c in ("object_id", "i", "j", "k")])).withColumn("n", F.lit(1))
    both = cells.select("object_id", "i", "j", "k", F.lit(1).alias("n")).union(turned)
    return both.groupBy("object_id", "i", "j", "k").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def compose(*steps):
    """One transform that applies ``steps``, each from DataFrame to DataFrame, in order; none changes nothing."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
