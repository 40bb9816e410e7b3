"""Spherical harmonics: evaluation, projection, reconstruction and sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import sh_basis, uniform


def with_basis(df: DataFrame, order: int = 2) -> DataFrame:
    """``df(x, y, z)`` with ``basis``, the values of all harmonics."""
    return df.withColumn("basis", F.array(*sh_basis(F.col("x"), F.col("y"), F.col("z"), order)))


def project(samples: DataFrame, *by: str, order: int = 2, value: str = "value") -> DataFrame:
    """Monte-Carlo coefficients ``4 pi / N * sum(value * Y)``, one row for each group and harmonic."""
    basis = sh_basis(F.col("x"), F.col("y"), F.col("z"), order)
    sums = samples.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.col(value) * y).alias(f"c{i}") for i, y in enumerate(basis)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.col(f"c{i}").alias("c")) for i in range(len(basis))]))
    return sums.select(*by, "n", rows.alias("r")).select(*by, F.col("r.idx").alias("sh_idx"), (F.col("r.c") * (4 * math.pi) / F.col("n")).alias("coefficient"))


def reconstruct(directions: DataFrame, coefficients: DataFrame, *by: str, order: int = 2) -> DataFrame:
    """The expansion of ``coefficients(*by, sh_idx, coefficient)`` at every direction."""
    packed = coefficients.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("sh_idx", "coefficient"))), lambda s: s["coefficient"]).alias("coeffs"))
    dot = F.aggregate(F.zip_with("basis", "coeffs", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    at = with_basis(directions, order)
    both = at.join(packed, list(by)) if by else at.crossJoin(F.broadcast(packed))  # without groups, one row
    return both.withColumn("value", dot).drop("basis", "coeffs")


def inner_products(directions: DataFrame, order: int = 2) -> DataFrame:
    """Monte-Carlo inner products of all pairs of harmonics: near the identity for uniform directions."""
    basis = sh_basis(F.col("x"), F.col("y"), F.col("z"), order)
    n = len(basis)
    sums = directions.agg(F.count("*").alias("n"), *[F.sum(basis[a] * basis[b]).alias(f"p{a}_{b}") for a in range(n) for b in range(n)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{a}_{b}").alias("p")) for a in range(n) for b in range(n)]))
    return sums.select("n", rows.alias("r")).select("r.a", "r.b", (F.col("r.p") * (4 * math.pi) / F.col("n")).alias("product"))


def triple_product(source, i: int, j: int, k: int, samples: int = 10_000, seed: str = "42") -> DataFrame:
    """Monte-Carlo integral of three harmonics of order 2 over the sphere; 0 for an index of 9 or more.

    With a session, over ``samples`` hashed directions, else over those of a table, ``x, y, z``.
    """
    d = source if isinstance(source, DataFrame) else sphere_directions(source.range(samples), "id", seed)
    if max(i, j, k) >= 9:
        return d.agg(F.lit(0.0).alias("integral"))
    y = sh_basis(F.col("x"), F.col("y"), F.col("z"), 2)
    return d.agg((F.avg(y[i] * y[j] * y[k]) * (4 * math.pi)).alias("integral"))


def sphere_directions(df: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """Uniform unit vectors for every ``key``."""
    out = df.withColumns({"_u": uniform(f"{seed}u", F.col(key)), "_v": uniform(f"{seed}v", F.col(key))})
    z, phi = 1 - 2 * F.col("_u"), F.col("_v") * (2 * math.pi)
    side = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return out.withColumns({"x": side * F.cos(phi), "y": side * F.sin(phi), "z": z}).drop("_u", "_v")


def cosine_hemisphere(u: Column, v: Column) -> list[Column]:
    phi = u * (2 * math.pi)
    return [F.sqrt(1 - v) * F.cos(phi), F.sqrt(1 - v) * F.sin(phi), F.sqrt(v)]


def henyey_greenstein(g: Column, u: Column, v: Column) -> list[Column]:
    """Scattered directions about +z for asymmetry ``g``; below 1e-4 they are isotropic."""
    s = (1 - g * g) / (1 - g + 2 * g * u)
    cos = F.when(F.abs(g) < 1e-4, 1 - 2 * u).otherwise((1 + g * g - s * s) / (2 * g))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))
    sin = F.sqrt(F.greatest(F.lit(0.0), 1 - cos * cos))
    phi = v * (2 * math.pi)
    return [sin * F.cos(phi), sin * F.sin(phi), cos]


def to_world(local: list[Column], normal: list[Column]) -> list[Column]:
    """Local directions in the frame of ``normal``; the tangent is up x normal, up being y unless the normal is close to it."""
    nx, ny, nz = normal
    steep = F.abs(ny) >= 0.999
    tx, ty, tz = F.when(steep, 0.0).otherwise(nz), F.when(steep, -nz).otherwise(0.0), F.when(steep, ny).otherwise(-nx)
    size = F.sqrt(tx * tx + ty * ty + tz * tz)
    t = [F.when(size > 1e-8, c / size).otherwise(c) for c in (tx, ty, tz)]
    b = [ny * t[2] - nz * t[1], nz * t[0] - nx * t[2], nx * t[1] - ny * t[0]]
    return [local[0] * t[n] + local[1] * b[n] + local[2] * normal[n] for n in range(3)]
