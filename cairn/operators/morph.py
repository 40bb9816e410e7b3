"""Optimal transport between point clouds and the morphs along its plans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distances(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Euclidean distances of all source and target points that share ``key``."""
    s = source.select(key, F.col("id").alias("src"), *[F.col(a).alias(f"s{a}") for a in "xyz"])
    t = target.select(key, F.col("id").alias("dst"), *[F.col(a).alias(f"t{a}") for a in "xyz"])
    d = [F.col(f"s{a}") - F.col(f"t{a}") for a in "xyz"]
    return s.join(t, key).withColumn("distance", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def sinkhorn(pairs: DataFrame, key: str, reg: float = 0.1, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Entropic transport plans with uniform weights, ``key, src, dst, weight, distance``, one dense problem a task.

    Computed with logarithms. Where it doesn't converge it is tried again with
    ``5 * reg`` and twice the rounds; a plan that is still not finite becomes
    the product of the weights. Exact transport (a linear program) isn't offered.
    """

    def solve(cost, eps, n_rounds, tol):
        n, m = cost.shape
        k = -cost / eps
        f, g = np.zeros(n), np.zeros(m)
        soft = lambda x, axis: (top := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))
        for _ in range(n_rounds):
            f = -math.log(n) - soft(k + g[None, :], 1)
            g = -math.log(m) - soft(k + f[:, None], 0)
            plan = np.exp(k + f[:, None] + g[None, :])
            if np.abs(plan.sum(axis=1) - 1 / n).sum() < tol:
                return plan, True
        return plan, False

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cost = pdf.pivot(index="src", columns="dst", values="distance")
        plan, done = solve(cost.to_numpy(), reg, rounds, tolerance)
        if not done:
            plan, _ = solve(cost.to_numpy(), 5 * reg, 2 * rounds, 10 * tolerance)
        if not np.isfinite(plan).all():
            plan = np.full(cost.shape, 1 / cost.size)
        out = pd.DataFrame(plan, index=cost.index, columns=cost.columns).stack().rename("weight").reset_index()
        out = out.merge(pdf[["src", "dst", "distance"]], on=["src", "dst"])
        return out.assign(key=str(pdf[key].iloc[0]))[["key", "src", "dst", "weight", "distance"]]

    return pairs.select(key, "src", "dst", "distance").groupBy(key).applyInPandas(run, "key string, src long, dst long, weight double, distance double")


def transport_cost(plan: DataFrame, *by: str) -> DataFrame:
    """Cost of every plan and its share of entries above 1e-6."""
    return plan.groupBy(*by).agg(F.sum(F.col("weight") * F.col("distance")).alias("cost"), F.avg((F.col("weight") > 1e-6).cast("double")).alias("density"))


def interpolate(plan: DataFrame, t: float, *by: str) -> DataFrame:
    """Source points moved by ``t`` towards the weighted mean of their targets (``sx..``, ``tx..``, ``weight``)."""
    total = F.greatest(F.sum("weight"), F.lit(1e-10))
    mean = {a: F.sum(F.col("weight") * F.col(f"t{a}")) / total for a in "xyz"}
    return plan.groupBy(*by, "src").agg(*[((1 - t) * F.first(f"s{a}") + t * mean[a]).alias(a) for a in "xyz"])


def split_interpolate(plan: DataFrame, t: float, *by: str, least: float = 0.1) -> DataFrame:
    """Source points split towards every target with over ``least`` of their weight; those without one stay."""
    total = F.sum("weight").over(Window.partitionBy(*by, "src")) + 1e-10
    part = plan.withColumn("_share", F.col("weight") / total).withColumn("_top", F.max("_share").over(Window.partitionBy(*by, "src")))
    part = part.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "src").orderBy(F.desc("_share"), "dst")))
    moves = part.where((F.col("_share") > least) | ((F.col("_top") <= least) & (F.col("_n") == 1)))
    at = lambda a: F.when(F.col("_share") > least, (1 - t) * F.col(f"s{a}") + t * F.col(f"t{a}")).otherwise(F.col(f"s{a}"))
    return moves.select(*by, "src", F.when(F.col("_share") > least, F.col("dst")).alias("dst"), *[at(a).alias(a) for a in "xyz"])


def splat_rays(plan: DataFrame, steps: int, *by: str) -> DataFrame:
    """Weights of a plan summed in the cells that its straight paths reach at the inner steps of ``steps``."""
    inner = plan.where("weight <> 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps - 2))))
    tau = F.col("step") / float(steps - 1)
    cells = [(F.col(f"s{a}") + (F.col(f"t{a}") - F.col(f"s{a}")) * tau).cast("int").alias(c) for a, c in zip("xyz", "ijk", strict=True)]
    return inner.select(*by, (F.col("step") - 1).alias("step"), *cells, "weight").groupBy(*by, "step", "i", "j", "k").agg(F.sum("weight").alias("value"))


def splat_gaussian(points: DataFrame, key: str, resolution: int, sigma: float, least: float = 0.5) -> DataFrame:
    """Cells whose Gaussian-splatted weight exceeds ``least`` of the grid's largest.

    Each point spreads over the cells within ``ceil(3 sigma)`` of its rounded
    (half to even), clipped cell, by distance from the point itself; with
    ``sigma`` 0 it fills that cell.
    """
    cell = lambda a: F.greatest(F.lit(0), F.least(F.lit(resolution - 1), F.bround(F.col(a), 0).cast("int")))
    p = points.withColumns({c: cell(a) for c, a in zip("ijk", "xyz", strict=True)})
    if sigma <= 0:
        return p.select(key, "i", "j", "k").distinct()
    r = math.ceil(3 * sigma)
    for c in "ijk":
        p = p.withColumn(f"d{c}", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn(f"n{c}", F.col(c) + F.col(f"d{c}")).where(F.col(f"n{c}").between(0, resolution - 1))
    gap = [F.col(a) - F.col(f"n{c}") for c, a in zip("ijk", "xyz", strict=True)]
    weight = F.exp(-(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) / (2 * sigma * sigma))
    total = p.groupBy(key, "ni", "nj", "nk").agg(F.sum(weight).alias("w"))
    top = total.groupBy(key).agg(F.max("w").alias("top"))
    return total.join(top, key).where(F.col("w") / F.col("top") > least).select(key, *[F.col(f"n{c}").alias(c) for c in "ijk"])


def morph_statistics(steps: DataFrame, resolution: int, *by: str) -> DataFrame:
    """Cells, occupancy and change since the step before, per step."""
    s = steps.groupBy(*by, "step").agg(F.count("*").alias("num_voxels"))
    w = Window.partitionBy(*by).orderBy("step")
    return s.withColumn("occupancy", F.col("num_voxels") / float(resolution**3)).withColumn("delta", F.col("num_voxels") - F.lag("num_voxels").over(w))
