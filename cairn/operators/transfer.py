"""Analytics of light transport matrices in long form: ``structure, out_idx, in_idx, value``; absent entries are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators.spectrum import leading_eigenvalues

def _size():
    return F.abs(F.col("value"))


def statistics(t: DataFrame, n: int) -> DataFrame:
    """Minimum, maximum, mean, population deviation and share of non-zeros of every n x n matrix."""
    cells = float(n) * n
    s = t.groupBy("structure").agg(
        F.count("*").alias("stored"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.count_if(F.col("value") != 0).alias("nnz")
    )
    whole = F.col("stored") == cells
    mean = F.col("s") / cells
    return s.select(
        "structure", F.when(whole, F.col("lo")).otherwise(F.least("lo", F.lit(0.0))).alias("min"), F.when(whole, F.col("hi")).otherwise(F.greatest("hi", F.lit(0.0))).alias("max"),
        mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / cells - mean * mean)).alias("std"), (F.col("nnz") / cells).alias("nnz_ratio"),
    )


def column_sums(t: DataFrame) -> DataFrame:
    """Sums of absolute values per incident condition."""
    return t.groupBy("structure", "in_idx").agg(F.sum(_size()).alias("column_sum"))


def column_sum_statistics(t: DataFrame, n: int) -> DataFrame:
    c = column_sums(t).groupBy("structure").agg(F.count("*").alias("k"), F.min("column_sum").alias("lo"), F.max("column_sum").alias("max"), F.sum("column_sum").alias("s"))
    return c.select("structure", F.when(F.col("k") < n, 0.0).otherwise(F.col("lo")).alias("min"), "max", (F.col("s") / n).alias("mean"))


def row_sums(t: DataFrame) -> DataFrame:
    return t.groupBy("structure", "out_idx").agg(F.sum(_size()).alias("row_sum"))


def symmetry_error(t: DataFrame) -> DataFrame:
    """Largest difference between a matrix and its transpose, by one aggregation over unordered index pairs."""
    sign = F.when(F.col("out_idx") < F.col("in_idx"), F.col("value")).when(F.col("out_idx") > F.col("in_idx"), -F.col("value")).otherwise(0.0)
    pairs = t.groupBy("structure", F.least("out_idx", "in_idx").alias("a"), F.greatest("out_idx", "in_idx").alias("b")).agg(F.sum(sign).alias("gap"))
    return pairs.groupBy("structure").agg(F.max(F.abs("gap")).alias("symmetry_error"))


def sparsity(t: DataFrame, n: int, share: float = 1e-6) -> DataFrame:
    """Share of entries above ``share`` of the largest."""
    top = t.groupBy("structure").agg((F.max(_size()) * share).alias("least"))
    return t.join(top, "structure").groupBy("structure").agg((F.count_if(_size() > F.col("least")) / (float(n) * n)).alias("density"))


def face_energy(t: DataFrame, per_face: int) -> DataFrame:
    """Absolute energy sent out for light on each face; ``per_face`` conditions make a face."""
    return t.groupBy("structure", F.expr(f"int(in_idx div {per_face})").alias("in_face")).agg(F.sum(_size()).alias("energy"))


def face_transport(t: DataFrame, per_face: int) -> DataFrame:
    """Energy from face to face, raw and as a share of what comes from the incident face."""
    f = t.groupBy("structure", F.expr(f"int(out_idx div {per_face})").alias("out_face"), F.expr(f"int(in_idx div {per_face})").alias("in_face")).agg(F.sum(_size()).alias("energy"))
    total = F.sum("energy").over(Window.partitionBy("structure", "in_face"))
    return f.withColumn("share", F.when(total > 0, F.col("energy") / total).otherwise(0.0))


def sh_coupling(t: DataFrame, n_sh: int) -> DataFrame:
    """Absolute energy between harmonics."""
    return t.groupBy("structure", (F.col("out_idx") % n_sh).alias("out_sh"), (F.col("in_idx") % n_sh).alias("in_sh")).agg(F.sum(_size()).alias("energy"))


def star_pairs(names: DataFrame) -> DataFrame:
    """``a, b``: the first structure by name with each of the others."""
    first = names.agg(F.min("structure").alias("a"))  # one row
    return names.select(F.col("structure").alias("b")).distinct().join(F.broadcast(first), F.col("b") > F.col("a")).select("a", "b")


def differences(t: DataFrame, n: int, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs of structures: largest and mean absolute, Frobenius and relative difference, and correlation.

    ``pairs(a, b)`` says which; without it every pair is taken, which is for
    few structures: entries are copied once for every pair that they are in.
    """
    cells = float(n) * n
    if pairs is None:
        names = t.select("structure").distinct()
        pairs = names.withColumnRenamed("structure", "a").join(names.withColumnRenamed("structure", "b"), F.col("a") < F.col("b"))
    one = t.join(pairs, F.col("structure") == F.col("a")).select("a", "b", "out_idx", "in_idx", F.col("value").alias("x"), F.lit(0.0).alias("y"))
    two = t.join(pairs, F.col("structure") == F.col("b")).select("a", "b", "out_idx", "in_idx", F.lit(0.0).alias("x"), F.col("value").alias("y"))
    cell = one.union(two).groupBy("a", "b", "out_idx", "in_idx").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    x, y = F.col("x"), F.col("y")
    s = cell.groupBy("a", "b").agg(
        F.max(F.abs(x - y)).alias("top"), F.sum(F.abs(x - y)).alias("sum_abs"), F.sum((x - y) * (x - y)).alias("ss"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    spread = (cells * F.col("sxx") - F.col("sx") * F.col("sx")) * (cells * F.col("syy") - F.col("sy") * F.col("sy"))
    return s.select(
        "a", "b", F.col("top").alias("max_abs"), (F.col("sum_abs") / cells).alias("mean_abs"), F.sqrt("ss").alias("frobenius"),
        F.when(F.col("sxx") > 0, F.sqrt(F.col("ss") / F.col("sxx"))).alias("relative"),
        F.when(spread > 0, (cells * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).alias("correlation"),
    )


def view_radiance(t: DataFrame, n_sh: int, per_face: int, illuminated: int | None = None) -> DataFrame:
    """DC to DC radiance of every patch for light on the patches of one face, or of all."""
    dc = t.where((F.col("out_idx") % n_sh == 0) & (F.col("in_idx") % n_sh == 0))
    dc = dc if illuminated is None else dc.where(F.expr(f"in_idx div {per_face}") == illuminated)
    return dc.groupBy("structure", F.expr(f"int(out_idx div {n_sh})").alias("patch_id")).agg(F.sum("value").alias("radiance"))


def mean_radiance(t: DataFrame, n_sh: int, patches: int, illuminated_patches: int) -> DataFrame:
    """DC output of every patch over all harmonics of the first ``illuminated_patches``, as a mean over those patches."""
    lit = t.where((F.col("out_idx") % n_sh == 0) & (F.expr(f"in_idx div {n_sh}") < illuminated_patches))
    return lit.groupBy("structure", F.expr(f"int(out_idx div {n_sh})").alias("patch_id")).agg((F.sum("value") / illuminated_patches).alias("radiance"))


def boundary_radiance(t: DataFrame, incident: DataFrame, n_sh: int) -> DataFrame:
    """Matrix times ``incident(in_idx, amount)``, then the length of every patch's coefficients."""
    product = t.join(incident, "in_idx").groupBy("structure", "out_idx").agg(F.sum(F.col("value") * F.col("amount")).alias("p"))
    return product.groupBy("structure", F.expr(f"int(out_idx div {n_sh})").alias("patch_id")).agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("radiance"))


def exit_energy(t: DataFrame, n_sh: int) -> DataFrame:
    """Squared coefficients of every incident condition and exit patch."""
    return t.groupBy("structure", "in_idx", F.expr(f"int(out_idx div {n_sh})").alias("exit_patch")).agg(F.sum(F.col("value") * F.col("value")).alias("sh_energy"))


def error_summary(e: DataFrame, n_total: int, least: int = 10) -> DataFrame:
    """Truncation errors of pairs with ``least`` or more samples: mean, quantiles, extremes.

    ``e(structure, weight_sq_sum, sample_count, sh_energy)``; the captured
    fraction is ``sh_energy * n_total² / count`` over the mean squared weight,
    cut to [0, 1]. Pairs without signal don't count.
    """
    original = F.col("weight_sq_sum") / F.col("sample_count")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sh_energy") * float(n_total) ** 2 / F.col("sample_count") / original))
    good = (F.col("sample_count") >= least) & (original > 1e-10)
    x = e.where("sample_count > 0").withColumn("error", F.when(good, 1 - part))
    q = lambda p: F.percentile("error", F.lit(p))
    return x.groupBy("structure").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("sample_count") >= least).alias("well_sampled"), F.min("sample_count").alias("min_count"), F.percentile("sample_count", F.lit(0.5)).alias("median_count"),
        F.max("sample_count").alias("max_count"), F.avg("error").alias("mean_error"), q(0.5).alias("median_error"), q(0.9).alias("p90"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("error").alias("max_error"),
    )


def worst_pairs(e: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    return e.orderBy(F.desc("error"), *key).limit(k)


def histogram(t: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts of log10 of absolute non-zero values in equal bins from ``low`` to ``high``, 0 and bins + 1 beyond them."""
    b = F.width_bucket(F.log10(_size()), F.lit(low), F.lit(high), F.lit(bins))
    diagonal = F.col("out_idx") == F.col("in_idx")
    return t.where(F.col("value") != 0).groupBy("structure", b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if(diagonal).alias("n_diagonal"))


def relative_to_max(df: DataFrame, value: str, *by: str) -> DataFrame:
    top = df.groupBy(*by).agg(F.max(value).alias("_top"))
    return df.join(top, list(by)).withColumn(value, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(0.0)).drop("_top")


def spectral_radius(t: DataFrame, rounds: int = 300, tolerance: float = 1e-9) -> DataFrame:
    """``structure, spectral_radius, residual``: the size of every matrix's leading eigenvalue, for any number of rows; see ``spectrum.leading_eigenvalues``."""
    values, _ = leading_eigenvalues(t, 1, rounds, tolerance)
    size = F.sqrt(F.col("eigenvalue") * F.col("eigenvalue") + F.col("imaginary") * F.col("imaginary"))
    return values.select("structure", size.alias("spectral_radius"), "residual")


def overall_statistics(stats: DataFrame) -> DataFrame:
    """One row over the matrices of ``statistics``: how many, extremes, and means of mean and share of non-zeros."""
    return stats.agg(F.count("*").alias("matrices"), F.min("min").alias("min"), F.max("max").alias("max"), F.avg("mean").alias("mean"), F.avg("nnz_ratio").alias("nnz_ratio"))


def patch_energy(spark, t: DataFrame, n_sh: int, patches: int) -> DataFrame:
    """Energy from every incident to every exitant patch, 0 where the matrix has no entry."""
    own = t.groupBy("structure", F.expr(f"int(in_idx div {n_sh})").alias("in_patch"), F.expr(f"int(out_idx div {n_sh})").alias("out_patch")).agg(F.sum(_size()).alias("energy"))
    axis = F.sequence(F.lit(0), F.lit(patches - 1))
    grid = t.select("structure").distinct().withColumn("in_patch", F.explode(axis)).withColumn("out_patch", F.explode(axis))
    return grid.join(own.hint("merge"), ["structure", "in_patch", "out_patch"], "left").na.fill(0.0, ["energy"])
