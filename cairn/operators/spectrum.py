"""Leading eigenvalues of matrices of any size, by joins of the matrix with vectors kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import uniform
from cairn.plans.stages import materialize, release, written


def multiply(t: DataFrame, x: DataFrame) -> DataFrame:
    """``structure, idx, x``: each matrix times its vector."""
    x = x.select(F.col("structure").alias("_s"), "idx", "x")
    product = t.join(x.hint("merge"), (F.col("structure") == F.col("_s")) & (F.col("in_idx") == F.col("idx")))
    return product.groupBy("structure", F.col("out_idx").alias("idx")).agg(F.sum(F.col("value") * F.col("x")).alias("x"))


def _transposed(t: DataFrame) -> DataFrame:
    return t.select("structure", F.col("in_idx").alias("out_idx"), F.col("out_idx").alias("in_idx"), "value")


def _deflated(y: DataFrame, x: DataFrame, found: DataFrame | None) -> DataFrame:
    """``y`` without what the matrix makes of ``x`` along the pairs found so far: ``y - sum value * right * (left . x)``."""
    if found is None:
        return y
    along = found.join(x.withColumnRenamed("x", "_x"), ["structure", "idx"]).groupBy("structure", "nth", "eigenvalue").agg(F.sum(F.col("left") * F.col("_x")).alias("part"))
    minus = found.select("structure", "nth", "idx", "right").join(along, ["structure", "nth"]).select("structure", "idx", (-F.col("eigenvalue") * F.col("part") * F.col("right")).alias("x"))
    return y.unionByName(minus).groupBy("structure", "idx").agg(F.sum("x").alias("x"))


def _iterate(t: DataFrame, start: DataFrame, found: DataFrame | None, rounds: int, tolerance: float, stride: int = 6):
    """``(vectors, fits)`` once every structure has converged or after ``rounds`` products.

    ``vectors(structure, idx, w0, w1, w2)`` are three successive products.
    ``fits`` tells by their inner products how well ``w1 = a w0`` (a real
    eigenvalue) or ``w2 = a w1 + b w0`` (two of one size) holds.
    """
    x, spark = start, t.sparkSession
    for n in range(0, rounds, stride):
        since = written()
        for _ in range(stride - 2):
            x = _deflated(multiply(t, x), x, found)
        w0 = materialize(x, "vector")
        w1 = materialize(_deflated(multiply(t, w0), w0, found), "vector")
        w2 = _deflated(multiply(t, w1), w1, found)
        zero = F.lit(0.0)
        three = [w.select("structure", "idx", *[(F.col("x") if i == j else zero).alias(f"w{j}") for j in range(3)]) for i, w in enumerate((w0, w1, w2))]
        vectors = materialize(three[0].union(three[1]).union(three[2]).groupBy("structure", "idx").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(3)]), "vectors")
        fits = materialize(_fits(vectors, tolerance), "fits")
        if n + stride >= rounds or fits.where("NOT converged").isEmpty():
            return vectors, fits
        x = vectors.join(fits.select("structure", "size"), "structure").where("size > 0").select("structure", "idx", (F.col("w2") / F.col("size")).alias("x"))
        x = materialize(x, "vector")
        release(spark, since=since, keep=x)


def _fits(vectors: DataFrame, tolerance: float) -> DataFrame:
    """``structure, real, size, eigenvalue, imaginary, residual, converged`` from three successive products."""
    dots = vectors.groupBy("structure").agg(*[F.sum(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)])
    c = {k: F.col(k) for k in ("g00", "g01", "g02", "g11", "g12", "g22")}
    spread = c["g00"] * c["g11"] - c["g01"] * c["g01"]
    one = dots.select(
        "structure", "g11", "g22", F.when(c["g00"] > 0, c["g01"] / c["g00"]).otherwise(0.0).alias("lambda"),
        F.when(spread > 0, (c["g12"] * c["g00"] - c["g02"] * c["g01"]) / spread).alias("a"), F.when(spread > 0, (c["g02"] * c["g11"] - c["g12"] * c["g01"]) / spread).alias("b"),
    )
    # the gaps themselves are added up, as differences of inner products would lose half of the digits
    gap = F.col("w1") - F.col("lambda") * F.col("w0")
    gap2 = F.col("w2") - F.col("a") * F.col("w1") - F.col("b") * F.col("w0")
    gaps = vectors.join(one, "structure").groupBy(*one.columns).agg(F.sum(gap * gap).alias("s1"), F.sum(gap2 * gap2).alias("s2"))
    share = lambda s, g: F.when(F.col(g) > 0, F.sqrt(F.col(s) / F.col(g))).otherwise(0.0)
    two = gaps.withColumns({"one": share("s1", "g11"), "two": share("s2", "g22")})
    disc = F.col("a") * F.col("a") / 4 + F.col("b")
    # two real ones of unlike size: the greater leads, and its own fit tells how far it has got
    real = (F.col("one") <= tolerance) | F.col("a").isNull() | (F.col("one") <= F.col("two")) | (disc >= 0)
    return two.select(
        "structure", real.alias("real"), F.sqrt("g22").alias("size"), F.when(real, F.col("lambda")).otherwise(F.col("a") / 2).alias("eigenvalue"),
        F.when(real, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), -disc))).alias("imaginary"), F.when(real, F.col("one")).otherwise(F.col("two")).alias("residual"),
    ).withColumn("converged", F.col("residual") <= tolerance)


def _start(t: DataFrame, seed: str) -> DataFrame:
    rows = t.select("structure", F.col("in_idx").alias("idx")).distinct()
    return rows.select("structure", "idx", (0.5 + uniform(seed, F.col("idx"))).alias("x"))


def leading_eigenvalues(t: DataFrame, count: int = 1, rounds: int = 300, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """The ``count`` eigenvalues of largest size of every matrix ``t(structure, out_idx, in_idx, value)``, and their vectors.

    Returns ``structure, nth, eigenvalue, imaginary, residual, converged`` and
    ``structure, nth, idx, right`` with unit vectors. ``residual`` is
    ``|T v - eigenvalue v| / |T v|``, or for a complex pair, of which only that
    with the positive imaginary part is listed, that of the plane it turns in.
    The spectral radius is the size of the first. ``converged`` tells that the
    iteration has; from the second on its matrix is only as good as the pairs
    taken out, while ``residual`` is always of the matrix itself.

    Power iteration: a product is a join on the column and an aggregation by
    row, so neither a matrix nor a vector is held by one task, and rows may be
    any number; all that is read back is whether residuals are small. Further
    eigenvalues are found after the pairs so far are taken out of the products
    by their left and right vectors; that ends at a complex pair. What has not
    converged after ``rounds`` products is listed with its residual.

    A matrix of zeros, or one whose powers vanish, has the eigenvalue 0; null
    values count as 0, repeated entries add up, and an empty table gives none.
    """
    t = t.groupBy("structure", "out_idx", "in_idx").agg(F.sum(F.coalesce("value", F.lit(0.0)).cast("double")).alias("value"))
    t = materialize(t.dropna(), "matrix")
    whole, found, values, vectors = t, None, None, None
    for nth in range(count):
        right, fit = _iterate(t, _start(t, f"right{nth}"), found, rounds, tolerance)
        gone = t.select("structure").distinct().join(fit, "structure", "left_anti")  # their products have vanished
        fit = materialize(fit.union(gone.selectExpr("structure", "true", "0D", "0D", "0D", "0D", "true")), "fits")
        one = materialize(fit.select("structure", F.lit(nth).alias("nth"), "eigenvalue", "imaginary", "residual", "converged"), "values")
        unit = right.join(fit.where("size > 0").select("structure", "real"), "structure")
        size = unit.groupBy("structure").agg(F.sqrt(F.sum(F.col("w1") * F.col("w1"))).alias("n"))
        unit = materialize(unit.join(size, "structure").select("structure", F.lit(nth).alias("nth"), "idx", (F.col("w1") / F.col("n")).alias("right"), "real"), "right")
        values = one if values is None else values.union(one)
        vectors = unit.drop("real") if vectors is None else vectors.union(unit.drop("real"))
        if nth + 1 < count:
            going = fit.where("real AND converged AND size > 0").select("structure", "eigenvalue")
            t = materialize(t.join(going, "structure", "left_semi"), "matrix")
            # products from the left see the pairs with their sides swapped
            swapped = None if found is None else found.withColumnsRenamed({"left": "right", "right": "left"})
            left, _ = _iterate(_transposed(t), _start(_transposed(t), f"left{nth}"), swapped, rounds, tolerance)
            both = unit.where("real").join(left.select("structure", "idx", F.col("w1").alias("left")), ["structure", "idx"], "left").fillna(0.0, "left")
            scale = both.groupBy("structure").agg(F.sum(F.col("left") * F.col("right")).alias("s")).where("s <> 0")
            more = both.join(scale, "structure").join(going, "structure").select("structure", "nth", "idx", "eigenvalue", "right", (F.col("left") / F.col("s")).alias("left"))
            found = materialize(more if found is None else found.union(more), "found")
    if count == 1:
        return values, vectors
    own = residuals(whole, values, vectors).withColumnRenamed("residual", "own")
    size = F.abs("eigenvalue")
    exact = F.when(F.col("nth") > 0, F.when(size > 0, F.col("own") / size).otherwise(F.col("own")))
    values = values.join(own, ["structure", "nth"], "left").withColumn("residual", F.coalesce(exact, "residual")).drop("own")
    return values.select("structure", "nth", "eigenvalue", "imaginary", "residual", "converged"), vectors


def residuals(t: DataFrame, values: DataFrame, vectors: DataFrame) -> DataFrame:
    """``structure, nth, residual`` of real eigenpairs, worked out anew: ``|T v - eigenvalue v|``, summed over all rows."""
    key = ["structure", "nth"]
    made = t.join(vectors.select("structure", "nth", F.col("idx").alias("in_idx"), "right"), ["structure", "in_idx"]).groupBy(*key, F.col("out_idx").alias("idx")).agg(F.sum(F.col("value") * F.col("right")).alias("d"))
    scaled = vectors.join(values.where("imaginary = 0"), key).select(*key, "idx", (-F.col("eigenvalue") * F.col("right")).alias("d"))
    gaps = made.join(values.where("imaginary = 0").select(*key), key, "left_semi").unionByName(scaled).groupBy(*key, "idx").agg(F.sum("d").alias("d"))
    return gaps.groupBy(*key).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("residual"))
