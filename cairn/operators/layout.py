"""Pictures as relations: cube nets of boundary patches, and badges of octants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Row and column of patch faces +X, -X, +Y, -Y, +Z, -Z in a net of 3 by 4 squares.
NET = {0: (1, 2), 1: (1, 0), 2: (0, 1), 3: (2, 1), 4: (1, 1), 5: (1, 3)}


def cube_net(patches: DataFrame, per_face: int, value: str) -> DataFrame:
    """``structure, row, columns``: one picture a structure, of 3 * ``per_face`` rows with 4 * ``per_face`` values.

    ``patches(structure, patch_id, value)`` are placed by a table of the faces'
    squares, v upwards and u to the right in each; places of no patch are null,
    patches without a row 0. A row of a picture is the largest group.
    """
    spark = patches.sparkSession
    n = per_face * per_face
    spots = spark.createDataFrame([(f, r, c) for f, (r, c) in NET.items()], "face int, net_row int, net_col int")
    grid = spots.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(per_face - 1)))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(per_face - 1))))
    grid = grid.select(
        (F.col("face") * n + F.col("v") * per_face + F.col("u")).alias("patch_id"), (F.col("net_row") * per_face + per_face - 1 - F.col("v")).alias("row"), (F.col("net_col") * per_face + F.col("u")).alias("col")
    )  # as many rows as a box has patches
    placed = patches.groupBy("structure", "patch_id").agg(F.sum(value).alias("value")).join(F.broadcast(grid), "patch_id")
    rows = placed.groupBy("structure", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("at"))
    every = patches.select("structure").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(3 * per_face - 1))))
    taken = grid.groupBy("row").agg(F.collect_list("col").alias("cols"))
    full = every.join(F.broadcast(taken), "row").join(rows, ["structure", "row"], "left")
    places = F.sequence(F.lit(0), F.lit(4 * per_face - 1))
    columns = F.transform(places, lambda c: F.when(F.array_contains("cols", c), F.coalesce(F.try_element_at("at", c), F.lit(0.0))))
    return full.select("structure", F.col("row").cast("int").alias("row"), columns.alias("columns"))


def octant_badges(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """Blocks with the label a viewer puts on them: ``empty``, ``trivial``, ``train only``, ``shared: test, train``.

    ``contents(hash, mask, trivial)``, as of ``splits.contents``, tells which
    splits use a content and whether it counts as trivial; one that it lacks is ``unknown``.
    """
    named = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(bit)) != 0, name) for name, bit in (("test", 4), ("train", 1), ("val", 2))])
    known = contents.select(F.col("hash").alias("_hash"), F.array_compact(named).alias("splits"), "trivial")
    joined = tree.join(known.hint("merge"), F.col("hash") == F.col("_hash"), "left")
    several = F.concat(F.lit("shared: "), F.array_join("splits", ", "))
    badge = (
        F.when(F.col("is_empty"), "empty").when(F.col("splits").isNull(), "unknown").when(F.col("trivial"), "trivial").when(F.size("splits") == 1, F.concat(F.col("splits")[0], F.lit(" only"))).otherwise(several)
    )
    return joined.select(*tree.columns, badge.alias("badge"))
