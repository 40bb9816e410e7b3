"""Containment of octree blocks in boxes, by Morton codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def morton(x: Column, y: Column, z: Column, bits: int = 20) -> Column:
    """The bits of three whole numbers below ``2 ** bits``, interleaved, ``x`` highest: blocks of one octree block have codes in one interval."""
    if not 1 <= bits <= 20:
        raise ValueError("1 to 20 bits an axis are supported")
    parts = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), 3 * b + 2 - n) for b in range(bits) for n, c in enumerate((x, y, z))]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def covering_cubes(boxes: DataFrame, resolution: int, least: int) -> DataFrame:
    """The octree cubes that make up the part of each box that blocks of ``least`` cells can fill: ``box_id, object_id, depth, prefix``.

    ``boxes(box_id, object_id, lo_x .. hi_z)`` are in cells, upper ends not
    included. From the whole grid down, cubes inside the box are listed by
    depth and Morton code, cubes that its surface cuts are halved along each
    axis, and the others dropped, so a box has as many as its surface asks for.
    """
    depth = (resolution // least).bit_length() - 1
    at = [F.lit(0).alias(f"p{a}") for a in "xyz"]
    ends = [f"{e}_{a}" for e in ("lo", "hi") for a in "xyz"]
    cubes, out = boxes.select("box_id", "object_id", *ends, *at), None
    for d in range(depth + 1):
        size = resolution >> d
        inside, apart = F.lit(True), F.lit(False)
        for a in "xyz":
            low = F.col(f"p{a}") * size
            inside = inside & (low >= F.col(f"lo_{a}")) & (low + size <= F.col(f"hi_{a}"))
            apart = apart | (low + size <= F.col(f"lo_{a}")) | (low >= F.col(f"hi_{a}"))
        found = cubes.where(inside).select("box_id", "object_id", F.lit(d).alias("depth"), morton(F.col("px"), F.col("py"), F.col("pz"), max(d, 1)).alias("prefix"))
        out = found if out is None else out.union(found)
        cubes = cubes.where(~inside & ~apart)
        for a in "xyz":
            cubes = cubes.withColumn(f"p{a}", F.explode(F.array(2 * F.col(f"p{a}"), 2 * F.col(f"p{a}") + 1)))
    return out


def contained_blocks(tree: DataFrame, boxes: DataFrame, resolution: int, least: int) -> DataFrame:
    """``box_id`` and the blocks of ``tree``, at any depth, that lie inside the boxes of their object.

    A block lies in a box exactly if one of its ancestors, or itself, is one of
    the box's ``covering_cubes``. Its ancestors' codes are its own code shifted
    right, so an interval join becomes an equality on object, depth and code:
    each block is looked up once for each of the few depths above it.
    ``boxes`` with nulls contain nothing, nor do those thinner than a block.
    """
    cubes = covering_cubes(boxes, resolution, least).select("box_id", F.col("object_id").alias("_object"), "depth", "prefix")
    code = morton(*[F.expr(f"global_position_{a} div size") for a in "xyz"], max(1, (resolution // least).bit_length() - 1))
    rows = tree.withColumn("_code", code).withColumn("_depth", F.explode(F.sequence(F.lit(0), F.col("level"))))
    above = F.expr("shiftright(_code, cast(3 * (level - _depth) AS int))")
    joined = rows.withColumn("_above", above).join(cubes.hint("merge"), (F.col("object_id") == F.col("_object")) & (F.col("_depth") == F.col("depth")) & (F.col("_above") == F.col("prefix")))
    return joined.select("box_id", *tree.columns)


def descendants(tree: DataFrame, asked: DataFrame, resolution: int, least: int) -> DataFrame:
    """All blocks below the ``asked`` ones (rows of ``tree``), with the ancestor's ``box_id``: its level and position."""
    at = F.concat_ws(":", "level", *[F.col(f"global_position_{a}") for a in "xyz"])
    ends = [F.col(f"global_position_{a}").alias(f"lo_{a}") for a in "xyz"] + [(F.col(f"global_position_{a}") + F.col("size")).alias(f"hi_{a}") for a in "xyz"]
    found = contained_blocks(tree, asked.select(at.alias("box_id"), "object_id", *ends), resolution, least)
    return found.where(F.split("box_id", ":")[0].cast("int") < F.col("level"))
