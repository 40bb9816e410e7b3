"""Mergeable sketches of unique contents, for builds that add objects without counting the whole map again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers are 2 to this power; estimates have a standard error of 1.04 over the root of that.
LG = 12
ERROR = 1.04 / 2 ** (LG / 2)


def object_sketches(tree: DataFrame, lg: int = LG) -> DataFrame:
    """``object_id, level, blocks, contents``: a sketch of the hashes of each object at each level, and how many blocks it has there."""
    return tree.groupBy("object_id", "level").agg(F.count("*").alias("blocks"), F.hll_sketch_agg("hash", F.lit(lg)).alias("contents"))


def level_sketches(sketches: DataFrame) -> DataFrame:
    """``level, blocks, contents``: the union of the sketches given, by objects or by earlier unions."""
    return sketches.groupBy("level").agg(F.sum("blocks").alias("blocks"), F.hll_union_agg("contents").alias("contents"))


def merged(known: DataFrame, added: DataFrame) -> DataFrame:
    """``level_sketches`` of what was there and what a resumed build added; objects must not be in both, or their blocks count twice."""
    return level_sketches(known.select("level", "blocks", "contents").unionByName(added.select("level", "blocks", "contents")))


def estimates(sketches: DataFrame) -> DataFrame:
    """``level, total, unique, deduplication_ratio, margin``: estimated unique contents, true within three standard errors (``margin``) in 997 of 1,000 cases."""
    unique = F.hll_sketch_estimate("contents")
    rows = sketches.select("level", F.col("blocks").alias("total"), unique.alias("unique"))
    return rows.withColumns({"deduplication_ratio": F.col("unique") / F.col("total"), "margin": F.ceil(3 * ERROR * F.col("unique")).cast("long")})
