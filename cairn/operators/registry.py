"""Content registry of subdivision maps: what is unique, what repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.plans.stages import materialize


def registry(tree: DataFrame) -> DataFrame:
    """One row for each ``(level, hash)``: uses, emptiness, block size and the first object that has it."""
    return tree.groupBy("level", "hash").agg(
        F.count("*").alias("count"), F.bool_or("is_empty").alias("is_empty"), F.first("size").alias("resolution"), F.min("object_id").alias("first_object")
    )


def level_stats(tree: DataFrame) -> DataFrame:
    """Per level: unique contents, blocks, unique empty contents and the share of unique ones."""
    return level_counts(registry(tree))


def level_counts(registry: DataFrame) -> DataFrame:
    """``level_stats`` from a registry."""
    out = registry.groupBy("level").agg(F.count("*").alias("unique"), F.sum("count").alias("total"), F.count_if("is_empty").alias("empty"))
    return out.withColumn("deduplication_ratio", F.col("unique") / F.col("total"))


def overall_stats(tree: DataFrame) -> DataFrame:
    """Totals over all levels and each level's beside them (level null: overall)."""
    return overall_counts(registry(tree))


def overall_counts(registry: DataFrame) -> DataFrame:
    """``overall_stats`` from a registry."""
    out = registry.rollup("level").agg(F.count("*").alias("unique_subvolumes"), F.sum("count").alias("total_subvolumes"))
    return out.withColumn("deduplication_ratio", F.col("unique_subvolumes") / F.col("total_subvolumes"))


def new_per_object(tree: DataFrame) -> DataFrame:
    """How many contents each object, in order of ids, is the first to have."""
    firsts = tree.groupBy("level", "hash").agg(F.min("object_id").alias("object_id"))
    counts = firsts.groupBy("object_id").agg(F.count("*").alias("n"))
    return tree.select("object_id").distinct().join(counts, "object_id", "left").select("object_id", F.coalesce("n", F.lit(0)).alias("new_unique_count"))


def most_common(tree: DataFrame, k: int, level: int | None = None) -> DataFrame:
    """The ``k`` most frequent contents of each level, or of one; ties go to the smaller hash."""
    tree = tree if level is None else tree.where(F.col("level") == level)
    counts = tree.groupBy("level", "hash").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("count"), "hash"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def hash_frequency(tree: DataFrame, level: int | None = None) -> DataFrame:
    return (tree if level is None else tree.where(F.col("level") == level)).groupBy("hash").agg(F.count("*").alias("count"))


def get_count(tree: DataFrame, hashes: DataFrame) -> DataFrame:
    """Uses of the given hashes, 0 for unknown ones."""
    return hashes.join(hash_frequency(tree), "hash", "left").select("hash", F.coalesce("count", F.lit(0)).alias("count"))


def missing(needed: DataFrame, present: DataFrame) -> DataFrame:
    """Needed contents that aren't there: a finished run has none."""
    return needed.select("level", "hash").distinct().join(present, ["level", "hash"], "left_anti")


#: Contents of most uses that are sent to the tasks; only rarer ones meet their blocks by a shuffle.
FREQUENT = 20_000


def _with_contents(tree: DataFrame, contents: DataFrame, *values: str) -> DataFrame:
    """``tree`` with ``values`` of its blocks' contents, null for unknown ones; ``contents(_level, _hash, _uses, ...)`` has each content once.

    A content such as the empty one, which most objects have, would bring its
    blocks into one task, so the ``FREQUENT`` contents of most uses are broadcast.
    """
    on = (F.col("level") == F.col("_level")) & (F.col("hash") == F.col("_hash"))
    few = contents.count() <= FREQUENT
    top = contents if few else materialize(contents.orderBy(F.desc("_uses"), "_level", "_hash").limit(FREQUENT), "frequent")
    found = tree.join(F.broadcast(top), on, "left")
    if few:
        return found.select(*tree.columns, *values)
    rest = contents.join(F.broadcast(top.select("_level", "_hash")), ["_level", "_hash"], "left_anti")
    met = found.where("_hash is null").select(*tree.columns).join(rest.hint("merge"), on, "left").select(*tree.columns, *values)
    return found.where("_hash is not null").select(*tree.columns, *values).union(met)


def new_flags(tree: DataFrame) -> DataFrame:
    """``tree`` with ``is_new``: whether a block, in order of objects and positions, is the first with its content."""
    at = F.struct("object_id", *(f"global_position_{x}" for x in "xyz"))
    firsts = tree.groupBy(F.col("level").alias("_level"), F.col("hash").alias("_hash")).agg(F.min(at).alias("_first"), F.count("*").alias("_uses"))
    return _with_contents(tree, materialize(firsts, "firsts"), "_first").select(*tree.columns, (at == F.col("_first")).alias("is_new"))


def with_registry(tree: DataFrame, known: DataFrame) -> DataFrame:
    """Every block with the uses that the registry ``known`` counts for its content; 0 for contents that it lacks."""
    counts = known.select(F.col("level").alias("_level"), F.col("hash").alias("_hash"), F.col("count").alias("_uses"))
    return _with_contents(tree, counts, "_uses").select(*tree.columns, F.coalesce("_uses", F.lit(0)).alias("uses"))


def counters(known: DataFrame) -> DataFrame:
    """Per level, what a loaded registry counted: unique contents, blocks and unique empty contents."""
    return known.groupBy("level").agg(F.count("*").alias("unique"), F.sum("count").alias("total"), F.count_if("is_empty").alias("empty"))


def common_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``hash, side``: which hashes are in both relations, or in one only."""
    marked = a.select("hash", F.lit(1).alias("in")).union(b.select("hash", F.lit(2)))
    side = F.when(F.col("sides") == 3, "both").when(F.col("sides") == 1, "first").otherwise("second")
    return marked.groupBy("hash").agg(F.bit_or("in").alias("sides")).select("hash", side.alias("side"))
