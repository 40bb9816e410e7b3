"""Analytics over flat subdivision maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.columns import hash_bits


def object_complexity(tree: DataFrame) -> DataFrame:
    return tree.groupBy("object_id").agg(F.countDistinct("hash").alias("unique_hashes"))


def complexity_extremes(tree: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most and least complex objects, ties by id."""
    c = object_complexity(tree)
    most = c.orderBy(F.desc("unique_hashes"), "object_id").limit(k).withColumn("end", F.lit("most"))
    return most.union(c.orderBy("unique_hashes", "object_id").limit(k).withColumn("end", F.lit("least")))


def summary(tree: DataFrame) -> DataFrame:
    """Per level: records, empty records, unique contents; ``level`` null for all records."""
    return tree.rollup("level").agg(
        F.count("*").alias("records"), F.count_if("is_empty").alias("empty_count"), F.countDistinct("hash").alias("unique_hashes"), F.countDistinct("object_id").alias("num_objects")
    )


def empty_ratio(tree: DataFrame) -> DataFrame:
    out = tree.groupBy("level").agg(F.count("*").alias("total"), F.count_if("is_empty").alias("empty"))
    return out.withColumn("empty_pct", 100.0 * F.col("empty") / F.col("total"))


def octant_distribution(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level", "octant_index").agg(F.count("*").alias("count"), F.count_if(~F.col("is_empty")).alias("occupied"))


def level_hash_frequency(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level", "hash").agg(F.count("*").alias("count"))


def cooccurrence(tree: DataFrame, level: int) -> DataFrame:
    """Pairs of different, non-trivial contents of a level that share objects, and in how many.

    Objects with the same contents are counted first, so pairs are made once
    for every distinct set.
    """
    owned = tree.where((F.col("level") == level) & ~F.col("is_empty") & ~F.col("is_full"))
    sets = owned.groupBy("object_id").agg(F.array_sort(F.collect_set("hash")).alias("hashes")).groupBy("hashes").agg(F.count("*").alias("n"))
    one = sets.select("n", "hashes", F.posexplode("hashes").alias("at", "hash_a"))
    pairs = one.select("n", "hash_a", F.explode(F.expr("slice(hashes, at + 2, size(hashes))")).alias("hash_b"))
    return pairs.groupBy("hash_a", "hash_b").agg(F.sum("n").alias("objects"))


def common_contents(tree: DataFrame, level: int, most: int) -> DataFrame:
    """The contents in over ``most`` objects, with their objects' number."""
    owned = tree.where((F.col("level") == level) & ~F.col("is_empty") & ~F.col("is_full")).groupBy("hash").agg(F.countDistinct("object_id").alias("objects"))
    return owned.where(F.col("objects") > most)


def first_wins(things: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every ``key``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return things.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def level_distribution(samples: DataFrame) -> DataFrame:
    return samples.groupBy("level").agg(F.count("*").alias("count"))


def objects_from(objects: DataFrame, start: str | None = None, number: int | None = None) -> DataFrame:
    """Objects in order of ids from ``start`` on, ``number`` at most."""
    out = objects if start is None else objects.where(F.col("object_id") >= start)
    return out if number is None else out.orderBy("object_id").limit(number)


def random_objects(objects: DataFrame, number: int = 1, seed: int = 42) -> DataFrame:
    """``number`` objects that are first in a seeded order."""
    return objects.orderBy(hash_bits(str(seed), F.col("object_id")), "object_id").limit(number)


def durations(runs: DataFrame, by: str, seconds: str) -> DataFrame:
    """Runs, their mean, extremes and percentiles."""
    q = lambda p: F.percentile(seconds, F.lit(p))
    return runs.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.95).alias("p95"), q(0.99).alias("p99")
    )


def batch_totals(processed: DataFrame) -> DataFrame:
    """One row over ``processed(object_id, error, n_rays, seconds)``: objects, successes, failures, rays and averages over the successes."""
    good = F.col("error").isNull()
    return processed.agg(
        F.count("*").alias("total"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), F.sum(F.when(good, F.col("n_rays"))).alias("total_rays"),
        F.avg(F.when(good, F.col("n_rays"))).alias("mean_rays"), F.avg(F.when(good, F.col("seconds"))).alias("mean_seconds"),
    )
