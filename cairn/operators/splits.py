"""Train, validation and test splits of objects, and what leaks between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.columns import hash_bits
from cairn.plans.stages import materialize, ranked

SPLITS = ("train", "val", "test")


def check_ratios(train: float, val: float, test: float) -> None:
    if min(train, val, test) < 0:
        raise ValueError("split ratios must be non-negative")
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("split ratios must sum to 1.0")


def assign_splits(objects: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``object_id, split``: objects in order of a seeded hash, cut at the floors of the ratios.

    What the floors leave over goes to the test split.
    """
    check_ratios(train, val, test)
    n = objects.count()
    first, second = int(n * train), int(n * train) + int(n * val)
    keyed = objects.select("object_id", hash_bits(str(seed), F.col("object_id")).alias("_key"))
    rank = ranked(keyed, [F.col("_key").asc(), F.col("object_id").asc()], "rank")
    return rank.select("object_id", F.when(F.col("rank") <= first, "train").when(F.col("rank") <= second, "val").otherwise("test").alias("split"))


def hash_usage(tree: DataFrame, splits: DataFrame) -> DataFrame:
    """``hash, object_id, split, n, trivial``: contents by object, with uses and whether they are empty or full."""
    uses = tree.groupBy("hash", "object_id").agg(F.count("*").alias("n"), F.bool_or("is_empty").alias("is_empty"), F.bool_or(F.col("is_empty") | F.col("is_full")).alias("uniform"))
    found = uses.join(splits.select(F.col("object_id").alias("_object"), F.col("split").alias("_split")), F.col("object_id") == F.col("_object"), "left")
    known = F.when(F.col("_object").isNull(), F.raise_error(F.concat(F.lit("no split is assigned to object "), "object_id"))).otherwise(F.col("_split"))
    return found.select(*uses.columns, known.alias("split"))


def _mask():
    return F.bit_or(F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).otherwise(4))


def contents(usage: DataFrame, trivial: str = "empty") -> DataFrame:
    """One row per content: the splits that use it as bits (1 train, 2 val, 4 test) and whether it is trivial.

    ``trivial`` is ``"empty"`` or ``"empty_or_full"``.
    """
    flag = {"empty": "is_empty", "empty_or_full": "uniform"}[trivial]
    return usage.groupBy("hash").agg(_mask().alias("mask"), F.bool_or(flag).alias("trivial"), F.count("*").alias("objects"))


def object_counts(spark, splits: DataFrame) -> DataFrame:
    """Objects in each split, with a row for splits that have none."""
    names = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    counts = splits.groupBy("split").agg(F.count("*").alias("n"))
    return names.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n_objects"))


def distribution(usage: DataFrame, trivial: str = "empty") -> DataFrame:
    """Non-trivial contents by exactly which splits use them, and the trivial ones."""
    c = contents(usage, trivial)
    name = F.when(F.col("trivial"), "trivial")
    for bits, label in ((1, "train_only"), (2, "val_only"), (4, "test_only"), (3, "train_val"), (5, "train_test"), (6, "val_test"), (7, "all_splits")):
        name = name.when(F.col("mask") == bits, label)
    return c.groupBy(name.alias("bucket")).agg(F.count("*").alias("n_hashes"))


def purity(usage: DataFrame, trivial: str = "empty") -> DataFrame:
    """Per object, its blocks by who else uses their content: nobody, objects of its split, or of another (leakage)."""
    c = materialize(contents(usage, trivial), "contents").hint("merge")  # a plain table, so that the empty content's skew can be split
    own = F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).otherwise(4)
    j = usage.join(c, "hash").withColumn("leaks", F.col("mask") != own)
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    solid = ~F.col("trivial")
    out = j.groupBy("object_id", "split").agg(
        F.sum("n").alias("total_subvolumes"), part(F.col("trivial")).alias("trivial"), part(solid).alias("nontrivial"),
        part(solid & (F.col("objects") == 1)).alias("pure"), part(solid & (F.col("objects") > 1) & ~F.col("leaks")).alias("shared_same_split"),
        part(solid & F.col("leaks")).alias("shared_other_split"),
    )
    share = lambda c: F.when(F.col("nontrivial") > 0, 100.0 * F.col(c) / F.col("nontrivial")).otherwise(0.0)
    return out.withColumn("purity_percentage", share("pure")).withColumn("leakage_percentage", share("shared_other_split"))


def splits_using(usage: DataFrame) -> DataFrame:
    return usage.groupBy("hash").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"))


def objects_using(usage: DataFrame) -> DataFrame:
    return usage.select("hash", "object_id", "split").distinct()


def nontrivial_by_split(usage: DataFrame, trivial: str = "empty") -> DataFrame:
    """Distinct non-trivial contents of each split."""
    keep = contents(usage, trivial).where("not trivial").select("hash")
    return usage.select("split", "hash").distinct().join(keep, "hash", "left_semi").select("split", "hash")


def subvolume_split_info(usage: DataFrame, trivial: str = "empty") -> DataFrame:
    """Per content: its splits, how many objects use it, and whether it is trivial."""
    flag = {"empty": "is_empty", "empty_or_full": "uniform"}[trivial]
    return usage.groupBy("hash").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count("*").alias("n_objects"), F.bool_or(flag).alias("trivial"))
