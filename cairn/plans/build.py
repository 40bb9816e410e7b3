"""Building a dataset: voxelize, subdivide, register, split, write, and go on where a run stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import octree, registry, splits
from cairn.plans.stages import materialize, sent
from cairn.sources import sinks
from cairn.sources.adapters import dealt


def source_hash(sources: DataFrame) -> DataFrame:
    """SHA-256 of each source, by which a later run knows it: of its ``content``, if the table has one, or of its path."""
    return sources.withColumn("source_hash", F.sha2("content" if "content" in sources.columns else "source_file", 256))


def pending(objects: DataFrame, finished: DataFrame, needed: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """Objects not finished, or finished with contents that are no longer there."""
    done = finished.select("object_id").distinct()
    if needed is not None and present is not None:
        # contents are made unique before they are looked up, so that blocks meet those that are lost only
        lost = materialize(needed.select("level", "hash").distinct().join(present.select("level", "hash"), ["level", "hash"], "left_anti"), "lost")
        broken = needed.join(sent(lost), ["level", "hash"], "left_semi").select("object_id").distinct()
        done = done.join(broken, "object_id", "left_anti")
    return objects.join(done, "object_id", "left_anti")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; ``None`` if nothing is written there."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def build(spark: SparkSession, cells: DataFrame, objects: DataFrame, path: str, resolution: int, least: int, ratios=(0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Write map, blocks, registry, splits and statistics under ``path``; objects that are there whole aren't done again.

    An object is there if its map is and every content that it names has its
    block. Statistics and splits are always made from the whole map, so a
    resumed run counts everything. ``cells`` may be ``octree.words`` of them.
    """
    tree_path, block_path = f"{path}/subdivision_map", f"{path}/blocks"
    known, held = _read(spark, tree_path), _read(spark, block_path)
    if known is None or held is None:
        todo, known = objects, None
    else:
        todo = materialize(pending(objects, known, known.where("not is_empty").select("object_id", "level", "hash"), held), "todo")
        damaged = materialize(known.select("object_id").distinct().join(todo, "object_id", "left_semi"), "damaged")
        if not damaged.isEmpty():
            sinks.write_table(materialize(known.join(sent(damaged), "object_id", "left_anti"), "kept"), tree_path, "level")
    new = cells.join(todo, "object_id", "left_semi")
    new = materialize(new if "w" in new.columns else octree.words(new), "words")
    todo, new = dealt(spark, todo), dealt(spark, new, todo)
    fresh = octree.subdivide(new, todo, resolution, least)
    sinks.write_table(fresh, tree_path, "level", mode="append")
    made = octree.unique_blocks(new, resolution, least)
    if held is not None:
        made = made.join(materialize(held.select("level", "hash").distinct(), "held").hint("merge"), ["level", "hash"], "left_anti")
    sinks.write_table(made, block_path, "level", mode="append")
    tree = spark.read.parquet(tree_path)
    sinks.write_table(registry.registry(tree), f"{path}/registry", "level")
    _write_splits(spark, path, ratios, seed)
    counted = spark.read.parquet(f"{path}/registry")
    stats = sinks.dataset_metadata(registry.level_counts(counted), registry.overall_counts(counted), "voxels", "1.0", resolution, least)
    stats.write.mode("overwrite").json(f"{path}/metadata")
    return registry.level_counts(counted)


def _write_splits(spark: SparkSession, path: str, ratios, seed: int) -> None:
    tree = spark.read.parquet(f"{path}/subdivision_map")
    assigned = splits.assign_splits(tree.select("object_id").distinct(), *ratios, seed=seed)
    sinks.write_table(assigned, f"{path}/object_splits")
    usage = materialize(splits.hash_usage(tree, spark.read.parquet(f"{path}/object_splits")), "usage")
    sinks.write_table(sinks.split_documents(usage, splits.contents(usage)), f"{path}/splits")


def reassign_splits(spark: SparkSession, path: str, ratios, seed: int) -> DataFrame:
    """New splits for a written dataset, and the documents that tell which splits use a content."""
    _write_splits(spark, path, ratios, seed)
    return spark.read.parquet(f"{path}/object_splits")
