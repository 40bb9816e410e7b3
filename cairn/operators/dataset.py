"""Access to training samples: selection, chunks, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.columns import hash_bits
from cairn.plans.stages import ranked


def collect_samples(tree: DataFrame, objects: DataFrame, splits: DataFrame, split: str, levels: list[int] | None = None, include_empty: bool = False) -> DataFrame:
    """``level, hash``: level 0 objects of the split by ``object_`` and their id, and each content once that an object of the split uses."""
    mine = splits.where(F.col("split") == split).select("object_id")
    top = objects.join(mine, "object_id", "left_semi").select(F.lit(0).alias("level"), F.concat(F.lit("object_"), "object_id").alias("hash"))
    rest = tree if include_empty else tree.where(~F.col("is_empty"))
    rest = rest.join(mine, "object_id", "left_semi").select("level", "hash").distinct()
    out = top.union(rest)
    return out.where(F.col("level").isin(levels)) if levels is not None else out


def chunk_index(samples: DataFrame, key: list[str], count: str, chunk: int | None) -> DataFrame:
    """Consecutive ranges of at most ``chunk`` rays for every sample; one range each without ``chunk``."""
    size = F.col(count) if chunk is None else F.lit(chunk)
    n = F.ceil(F.col(count) / size).cast("int")
    out = samples.where(F.col(count) > 0).select(*key, F.col(count).alias("_n"), size.alias("_size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_idx"))
    start, end = F.col("chunk_idx") * F.col("_size"), F.least((F.col("chunk_idx") + 1) * F.col("_size"), F.col("_n"))
    return out.select(*key, "chunk_idx", start.cast("long").alias("chunk_start"), end.cast("long").alias("chunk_end"), (end - start).cast("long").alias("num_rays"))


def numbered(rows: DataFrame, key: list[str], order: list[str], out: str = "ray_idx") -> DataFrame:
    """Rows numbered from 0 within ``key``."""
    number = ranked(rows, [F.col(c) for c in (*key, *order)], "_number", key)  # over any number of tasks for one key
    return number.withColumn(out, (F.col("_number") - 1).cast("int")).drop("_number")


def fetch_chunk(rows: DataFrame, chunk_idx: int, chunk: int) -> DataFrame:
    """The rays of one chunk of every sample."""
    return rows.where((F.col("ray_idx") >= chunk_idx * chunk) & (F.col("ray_idx") < (chunk_idx + 1) * chunk))


def batches(samples: DataFrame, key: str, size: int, seed: int = 42, drop_last: bool = False) -> DataFrame:
    """Samples in a seeded order, dealt into batches of ``size``."""
    keyed = samples.select(key, hash_bits(str(seed), F.col(key)).alias("_key"))
    out = ranked(keyed, [F.col("_key").asc(), F.col(key).asc()], "rank").select(key, (F.col("rank") - 1).alias("position")).withColumn("batch", F.expr(f"position div {size}"))
    if drop_last:
        full = samples.count() // size
        out = out.where(F.col("batch") < full)
    return out


def collate(batched: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Where each sample's nodes begin in its batch, and the batch's total and largest grid."""
    j = batched.join(sizes, key)
    before = Window.partitionBy("batch").orderBy("position")
    whole = Window.partitionBy("batch")
    return j.select(
        "batch", "position", key, "num_nodes", F.coalesce(F.sum("num_nodes").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("node_offset"),
        (F.row_number().over(before) - 1).alias("voxel_idx"), F.sum("num_nodes").over(whole).alias("batch_nodes"), F.max("num_nodes").over(whole).alias("largest"),
    )


def gather(rays: DataFrame, latents: DataFrame, key: str) -> DataFrame:
    """Each ray with its grid's latent row."""
    return rays.join(latents, key)


def mean_squared_error(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*by).agg(F.avg(d * d).alias("mse"))


def existing_samples(samples: DataFrame, present: DataFrame) -> DataFrame:
    """The samples whose voxels ``present(level, hash)`` has; raises ``ValueError`` if none are left."""
    out = samples.join(present.select("level", "hash").distinct(), ["level", "hash"], "left_semi")
    if out.isEmpty():
        raise ValueError("no samples are left: check the split, the levels and the dataset's voxels")
    return out


def collate_rays(rays: DataFrame, collated: DataFrame, key: str) -> DataFrame:
    """Rays with their batch and, as ``ray_to_voxel``, their sample's index in it."""
    return rays.join(collated.select(key, "batch", F.col("voxel_idx").alias("ray_to_voxel")), key)


def collate_edges(edges: DataFrame, collated: DataFrame, key: str) -> DataFrame:
    """Edges of graphs as edges of their batch's graph: node numbers go on where the sample before ends."""
    j = edges.join(collated.select(key, "batch", "node_offset"), key)
    return j.select("batch", key, (F.col("src") + F.col("node_offset")).alias("src"), (F.col("dst") + F.col("node_offset")).alias("dst"))


def pad_grids(extents: DataFrame, collated: DataFrame, key: str) -> DataFrame:
    """Each sample's grid ``ni, nj, nk`` with the batch's largest and the zeros that fill it up."""
    j = extents.join(collated.select(key, "batch"), key)
    whole = j.groupBy("batch").agg(*[F.max(f"n{a}").alias(f"p{a}") for a in "ijk"])
    padding = F.col("pi") * F.col("pj") * F.col("pk") - F.col("ni") * F.col("nj") * F.col("nk")
    return j.join(whole, "batch").select("batch", key, *[f"n{a}" for a in "ijk"], *[f"p{a}" for a in "ijk"], padding.alias("zeros"))
