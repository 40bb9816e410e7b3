"""Spatial relations made from ordinary tables.

Each adapter is a narrow projection of one table, so any filter or column
selection on top of it reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.columns import padded_id
from cairn.plans.stages import partitions, table

GRID = 16
#: Objects that a task is dealt, so that its cells (4,096 each at most) are grouped and sorted in memory however many objects there are.
DEALT = 1_000


def dealt(spark: SparkSession, rows: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """``rows``, one for each object or each with one of ``objects``, dealt to tasks by ``object_id``: aggregations and joins whose keys hold it then need no exchange."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # or joins on more than object_id would be dealt anew
    return rows.repartition(max(partitions(spark), -(-(objects or rows).count() // DEALT)), "object_id")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_id``: every part is an object, with or without cells."""
    return dealt(spark, table(spark, sf_dir, "part").select(padded_id(F.col("p_partkey")).alias("object_id")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_id, i, j, k``: parts as solids in a grid of 16 cells a side.

    By ``p_partkey % 3`` a ball of radius ``p_size % 8``, a box of length
    ``p_size % 16``, or a lattice of period ``2 + p_size % 5``. Parts are dealt
    by ``object_id`` before they are exploded.
    """
    axis = F.sequence(F.lit(0), F.lit(GRID - 1))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", padded_id(F.col("p_partkey")).alias("object_id"))
    part = dealt(spark, part)
    grid = part.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis)).withColumn("k", F.explode(axis))
    inside = F.expr(
        "CASE p_partkey % 3 WHEN 0 THEN (i - 8) * (i - 8) + (j - 8) * (j - 8) + (k - 8) * (k - 8) <= (p_size % 8) * (p_size % 8) "
        "WHEN 1 THEN i < p_size % 16 AND j < 8 AND k < 8 ELSE (i + j + k) % (2 + p_size % 5) = 0 END"
    )
    return grid.where(inside).select("object_id", "i", "j", "k")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_id, vec_id, t, x, y, z``: embeddings cut into triples, by label."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda n: F.get("embedding", F.col("t") * 3 + n).cast("double")
    return (
        e.where("label is not null").select(F.col("label").cast("string").alias("object_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("t"))
        .select("object_id", "vec_id", "t", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    )


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ray_id, object_id, ox, oy, oz, dx, dy, dz``: every order is a ray towards a point near its object's centre.

    Dealt out as the objects are, as the joins with their masks need it; the exchange
    also keeps these expressions out of later filters.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ray_id"))
    part = table(spark, sf_dir, "part")
    n = part.agg(F.count("*").alias("n"))
    o = o.crossJoin(F.broadcast(n))  # one row
    step = lambda f, m, low: ((F.col("ray_id") * f) % m) / 100.0 - low
    aimed = o.select(
        "ray_id", padded_id(F.col("ray_id") % F.col("n") + 1).alias("object_id"),
        step(13, 4001, 20.0037).alias("ox"), step(29, 4001, 20.0041).alias("oy"), step(53, 4001, 20.0053).alias("oz"),
        step(7, 1301, 6.5013).alias("tx"), step(11, 1301, 6.5017).alias("ty"), step(17, 1301, 6.5019).alias("tz"),
    )
    for a in "xyz":
        aimed = aimed.withColumn(f"v{a}", F.col(f"t{a}") - F.col(f"o{a}"))
    size = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    return dealt(spark, aimed.select("ray_id", "object_id", "ox", "oy", "oz", *[(F.col(f"v{a}") / size).alias(f"d{a}") for a in "xyz"]), part)


def matrix(spark: SparkSession, sf_dir: str, patches: int = 24, n_sh: int = 4) -> DataFrame:
    """``structure, out_idx, in_idx, value``: line items summed into one transfer matrix for each return flag."""
    n = patches * n_sh
    li = table(spark, sf_dir, "lineitem")
    value = F.sum(F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))) / 977.0
    return li.groupBy(F.col("l_returnflag").alias("structure"), (F.col("l_partkey") % n).cast("int").alias("out_idx"), (F.col("l_suppkey") % n).cast("int").alias("in_idx")).agg(
        value.alias("value")
    )


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, event_type, user_id, x, y, z, value``: events as samples on the unit sphere."""
    e = table(spark, sf_dir, "events")
    z = ((F.col("event_id") * 37) % 2001) / 1000.0 - 1.0
    phi = ((F.col("event_id") * 91) % 6283) / 1000.0
    flat = e.select("event_id", "event_type", "user_id", "value", z.alias("z"), phi.alias("phi"))
    side = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("z") * F.col("z")))
    return flat.select("event_id", "event_type", "user_id", (side * F.cos("phi")).alias("x"), (side * F.sin("phi")).alias("y"), "z", "value")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, object_id, level, hash``: documents as content blobs."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("object_id"), F.col("lang").alias("level"), F.sha2("text", 256).alias("hash"))
