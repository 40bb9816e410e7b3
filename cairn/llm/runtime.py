"""Shared helpers of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.stages import discard, materialize, new_path, partitions, ranked, release, running_totals, scratch_dir, sent, table, written

__all__ = ["components", "discard", "materialize", "new_path", "partitions", "ranked", "raw", "release", "running_totals", "scratch_dir", "sent", "table", "unwrapped", "wrapped", "written"]


def raw(column: pa.Array) -> pa.Array:
    """The bytes of a column of strings, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())


def wrapped(docs: DataFrame) -> DataFrame:
    """``given``, a struct of all columns of ``docs``, beside ``id`` and the ``hash`` of the text, so that no names clash."""
    given = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return docs.select(given.alias("given"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("hash"))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, from ``given``."""
    return rows.select(*[F.col("given")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the smallest node.

    Alternates large-star and small-star contractions, each written to the
    shared folder; the number of rounds grows with the logarithm of the
    longest path. Nodes without an edge do not appear.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        was = edges
        both = edges.union(edges.select("b", "a"))
        # the least neighbours are plain tables, so that the joins' skew at a hub can be split at run time
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS k", "least(a, m) AS m"), "low")
        large = both.join(low.hint("merge"), F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "star")
        discard(low)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"), "low")
        small = large.join(low.hint("merge"), F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(low.select("k", "m")).distinct(), "star")
        discard(low, large, was)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(edges.select("b", "b").distinct())
        seen = now
