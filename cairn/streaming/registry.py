"""A registry that grows with a stream of subdivision records (an extension beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn import schemas


def record_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schemas.SUBDIVISION_MAP).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first record of every content; with an event ``time`` the state is bounded by the watermark."""
    if time:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["level", "hash"])
    return stream.dropDuplicates(["level", "hash"])


def keep_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's counts once, under its number: a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("level", "hash").agg(F.count("*").alias("count"), F.bool_or("is_empty").alias("is_empty"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The registry so far."""
    return spark.read.parquet(path).groupBy("level", "hash").agg(F.sum("count").alias("count"), F.bool_or("is_empty").alias("is_empty"))
