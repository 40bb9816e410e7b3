"""Written stages and running totals that need no task to see a whole group."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where a local session names none (tests), a temporary folder becomes the
    context's checkpoint folder; on a cluster, whose machines wouldn't see each
    other's, that raises ``ValueError``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cairn-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back.

    The result has no lineage: a lost executor costs only the tasks that were
    running on it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more, and let Spark remove the shuffles behind them."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            p.getFileSystem(conf).delete(p, True)
    jvm.System.gc()  # shuffles go when their plans are collected


def written() -> int:
    """How many tables this process has written so far and not released."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written in this process after the first ``since``, but for that of ``keep``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    for path in _written[since:]:
        if path.rsplit("/", 1)[-1] not in names:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            _written.remove(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few values that are sent to the tasks at most.
SENT = 1_000_000


def sent(df: DataFrame) -> DataFrame:
    """``df``, which is broadcast in joins if it has ``SENT`` rows at most and shuffled if it has more."""
    return F.broadcast(df) if df.count() <= SENT else df


def _local_totals(group: list[str], value: str, largest: bool):
    """Running totals (or maxima) of ``value`` within a sorted partition, restarted when ``group`` changes."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, total = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(n, bool)
            keys = []
            for g in group:
                codes = batch.column(batch.schema.get_field_index(g)).dictionary_encode(null_encoding="encode")
                idx = codes.indices.to_numpy(zero_copy_only=False)
                new[1:] |= idx[1:] != idx[:-1]
                keys.append(codes)
            first = tuple(k[0].as_py() for k in keys)
            starts = np.flatnonzero(new)
            head = starts[0] if len(starts) else n
            if largest:  # each group lies above all before it, which restarts the maximum
                above = np.cumsum(new) << 32
                out = np.maximum.accumulate(v + above) - above
                if last == first:
                    out[:head] = np.maximum(out[:head], total)
            else:
                run_sum = np.cumsum(v)
                base = np.zeros(n, np.int64)
                if len(starts):
                    base[starts] = run_sum[starts - 1] - np.concatenate(([0], run_sum[starts[:-1] - 1]))
                    base = np.cumsum(base)
                out = run_sum - base
                if last == first:
                    out[:head] += total
            last, total = tuple(k[n - 1].as_py() for k in keys), int(out[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(out)],
                names=[*batch.schema.names, "_part", "_local"],
            )

    return run


def running_totals(df: DataFrame, group: list[str], order: list[Column], value: str, out: str, largest: bool = False) -> DataFrame:
    """Add ``out``: the inclusive running total of ``value`` in ``order`` within ``group``.

    With ``largest`` it is the largest value so far; values then are 32-bit.

    The rows are range-partitioned by ``order`` (which must begin with the
    group's columns), so a group of any size spreads over many tasks; each
    task adds up its own rows and the tasks' sums are joined back as offsets.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    local = (
        df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_local_totals(group, value, largest), schema)
    )
    local = materialize(local, "totals")
    join, zero = (F.max, -(1 << 31)) if largest else (F.sum, 0)
    sums = local.groupBy(*group, "_part").agg(join(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_p"),
        F.coalesce(join("_sum").over(before), F.lit(zero)).alias("_offset"),
    )
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    total = F.greatest("_local", "_offset") if largest else F.col("_local") + F.col("_offset")
    return local.join(offsets, on, "left").select(*df.columns, total.alias(out))


def ranked(df: DataFrame, order: list[Column], out: str, group: list[str] | None = None) -> DataFrame:
    """Add ``out``: the row number, from 1, in ``order`` within ``group`` (which ``order`` must begin with)."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("long")), group or [], order, "_one", out).drop("_one")
