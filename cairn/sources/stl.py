"""STL files as a Spark data source: byte ranges of one binary file are read by many tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cairn.sources import staged, store

CORNERS = [f"{v}{a}" for v in "abc" for a in "xyz"]
SCHEMA = "object_id string, face_id int, " + ", ".join(f"{c} double" for c in CORNERS) + ", error string"
ARROW = pa.schema([("object_id", pa.string()), ("face_id", pa.int32()), *[(c, pa.float64()) for c in CORNERS], ("error", pa.string())])
#: A binary file is a heading and the number of triangles (84 bytes), then 50 bytes for each.
HEAD, RECORD = 84, np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("attribute", "<u2")])
BATCH = 50_000


class Range(InputPartition):
    def __init__(self, uri: str, first: int, count: int):
        self.uri, self.first, self.count = uri, first, count


def _name(uri: str) -> str:
    return uri.rsplit("/", 1)[-1].removesuffix(".stl").removesuffix(".STL")


def _rows(name: str, first: int, corners: np.ndarray, error: str | None = None) -> pa.RecordBatch:
    n = len(corners)
    faces = pa.array(np.arange(first, first + n, dtype=np.int32)) if error is None else pa.nulls(n, pa.int32())
    values = [pa.array(np.ascontiguousarray(corners[:, c])) if error is None else pa.nulls(n, pa.float64()) for c in range(9)]
    return pa.RecordBatch.from_arrays([pa.array([name] * n), faces, *values, pa.array([error] * n, pa.string())], schema=ARROW)


def _error(name: str, error: str) -> pa.RecordBatch:
    return _rows(name, 0, np.zeros((1, 9)), error)


def text_triangles(data: bytes) -> np.ndarray:
    """Corners of a text STL, a row a triangle; ``ValueError`` if it is none."""
    if data.lstrip()[:5].lower() != b"solid":
        raise ValueError("not an STL file")
    words = data.split()
    try:
        flat = np.array([[float(x) for x in words[n + 1 : n + 4]] for n, w in enumerate(words) if w == b"vertex"], float)
        return flat.reshape(-1, 9)
    except ValueError as e:
        raise ValueError("broken text STL") from e


class StlReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("trianglesPerTask", 200_000))

    def partitions(self) -> list[Range]:
        """Ranges by size alone; whether a file is binary is seen by the tasks, from its own head."""
        out = []
        for uri, size in store.files(self.path, (".stl", ".STL")):
            whole = (size - HEAD) // RECORD.itemsize if size >= HEAD and (size - HEAD) % RECORD.itemsize == 0 else 0
            out += [Range(uri, n, min(self.most, whole - n)) for n in range(0, max(whole, 1), self.most)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.uri:
            return
        name = _name(part.uri)
        try:
            with store.reader(part.uri) as f:
                size, head = f.size(), f.read(HEAD)
                if len(head) == HEAD and size == HEAD + RECORD.itemsize * struct.unpack_from("<I", head, 80)[0]:
                    f.seek(HEAD + part.first * RECORD.itemsize)
                    for first in range(part.first, part.first + part.count, BATCH):
                        n = min(BATCH, part.first + part.count - first)
                        yield _rows(name, first, np.frombuffer(f.read(n * RECORD.itemsize), RECORD, n)["corners"].astype(np.float64))
                elif part.first == 0:  # a text file is one stream; its first range reads all of it
                    yield _rows(name, 0, text_triangles(head + f.read()))
        except (OSError, ValueError) as e:
            if part.first == 0:
                yield _error(name, str(e))


class StlWriter(DataSourceArrowWriter):
    """One binary file an object, streamed by the task that has its rows, which must be together and carry ``n_faces``."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.staging = options["path"], overwrite, staged.new_staging(options["path"])

    def write(self, iterator) -> WriterCommitMessage:
        out, now, names, folder = None, None, [], staged.attempt(self.staging)
        for batch in iterator:
            rows = pa.Table.from_batches([batch])
            for at, n in staged.spans(rows, ["object_id"]):
                part = rows.slice(at, n)
                key = part["object_id"][0].as_py()
                if key != now:
                    if out:
                        out.close()
                    now, name = key, f"{key}.stl"
                    out = store.writer(f"{folder}/{name}")
                    out.write(bytes(80) + struct.pack("<I", part["n_faces"][0].as_py()))
                    names.append(name)
                made = np.zeros(n, RECORD)
                made["corners"] = np.stack([part[c].to_numpy() for c in CORNERS], 1)
                p = made["corners"].astype(np.float64).reshape(-1, 3, 3)
                normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
                made["normal"] = normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-30)
                out.write(made.tobytes())
        if out:
            out.close()
        return staged.Written(folder, names)

    def commit(self, messages) -> None:
        staged.publish(self.path, self.staging, messages, self.overwrite)

    def abort(self, messages) -> None:
        staged.drop(self.staging)


class StlSource(DataSource):
    """``spark.read.format("stl").load(folder)``: triangles of all STL files under a folder, and a row with ``error`` for each that is none.

    Option ``trianglesPerTask`` (200,000) bounds what a task reads of a binary
    file; a text file is read by one task. A path that isn't there raises
    ``FileNotFoundError``; an empty folder has no rows. Corners are 32-bit numbers.
    """

    @classmethod
    def name(cls) -> str:
        return "stl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StlReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return StlWriter(self.options, overwrite)


def read_stl(spark: SparkSession, path: str, triangles_per_task: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Triangles of all meshes under ``path``, and ``object_id, error`` of the files that aren't meshes."""
    spark.dataSource.register(StlSource)
    rows = spark.read.format("stl").option("trianglesPerTask", triangles_per_task).load(path)
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("object_id", "error")


def write_stl(triangles: DataFrame, path: str) -> None:
    """``triangles(object_id, face_id, ax .. cz)`` as ``OBJECT.stl``, binary, in order of ``face_id``; all files appear together."""
    triangles.sparkSession.dataSource.register(StlSource)
    counts = triangles.groupBy(F.col("object_id").alias("_id")).agg(F.count("*").cast("int").alias("n_faces"))
    rows = triangles.join(counts, F.col("object_id") == F.col("_id")).select("object_id", "n_faces", "face_id", *[F.col(c).cast("double").alias(c) for c in CORNERS])
    rows.repartition("object_id").sortWithinPartitions("object_id", "face_id").write.format("stl").mode("overwrite").save(path)
