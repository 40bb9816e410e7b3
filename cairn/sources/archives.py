"""Ray and distance-map archives (``.npz``) as a Spark data source with commits and pushdown."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from cairn.sources import staged, store

RAYS = "level int, hash string, ray_id int, ox float, oy float, oz float, dx float, dy float, dz float, distance float, hit int, face_id int, view_id int, error string"
MAPS = "object_id string, view_id int, row int, col int, distance float, hit int, error string"
_ARROW = {"int": pa.int32(), "string": pa.string(), "float": pa.float32()}
#: How a kind's files are named: key columns from the path, the part of a content beyond the first, and the schema.
KINDS = {
    "rays": (re.compile(r"(?:^|/)level_(?P<level>\d+)/[^/]*/(?P<hash>[^/]+?)_rays(?:-(?P<part>\d+))?\.npz$"), RAYS),
    "maps": (re.compile(r"(?:^|/)(?P<object_id>[^/]+)/view_(?P<view_id>\d+)(?:-(?P<part>\d+))?\.npz$"), MAPS),
}


#: Bundles, each of which holds many contents (or images): where they are, the columns that tell those apart, and rows up to which one is filled.
BUNDLES = {"rays": (re.compile(r"(?:^|/)level_(?P<level>\d+)/bundles/[^/]+_rays\.npz$"), ["hash"]), "maps": (re.compile(r"(?:^|/)bundles/[^/]+_maps\.npz$"), ["object_id", "view_id"])}
BUNDLED = 1 << 18


def _schema(kind: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in KINDS[kind][1].split(", "))])


class Archives(InputPartition):
    def __init__(self, found: list[tuple[str, dict]]):
        self.found = found


def _told_apart(held, names: list[str]) -> dict:
    """The columns ``names`` of a bundle, which has a value and a count for each run of rows."""
    return {c: np.repeat(held[f"of_{c}"], held["counts"]) for c in names}


def _rays(data: bytes, key: dict) -> dict:
    held = np.load(io.BytesIO(data))
    n = len(held["distances"])
    o, d = held["origins"].reshape(n, 3), held["directions"].reshape(n, 3)
    ids = held["ray_ids"] if "ray_ids" in held.files else np.arange(n)
    extra = {c: held[k] if k in held.files else np.full(n, -1) for c, k in (("hit", "hits"), ("face_id", "face_ids"), ("view_id", "view_ids"))}
    if "counts" in held.files:
        extra |= _told_apart(held, ["hash"])
    return key | {"ray_id": ids, "distance": held["distances"]} | {f"{p}{a}": v[:, i] for p, v in (("o", o), ("d", d)) for i, a in enumerate("xyz")} | extra


def _maps(data: bytes, key: dict) -> dict:
    held = np.load(io.BytesIO(data))
    if "counts" in held.files:
        return {"row": held["rows"], "col": held["cols"], "distance": held["distances"], "hit": held["hits"]} | _told_apart(held, ["object_id", "view_id"])
    row, col = np.indices(held["distances"].shape).reshape(2, -1)
    first = int(held["first_row"]) if "first_row" in held.files else 0
    seen = held["seen"].reshape(-1).astype(bool) if "seen" in held.files else np.ones(len(row), bool)
    flat = {"row": row + first, "col": col, "distance": held["distances"].reshape(-1), "hit": held["hits"].reshape(-1)}
    return key | {k: v[seen] for k, v in flat.items()}


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options["kind"]
        self.most = int(options.get("bytesPerTask", 64 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities on the columns that paths tell are taken over; files of other keys are never opened."""
        keys = [k for k in KINDS[self.kind][0].groupindex if k != "part"]
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in keys:
                yield f
            else:
                old = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if old is None else values & old

    def partitions(self) -> list[Archives]:
        pattern, _ = KINDS[self.kind]
        roots = [self.path]
        if self.kind == "rays" and "level" in self.wanted:  # other levels aren't even listed
            store.files(self.path, ("/",))  # raises if the path isn't there
            roots = [f"{self.path.rstrip('/')}/level_{n}" for n in sorted(self.wanted["level"])]
        out, now, size = [], [], 0
        for uri, n in (f for r in roots for f in store.files(r, (".npz",), missing_ok=r != self.path)):
            named = BUNDLES[self.kind][0].search(uri) or pattern.search(uri)
            if not named:
                continue
            key = {k: int(v) if k in ("level", "view_id") else v for k, v in named.groupdict().items() if k != "part"}
            if any(key[k] not in v for k, v in self.wanted.items() if k in key):
                continue
            if now and size + n > self.most:
                out, now, size = [*out, Archives(now)], [], 0
            now.append((uri, key))
            size += n
        return [*out, Archives(now)]

    def read(self, part: Archives) -> Iterator[pa.RecordBatch]:
        schema = _schema(self.kind)
        for uri, key in part.found:
            try:
                with store.reader(uri) as f:
                    columns = (_rays if self.kind == "rays" else _maps)(f.read(), key)
                n, error = len(columns["distance"]), None
            except (OSError, ValueError, KeyError, EOFError, IndexError, zipfile.BadZipFile) as e:
                columns, n, error = dict(key), 1, f"{type(e).__name__}: {e}"
            full = [pa.array([columns[f.name]] * n, f.type) if f.name in key else pa.array([error] * n, f.type) if f.name == "error" else pa.array(np.asarray(columns[f.name]), f.type, safe=False) if error is None else pa.nulls(n, f.type) for f in schema]
            rows = pa.RecordBatch.from_arrays(full, schema=schema)
            for k in self.wanted.keys() - key.keys():  # what a bundle's path doesn't tell; as a null is no value, errors stay out
                rows = rows.filter(pc.is_in(rows[k], pa.array([v for v in self.wanted[k] if v is not None], schema.field(k).type)))
            yield rows


class ArchiveWriter(DataSourceArrowWriter):
    """A file for each key and part, whose rows come together, or bundles of up to ``BUNDLED`` rows of any keys; a job's files appear when all of its tasks have ended."""

    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options["kind"], overwrite
        self.bundled = options.get("bundled", "false") == "true"
        self.staging = staged.new_staging(self.path)

    def write(self, iterator) -> WriterCommitMessage:
        key = ["level", "hash", "part"] if self.kind == "rays" else ["object_id", "view_id", "part"]
        folder, names, held = staged.attempt(self.staging), [], []
        if self.bundled:
            return self._bundles(iterator, folder)

        def flush():
            rows = pa.concat_tables(held)
            held.clear()
            first, second, part = (rows[k][0].as_py() for k in key)
            more = f"-{part:04d}" if part else ""
            if self.kind == "rays":
                name, data = f"level_{first}/{second[:2]}/{second}_rays{more}.npz", _packed_rays(rows)
            else:
                name, data = f"{first}/view_{second:03d}{more}.npz", _packed_maps(rows)
            store.put(f"{folder}/{name}", data)
            names.append(name)

        for batch in iterator:
            rows = pa.Table.from_batches([batch])
            for at, n in staged.spans(rows, key):
                part = rows.slice(at, n)
                if held and any(held[-1][k][0] != part[k][0] for k in key):
                    flush()
                held.append(part)
        if held:
            flush()
        return staged.Written(folder, names)

    def _bundles(self, iterator, folder: str) -> WriterCommitMessage:
        from pyspark import TaskContext

        names, held, size, task = [], [], 0, TaskContext.get().partitionId()
        of = BUNDLES[self.kind][1]

        def flush():
            nonlocal size
            rows = pa.concat_tables(held)
            held.clear()
            size = 0
            for at, n in staged.spans(rows, ["level"]) if self.kind == "rays" else [(0, rows.num_rows)]:
                part = rows.slice(at, n)
                runs = staged.spans(part, of)
                starts = [s for s, _ in runs]
                apart = {f"of_{c}": np.array(part[c].take(pa.array(starts)).to_pylist()) for c in of} | {"counts": np.array([k for _, k in runs])}
                top = f"level_{part['level'][0].as_py()}/" if self.kind == "rays" else ""
                name = f"{top}bundles/{task:06d}-{len(names):04d}_{self.kind}.npz"
                store.put(f"{folder}/{name}", _packed_rays(part, **apart) if self.kind == "rays" else _packed_pixels(part, **apart))
                names.append(name)

        for batch in iterator:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= BUNDLED:
                flush()
        if size:
            flush()
        return staged.Written(folder, names)

    def commit(self, messages) -> None:
        staged.publish(self.path, self.staging, messages, self.overwrite)

    def abort(self, messages) -> None:
        staged.drop(self.staging)


def _packed_rays(rows: pa.Table, **more: np.ndarray) -> bytes:
    xyz = lambda p: np.stack([rows[f"{p}{a}"].to_numpy().astype(np.float32) for a in "xyz"], 1)
    whole = lambda c: rows[c].to_numpy().astype(np.int32)
    return store.npz(ray_ids=whole("ray_id"), origins=xyz("o"), directions=xyz("d"), distances=rows["distance"].to_numpy().astype(np.float32), hits=whole("hit"), face_ids=whole("face_id"), view_ids=whole("view_id"), **more)


def _packed_pixels(rows: pa.Table, **more: np.ndarray) -> bytes:
    columns = {n: rows[c].to_numpy().astype(t) for n, c, t in (("rows", "row", np.int32), ("cols", "col", np.int32), ("distances", "distance", np.float32), ("hits", "hit", np.int32))}
    return store.npz(**columns, **more)


def _packed_maps(rows: pa.Table) -> bytes:
    row, col = rows["row"].to_numpy(), rows["col"].to_numpy()
    first = int(row.min())
    shape = (int(row.max()) - first + 1, int(col.max()) + 1)
    distance, hit, seen = np.zeros(shape, np.float32), np.zeros(shape, np.uint8), np.zeros(shape, bool)
    distance[row - first, col], hit[row - first, col], seen[row - first, col] = rows["distance"].to_numpy(), rows["hit"].to_numpy(), True
    return store.npz(distances=distance, hits=hit, first_row=np.int64(first), seen=seen)


class ArchiveSource(DataSource):
    """``spark.read.format("npz_archives").option("kind", "rays").load(folder)``, or kind ``maps``.

    Equalities on level and hash (object and view) are taken over and decide by
    names which files are opened. An archive that can't be read is a row with
    its key and ``error``; a path that isn't there raises ``FileNotFoundError``.
    """

    @classmethod
    def name(cls) -> str:
        return "npz_archives"

    def schema(self) -> str:
        return KINDS[self.options["kind"]][1]

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known; its reader takes filters over, which Spark refuses unless the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All rows of the archives of a kind, with ``error`` for those that can't be read."""
    register(spark)
    return spark.read.format("npz_archives").option("kind", kind).load(path)


def write_rays(rays: DataFrame, path: str, most: int = 1_000_000, bundled: bool = False) -> None:
    """Rays of each content as ``level_L/xx/HASH_rays.npz``, in order of ``ray_id``, in place of what was there.

    A content of over ``most`` ray ids goes on in ``HASH_rays-0001.npz`` and so
    on, so a popular one spreads over tasks. Files are moved to their names
    once all tasks have succeeded; an aborted job leaves none.

    Where contents have few rays each, a file for each is mostly block and
    headers, and a driver that lists them holds as many names as there are
    contents. ``bundled`` writes ``level_L/bundles/*_rays.npz`` instead, with
    the rays of many contents in each, where they were dealt; readers take both.
    """
    parts = rays.withColumn("part", F.floor(F.col("ray_id") / most).cast("int"))
    _save(parts, ["level", "hash", "part"], ["ray_id"], "rays", path, bundled)


def write_distance_maps(maps: DataFrame, path: str, most: int = 4096, bundled: bool = False) -> None:
    """``object_id, view_id, row, col, distance, hit`` as ``OBJECT/view_NNN.npz``; images of over ``most`` rows go on in further files.

    ``bundled`` writes ``bundles/*_maps.npz`` with the pixels of many images in each (see ``write_rays``).
    """
    parts = maps.withColumn("part", F.floor(F.col("row") / most).cast("int"))
    _save(parts, ["object_id", "view_id", "part"], ["row", "col"], "maps", path, bundled)


def _save(rows: DataFrame, key: list[str], order: list[str], kind: str, path: str, bundled: bool) -> None:
    register(rows.sparkSession)
    dealt = (rows if bundled else rows.repartition(*key)).sortWithinPartitions(*key, *order)
    dealt.write.format("npz_archives").option("kind", kind).option("bundled", str(bundled).lower()).mode("overwrite").save(path)
