"""WARC archives as a PySpark Python data source, read and written."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .runtime import materialize, new_path, table

FIELDS = (
    "page_id long, record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)
#: Columns whose predicates are decided on a record's headers alone.
HEADER_COLUMNS = ("page_id", "record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _lists(fs, path: str) -> list[str]:
    """The lists of committed archives under ``path``."""
    from pyarrow import fs as pfs

    found = fs.get_file_info(pfs.FileSelector(path, allow_not_found=True))
    return sorted(i.path for i in found if i.base_name.startswith("_committed-"))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    """One gzip member whose header tells its packed and plain length (subfield ``sl``), so readers can skip it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id, url, payload: bytes, digest: str, record_type: str, refers_to, date: str) -> bytes:
    """A WARC/1.1 record. A revisit's block has the HTTP headers but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if record_type == "response" else b"")
    head = {
        "WARC-Type": record_type,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}#{page_id}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": PROFILE if record_type == "revisit" else None,
        "X-Page-Id": page_id,
        "X-Refers-To-Page-Id": refers_to,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


class _File:
    """Bytes of an archive, buffered by 64 KB, with skipping that doesn't read."""

    def __init__(self, source):
        self.source, self.data = source, b""

    def peek(self, n: int) -> bytes:
        while len(self.data) < n and (more := self.source.read(max(n - len(self.data), 1 << 16))):
            self.data += more
        return self.data[:n]

    def skip(self, n: int) -> None:
        held = min(n, len(self.data))
        self.data = self.data[held:]
        if n > held:
            self.source.seek(self.source.tell() + n - held)


def read_records(source, wanted, payloads: bool):
    """``(headers, payload or None, payload length)`` of the records whose headers ``wanted`` accepts.

    Headers are read first; the rest of a record only if its payload is needed.
    Plain records and members that tell their packed length are skipped without
    being read; other members are inflated to find their end.
    """
    file = _File(source)
    while len(head := file.peek(24)) >= 12:
        if head[:5] == b"WARC/":
            yield from _plain_record(file, wanted, payloads)
            continue
        if head[:2] != b"\x1f\x8b":
            raise ValueError("neither a gzip member nor a record")
        size = struct.unpack_from("<I", head, 16)[0] if head[3] == 4 and head[10:16] == b"\x0c\0sl\x08\0" else None
        packer = zlib.decompressobj(31)
        if size is not None:
            fed, plain = 0, b""  # both heads, the record's and that of its HTTP message, or all there is
            while plain.count(b"\r\n\r\n") < 2 and fed < size and not packer.eof:
                part = packer.unconsumed_tail
                if not part:
                    part = file.peek(min(size, fed + 1024))[fed:]
                    if not part:
                        raise ValueError("a member is cut short")
                    fed += len(part)
                plain += packer.decompress(part, 2048)
        else:
            plain = b""
            while not packer.eof:
                packed = file.peek(1 << 16)
                if not packed:
                    raise ValueError("a member is cut short")
                plain += packer.decompress(packed)
                file.skip(len(packed) - len(packer.unused_data))
        head_end = plain.find(b"\r\n\r\n")
        headers = parse_headers(plain[:head_end])
        if wanted(headers):
            http = plain.find(b"\r\n\r\n", head_end + 4)
            full = payloads and headers.get("warc-type") == "response"
            if size is not None and (full or http < 0):
                packed = file.peek(size)
                if len(packed) < size:
                    raise ValueError("a member is cut short")
                plain += packer.decompress(packer.unconsumed_tail + packed[fed:]) + packer.flush()
                http = plain.find(b"\r\n\r\n", head_end + 4)
            block = plain[head_end + 4 : head_end + 4 + int(headers["content-length"])]
            length = parse_headers(plain[head_end + 4 : http]).get("content-length")
            yield headers, block[http - head_end :] if full else None, int(length) if length else None
        if size is not None:
            file.skip(size)


def _plain_record(file: _File, wanted, payloads: bool):
    """The record at the start of ``file``, which is left after it."""
    n = 1024
    while (head_end := file.peek(n).find(b"\r\n\r\n")) < 0:
        if len(file.peek(n)) < n:
            raise ValueError("a record is cut short")
        n *= 2
    headers = parse_headers(file.peek(head_end))
    file.skip(head_end + 4)
    size = int(headers["content-length"])
    if wanted(headers):
        full = payloads and headers.get("warc-type") == "response"
        n = size if full else min(size, 1024)
        while (http := file.peek(n).find(b"\r\n\r\n")) < 0 and n < size:
            n = min(size, 2 * n)
        if full and len(file.peek(size)) < size:
            raise ValueError("a record is cut short")
        length = parse_headers(file.peek(max(http, 0))).get("content-length")
        yield headers, file.peek(size)[http + 4 :] if full else None, int(length) if length else None
    file.skip(size + 4)


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    """One task for each archive; only the asked columns are made.

    Equality, membership and prefix predicates on header columns are taken
    over from Spark and decided before anything but a record's headers is
    inflated.
    """

    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.schema, self.uri, self.tests = schema, options["path"], []
        self.check = options.get("verify", "true") == "true"

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_COLUMNS and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((name, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        fs, path = _filesystem(self.uri)
        from pyarrow import fs as pfs

        if fs.get_file_info(path).type == pfs.FileType.File:
            names = [path]
        elif lists := _lists(fs, path):
            names = []
            for one in lists:
                with fs.open_input_stream(one) as f:
                    names += [f"{path}/{n}" for n in json.loads(f.read())]
        else:
            names = sorted(i.path for i in fs.get_file_info(pfs.FileSelector(path, recursive=True)) if i.path.endswith((".warc.gz", ".warc")))
        return [Archive(n) for n in names] or [Archive("")]

    @staticmethod
    def _columns(headers: dict[str, str]) -> dict:
        digest = headers.get("warc-payload-digest")
        number = lambda v: None if v is None else int(v)
        return {
            "page_id": number(headers.get("x-page-id")),
            "record_type": headers.get("warc-type"),
            "record_id": headers.get("warc-record-id"),
            "target_uri": headers.get("warc-target-uri"),
            "date": headers.get("warc-date"),
            "payload_digest": digest and digest.removeprefix("sha1:"),
            "refers_to": number(headers.get("x-refers-to-page-id")),
        }

    def _passes(self, headers: dict[str, str]) -> bool:
        if not self.tests:
            return True
        row = self._columns(headers)
        for name, kind, value in self.tests:
            x = row[name]
            if x is None or not (x == value if kind == "EqualTo" else x in value if kind == "In" else x.startswith(value)):
                return False
        return True

    def read(self, partition):
        if not partition.path:
            return
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}
        arrow = pa.schema([(f.name, kinds.get(f.dataType.simpleString(), pa.string())) for f in self.schema.fields])
        payloads = "payload" in self.names or self.check and bool({"payload_digest", "payload_bytes"} & {*self.names})
        rows, held = [], 0
        fs, _ = _filesystem(self.uri)
        with fs.open_input_file(partition.path) as source:
            for headers, payload, length in read_records(source, self._passes, payloads):
                row = self._columns(headers) | {"payload": payload, "payload_bytes": length}
                if payload is not None and self.check and (len(payload) != length or sha1_base32(payload) != row["payload_digest"]):
                    raise ValueError(f"payload of {row['record_id']} doesn't match its digest")
                rows.append({n: row[n] for n in self.names})
                held += len(payload or b"") * ("payload" in self.names) + 200
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Every task writes archives of at most about 64 MB; only those of tasks that committed are listed.

    Each write has a list of its own, so appending keeps what is there;
    overwriting takes the former lists away and then their archives.
    """

    def __init__(self, options, overwrite: bool = False):
        self.overwrite = overwrite
        self.uri, self.date = options["path"], options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator):
        fs, path = _filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                data = _member(record(r["page_id"], r["target_uri"], r["payload"], r["payload_digest"], r["record_type"], r["refers_to"], self.date))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        fs, path = _filesystem(self.uri)
        fs.create_dir(path, recursive=True)
        former = _lists(fs, path) if self.overwrite else []
        with fs.open_output_stream(f"{path}/_committed-{uuid.uuid4().hex}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for one in former:
            with fs.open_input_stream(one) as f:
                names = json.loads(f.read())
            fs.delete_file(one)
            for n in names:
                fs.delete_file(f"{path}/{n}")

    def abort(self, messages):
        pass  # files of failed attempts are in no list


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return FIELDS

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, schema: str = FIELDS, verify: bool = True) -> DataFrame:
    """Records of the archives under ``path``.

    Leave ``payload`` out of ``schema`` to skip decoding payloads; with
    ``verify`` those of responses are still checked against their digests if
    length or digest is asked for.
    """
    register(spark)
    return spark.read.format("warc").schema(schema).option("verify", str(verify).lower()).load(path)


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """The columns of WARC records for ``pages(page_id, url, html)``.

    A null ``html`` is an empty payload. Of equal payloads of ``least`` or more
    bytes, the rows with the largest ``page_id`` become responses (all of them,
    if rows repeat; all rows, if all ids are null) and the others revisit it; a
    null id counts as smallest.
    """
    body = F.coalesce(pages["html"].cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    top = (
        rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    )
    top = materialize(top, "repeated")  # a plain table, so that skew in the join can be split
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.join(top, "digest", "left").select(
        "page_id",
        "target_uri",
        "payload",
        F.col("digest").alias("sha1"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("top")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write one record for each row of ``pages``, see ``plan_records``; an empty table gives no archive."""
    register(pages.sparkSession)

    def digests(batches):
        for b in batches:
            hexes = b.column(b.schema.get_field_index("sha1")).to_pylist()
            base32 = pa.array([base64.b32encode(bytes.fromhex(h)).decode() for h in hexes], pa.string())
            names = [n for n in b.schema.names if n != "sha1"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), base32], names=[*names, "payload_digest"])

    schema = "page_id long, target_uri string, payload binary, record_type string, refers_to long, payload_digest string"
    plan_records(pages, least).mapInArrow(digests, schema).write.format("warc").mode("append").save(path)


def warc_query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
