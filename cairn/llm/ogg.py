"""Media columns: payloads stored in Ogg and read back."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, table

RATE = 8000
PACKET = 4096
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = "<4sBBqIIIB"
_HEAD_SIZE = struct.calcsize(_HEAD)
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7, most significant bit first, from 0.

    It is the mirror image of zlib's checksum over mirrored bytes, which runs
    at C speed.
    """
    low = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{low:032b}"[::-1], 2)


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(_HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_crc(head + body)) + head[26:] + body


def paginate(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream from its packets and their end granules.

    The first packet has a page of its own. A packet may run over several
    pages; a page on which none ends has granule -1.
    """
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), -1, FIRST

    def flush(more: int) -> None:
        nonlocal granule, flags
        pages.append(_page(serial, len(pages), flags | more, granule, bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule, flags = -1, 0

    for k, (packet, end) in enumerate(packets):
        at = 0
        while True:
            if len(lacing) == 255:
                flush(0)
                flags = CONTINUED if at else 0
            piece = packet[at : at + 255]
            lacing.append(len(piece))
            body += piece
            at += len(piece)
            if len(piece) < 255:
                break
        granule = end
        if k == len(packets) - 1:
            flush(LAST)
        elif k == 0:
            flush(0)
    return pages


def encode(payload: bytes, note: bytes = b"") -> bytes:
    """A two-stream Ogg file: ``payload`` as 8-bit mono samples, and a text stream holding ``note``."""
    serial = zlib.crc32(payload)
    other = serial ^ 0x5A5A5A5A
    head = b"\x01pcm8" + struct.pack("<IBQ", RATE, 1, len(payload))
    sound = [(head, 0)] + [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    a, b = paginate(sound, serial), paginate([(b"\x01note", 0), (note, 1)], other)
    return b"".join([a[0], b[0], b[1], *a[1:]])


def decode(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Logical streams of an Ogg file: serial -> packets, the last that ends on each page with the page's granule, others with -1.

    Raises ``ValueError`` for a wrong capture pattern, checksum, page order or
    continuation, granules that fall or are missing, and a stream without its
    last page.
    """
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_packets: dict[int, bytearray] = {}
    numbers: dict[int, int] = {}
    granules: dict[int, int] = {}
    ended: set[int] = set()
    view, at = memoryview(media), 0
    while at < len(media):
        if len(media) - at < _HEAD_SIZE:
            raise ValueError("a page is cut short")
        mark, version, flags, granule, serial, number, crc, n = struct.unpack_from(_HEAD, media, at)
        if mark != b"OggS" or version:
            raise ValueError("no page where one is due")
        lacing = view[at + _HEAD_SIZE : at + _HEAD_SIZE + n]
        start = at + _HEAD_SIZE + n
        end = start + sum(lacing)
        page = bytes(view[at:end])
        if end > len(media) or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("wrong checksum")
        if number != numbers.get(serial, -1) + 1 or (number == 0) != bool(flags & FIRST):
            raise ValueError("a page is missing")
        if serial in ended:
            raise ValueError("a page after the last of its stream")
        if flags & LAST:
            ended.add(serial)
        numbers[serial] = number
        held = open_packets.setdefault(serial, bytearray())
        if bool(flags & CONTINUED) != bool(held):
            raise ValueError("a packet is cut short")
        packets = streams.setdefault(serial, [])
        known = len(packets)
        for size in lacing:
            held += view[start : start + size]
            start += size
            if size < 255:
                packets.append((bytes(held), -1))
                held.clear()
        if (len(packets) > known) != (granule >= 0):
            raise ValueError("a granule is missing or stands where no packet ends")
        if len(packets) > known:
            if granule < granules.get(serial, 0):
                raise ValueError("granules fall")
            granules[serial] = granule
            packets[-1] = (packets[-1][0], granule)
        at = end
    if any(open_packets.values()):
        raise ValueError("a packet is cut short")
    if streams.keys() != ended:
        raise ValueError("a stream has no last page")
    return streams


def packet_ends(packets: list[tuple[bytes, int]], length) -> list[int]:
    """The granule at which each packet ends, counted back from its page's by ``length(packet)``.

    Raises ``ValueError`` where a page's packets don't begin where the one
    before ends.
    """
    ends, end = [0] * len(packets), None
    for i in range(len(packets) - 1, -1, -1):
        packet, granule = packets[i]
        if granule >= 0:
            if end is not None and end != granule:
                raise ValueError("granules don't fit their packets")
            end = granule
        ends[i] = end
        end -= length(packet)
    if end:
        raise ValueError("granules don't fit their packets")
    return ends


def samples(streams: dict[int, list[tuple[bytes, int]]]) -> tuple[bytes, float]:
    """Payload of the sound stream and its duration in seconds by its last granule, which the packets' lengths must bear out."""
    for packets in streams.values():
        head = packets[0][0]
        if head.startswith(b"\x01pcm8"):
            rate, _, size = struct.unpack_from("<IBQ", head, 5)
            data = b"".join(p for p, _ in packets[1:])
            if len(data) != size:
                raise ValueError("samples are missing")
            return data, packet_ends(packets[1:], len)[-1] / rate
    raise ValueError("no sound stream")


def _feature(media: bytes, streams, data: bytes, seconds: float) -> str:
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    crossings = int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())
    packets = sum(len(p) for p in streams.values())
    sound = next(p for p in streams.values() if p[0][0].startswith(b"\x01pcm8"))
    ends = packet_ends(sound[1:], len)
    middle = ends[(len(ends) - 1) // 2] * 1000 // RATE
    return f"streams={len(streams)};packets={packets};ms={round(1000 * seconds)};middle_ms={middle};sum={int(x.sum())};squares={int((x * x).sum())};crossings={crossings}"


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text, padded to a multiple of 64 bytes, as an Ogg file."""

    def run(batches):
        for batch in batches:
            ids, sizes, files, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(doc_id)
                sizes.append(len(raw))
                files.append(encode(raw + b"\0" * ((-len(raw)) % 64 if raw else 64), b"bytes=%d" % len(raw)))
                held += len(files[-1])
                if held > 16 << 20:
                    yield _batch(ids, sizes, files)
                    ids, sizes, files, held = [], [], [], 0
            yield _batch(ids, sizes, files)

    def _batch(ids, sizes, files):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def inspect(stored: DataFrame) -> DataFrame:
    """Digests and features of stored Ogg files, from their bytes alone."""
    names = [c.split()[0] for c in READ.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = media.as_py()
                streams = decode(media)
                data, seconds = samples(streams)
                rows.append(
                    (doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), _feature(media, streams, data, seconds))
                )
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return stored.mapInArrow(run, READ)


def media_roundtrip(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` as Ogg in the shared folder, read the bytes back and describe them.

    Null texts count as empty; an empty text is 64 zero bytes. Equal texts have
    equal files. Repeated rows and ids stay apart; an empty table gives an
    empty result; a damaged file raises an error.
    """
    return inspect(materialize(store(docs), "ogg"))


def ogg_query(spark, sf_dir: str) -> DataFrame:
    return media_roundtrip(table(spark, sf_dir, "documents"))
