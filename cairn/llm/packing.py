"""Harmonic packing of token sequences, each task on its own."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import table
from .tokens import Texts, slices

#: Sequences of a task have numbers of their own, up to 2 ** 32.
_TASK = 1 << 32


@lru_cache(maxsize=8)
def shelf_sizes(capacity: int) -> np.ndarray:
    """Lengths of pieces that fill bins: ``capacity // k`` for every ``k``, ascending."""
    return np.unique(capacity // np.arange(1, capacity + 1))


def pieces_of(length: int, capacity: int, slack: float = 1 / 32) -> list[int]:
    """Lengths of the pieces that a document of ``length`` tokens is cut into.

    A piece of ``capacity // k`` tokens belongs to class ``k``, of which ``k``
    fill a bin. Full bins are cut off first. What is left stays whole if it is
    within ``slack`` of a class's length; else the longest class that fits is
    cut off it, and so on with the rest, which shrinks faster than it is halved.
    """
    sizes = shelf_sizes(capacity)
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        at = int(np.searchsorted(sizes, rest))  # the shortest class that holds it
        if sizes[at] - rest <= slack * sizes[at]:
            out.append(rest)
            break
        out.append(int(sizes[at - 1]))
        rest -= out[-1]
    return out


class Bins:
    """Open bins of one task, one a class, of pieces ``(document, its tokens, start, ids)``; ``add`` returns a bin once it is full.

    At most one open bin a class is held: ``capacity`` tokens for each of the
    about ``2 * sqrt(capacity)`` classes, whatever the input.
    """

    def __init__(self, capacity: int):
        self.capacity, self.sizes, self.open = capacity, shelf_sizes(capacity).tolist(), {}

    def add(self, piece: tuple) -> list[tuple] | None:
        size = self.sizes[bisect_left(self.sizes, len(piece[3]))]
        bin_ = self.open.setdefault(size, [])
        bin_.append(piece)
        return self.open.pop(size) if len(bin_) == self.capacity // size else None

    def rest(self) -> Iterator[list[tuple]]:
        """The pieces of bins that stayed open, longest first, cut again into full bins and at last into bins of powers of two."""
        line = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        self.open = {}
        left = sum(len(p[3]) for p in line)
        room, bin_ = 0, []
        for doc, total, start, ids in line:
            while len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                take = min(room, len(ids))
                bin_.append((doc, total, start, ids[:take]))
                ids, start, room, left = ids[take:], start + take, room - take, left - take
                if not room:
                    yield bin_
                    bin_ = []


PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PIECES = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in PIECES_DDL.split(", "))])


def _packer(path: str, capacity: int, end: int, slack: float):
    def run(batches):
        from pyspark import TaskContext

        texts, bins, last = Texts(path), Bins(capacity), np.uint32(end)
        number = TaskContext.get().partitionId() * _TASK
        rows = []

        def close(bin_):
            nonlocal number
            offset = 0
            for doc, total, start, ids in bin_:
                rows.append((doc, start, len(ids), ids.tobytes(), total, number, offset))
                offset += len(ids)
            number += 1

        def out():
            columns = zip(*rows) if rows else [()] * len(PIECES)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)
            rows.clear()
            return made

        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = texts.ids(part.column(1))
                ends = np.cumsum(counts)
                for doc, a, b in zip(part.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    ids = np.append(flat[a:b], last)
                    start = 0
                    for length in pieces_of(len(ids), capacity, slack):
                        full = bins.add((doc, len(ids), start, ids[start : start + length].copy()))
                        if full:
                            close(full)
                        start += length
                    if len(rows) > 5_000:
                        yield out()
        for bin_ in bins.rest():
            close(bin_)
        yield out()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 0, slack: float = 1 / 32) -> DataFrame:
    """Pack all ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    Returns a row a piece: ``doc_id``, ``start`` (tokens of its document before
    it), ``length``, ``ids`` (unsigned 32-bit, little-endian), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in it, gapless from 0. A document's ids are
    those of its text by ``tokenizer`` (a tokenizers file with byte-level BPE;
    strings of its special tokens count as those), with ``end`` behind them.

    Every task fills bins of its own: documents are cut into pieces whose
    lengths fall in reciprocal classes (see ``pieces_of``) and bins of class
    ``k`` close with ``k`` pieces. There is no exchange, and a hot source or a
    very long document changes nothing. What a task has left is less than a
    bin a class and is cut into full bins and bins of powers of two, which
    need no padding.

    Null and empty texts are the one token ``end``. Repeated rows, also of the
    same id, are packed one by one; a null id stays null. An empty table gives
    an empty result. Other columns are not read. Which pieces share a sequence
    depends on how rows are dealt to tasks; a task run again gives the same.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_packer(tokenizer, capacity, end, slack), PIECES_DDL)


def sequences(pieces: DataFrame, capacity: int = 1024, pad: int = 0) -> DataFrame:
    """The sequences of ``pack``: ``sequence_id, n_tokens, ids, starts, docs``.

    ``ids`` is padded with ``pad`` to ``capacity``, but not at a power of two;
    ``starts`` are the offsets of the pieces and ``docs`` their documents, for
    attention within documents. A group has ``capacity`` pieces at most.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    padding = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(capacity - F.col("n_tokens")).cast("int")
    blank = F.unhex(F.repeat(F.lit(pad.to_bytes(4, "little").hex()), padding))
    return rows.select("sequence_id", "n_tokens", F.concat(whole, blank).alias("ids"), F.col("p.offset").alias("starts"), F.col("p.doc_id").alias("docs"))


def packing_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
