"""Alignment of two tokenizers: minimal groups of tokens over the same bytes, and how often tokens of both end together."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, table
from .tokens import byte_bpe, containing, cut, encoded, gather, sentence_pieces, slices, unpadded


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each of ``n`` nodes' component, over edges ``u - v``.

    All roots that an edge joins are hooked to the lesser one at once and
    paths are halved until they end, so rounds grow with the logarithm of a component.
    """
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def grouped(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of two tilings of the same bytes by tokens of these sizes.

    Returns the group of each A token and of each B token, numbered in order,
    and the links, as positions of A and of B tokens. Tokens that overlap are
    joined; the components are the minimal groups, since a border of both
    tilings is overlapped by nothing. Links are the pairs of a component's
    members that end together.
    """
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    low = np.searchsorted(b_ends, a_ends - a_sizes, "right")
    counts = np.searchsorted(b_ends - b_sizes, a_ends, "left") - low
    n = len(a_sizes)
    u = np.repeat(np.arange(n), counts)
    v = np.arange(counts.sum()) + np.repeat(low - (np.cumsum(counts) - counts), counts)
    roots = union_find(n + len(b_sizes), u, v + n)
    number = np.cumsum(roots[:n] == np.arange(n)) - 1  # the least member of every component is an A token
    together = a_ends[u] == b_ends[v]
    return number[roots[:n]], number[roots[n:]], u[together], v[together]


def _flat(content: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(c) for c in content], np.int64)
    return np.frombuffer(b"".join(content), np.uint8), np.cumsum(sizes) - sizes, sizes


class Aligner:
    """Aligns byte-level BPE (A) with sentence pieces (B), unit by unit: at a unit's border tokens of both end."""

    def __init__(self, a_path: str, b_path: str):
        self.a, a_content, _ = byte_bpe(a_path)
        self.b, b_content = sentence_pieces(b_path)
        self.a_bytes, self.b_bytes = _flat(a_content), _flat(b_content)
        self.digits = _flat([str(i).encode() for i in range(max(len(a_content), len(b_content)))])
        self.pair = pair_type(len(a_content), len(b_content))

    def _ids(self, units: pa.Array, encode, of: tuple, alone=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in the order of units, how many each has, and which units they spell out."""
        flat, starts, sizes = encoded(units, encode, of[2], alone)
        ids = gather(flat, starts, sizes)
        ends = np.concatenate(([0], np.cumsum(of[2][ids])))[np.concatenate(([0], np.cumsum(sizes)))]
        whole, bounds = unpadded(units)
        lengths = np.diff(bounds)
        right = np.diff(ends) == lengths
        spelt = gather(of[0], of[1][ids], of[2][ids])
        if not right.all():
            spelt, whole = spelt[np.repeat(right, np.diff(ends))], whole[np.repeat(right, lengths)]
        wrong = np.flatnonzero(spelt != whole)
        if len(wrong):
            right[np.repeat(np.flatnonzero(right), lengths[right])[wrong]] = False
        return ids, sizes, right

    def _texts(self, a, b, a_group, b_group, a_counts, b_counts) -> list[bytes]:
        """``a1,a2|b1;`` for every group of a unit, joined, for each unit."""
        ids = np.concatenate((a, b))
        group = np.concatenate((a_group, b_group))
        side = np.repeat([0, 1], (len(a), len(b)))
        unit = np.concatenate((np.repeat(np.arange(len(a_counts)), a_counts), np.repeat(np.arange(len(b_counts)), b_counts)))
        order = np.argsort(group * 2 + side, kind="stable")
        ids, part, unit = ids[order], (group * 2 + side)[order], unit[order]
        last = np.append(part[1:] != part[:-1], True)
        mark = np.where(last, np.where(part % 2 == 0, ord("|"), ord(";")), ord(","))
        flat, starts, sizes = self.digits
        out = gather(np.append(flat, np.uint8(0)), starts[ids], sizes[ids] + 1)  # a place more behind each number
        ends = np.cumsum(sizes[ids] + 1)
        out[ends - 1] = mark
        upto = ends[np.cumsum(np.bincount(unit, minlength=len(a_counts))) - 1] if len(ends) else []
        text = out.tobytes()
        return [text[i:j] for i, j in zip([0, *upto[:-1]], upto)]

    def batch(self, texts: pa.Array, as_text: bool):
        """Columns of ``aligned`` but the first, for these texts."""
        units, numbers, counts = cut(texts, spaced=True)
        a, a_counts, a_right = self._ids(units, self.a.encode_ordinary, self.a_bytes)
        b, b_counts, b_right = self._ids(units, lambda t: self.b.encode(t[1:]), self.b_bytes, containing(units, ["▁"]))
        right = a_right & b_right
        a, b = a[np.repeat(right, a_counts)], b[np.repeat(right, b_counts)]
        a_counts, b_counts = a_counts * right, b_counts * right
        a_group, b_group, link_a, link_b = grouped(self.a_bytes[2][a], self.b_bytes[2][b])
        groups = iter(self._texts(a, b, a_group, b_group, a_counts[right], b_counts[right]))
        written = [next(groups) if r else b"" for r in right.tolist()]
        pairs = a[link_a].astype(self.pair) * self.pair.type(len(self.b_bytes[2])) + b[link_b]
        of_unit = np.repeat(np.arange(len(units)), a_counts)[link_a]
        n_pairs = np.bincount(of_unit, minlength=len(units))
        all_right = np.add.reduceat(np.append(~right[numbers], False), np.minimum(np.cumsum(counts) - counts, len(numbers))) == 0 if len(counts) else right
        all_right &= counts > 0
        keep = np.repeat(all_right, counts)
        numbers, counts = numbers[keep], counts * all_right
        spans = np.concatenate(([0], np.cumsum(counts)))

        def total(of):
            return np.diff(np.concatenate(([0], np.cumsum(of[numbers])))[spans])

        n_groups = np.bincount(np.repeat(np.arange(len(units)), a_counts)[np.unique(a_group, return_index=True)[1]], minlength=len(units))
        listed = numbers.tolist()
        out = []
        for lo, hi in zip(spans.tolist(), spans[1:].tolist()):
            whole = b"".join(map(written.__getitem__, listed[lo:hi]))[:-1]
            out.append(whole.decode() if as_text else hashlib.sha256(whole).hexdigest() if whole else "")
        flat = gather(pairs, (np.cumsum(n_pairs) - n_pairs)[numbers], n_pairs[numbers])
        ends = np.concatenate(([0], np.cumsum(total(n_pairs)))).astype(np.int64) * self.pair.itemsize
        links = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary())
        return [pa.array(total(a_counts)), pa.array(total(b_counts)), pa.array(total(n_groups)), pa.array(out, pa.string()), links]


def pair_type(a_size: int, b_size: int) -> np.dtype:
    """The numbers that pairs of ids are kept as: ``a * b_size + b``."""
    return np.dtype(np.uint32 if a_size * b_size < 1 << 32 else np.uint64)


def _sizes(a_path: str, b_path: str) -> tuple[int, int, int]:
    """Sizes of both vocabularies, and how many pairs can be linked at most.

    Of two tokens that end together one is a suffix of the other, and a token
    of ``n`` bytes has ``n`` suffixes. Every suffix is the content of few ids:
    in byte-fallback vocabularies of two at most, its own and the byte's.
    """
    a, b = byte_bpe(a_path)[1], sentence_pieces(b_path)[1]
    return len(a), len(b), 2 * (sum(map(len, a)) + sum(map(len, b)))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"


def aligned(docs: DataFrame, a: str, b: str, as_text: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` with both tokenizers' groups, a row a document.

    ``a`` is a tokenizers file with byte-level BPE, which encodes a space and
    the text, ``b`` a sentencepiece model, which encodes the text; strings of
    special tokens are plain text. ``groups`` lists the groups in order as
    ``a1,a2|b1;a3|b2,b3`` (or its SHA-256 unless ``as_text``); ``links`` has a
    number (see ``pair_type``) for each pair of occurrences that end together.

    A text without tokens has zeros and empty values: null and empty texts, and
    those that either tokenizer's ids don't spell out. Repeated rows are rows
    of their own; a null id stays null; an empty table gives an empty result.
    Other columns are not read. Whole texts are encoded, each in one task.
    """

    def run(batches):
        aligner = Aligner(a, b)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), *aligner.batch(part.column(1), as_text)], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, ALIGNED)


def _numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of ``links``, and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(flat.tobytes(), kind), np.diff(offsets) // kind.itemsize


def link_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``pair, a, b, n`` over the ``links`` of all rows of ``aligned``: how many links hold the pair.

    Every task adds up its own rows first and sends at most as many rows as
    pairs can be linked, which the vocabularies bound (``_sizes``).
    """
    a_size, b_size, _ = _sizes(a, b)
    kind = pair_type(a_size, b_size)

    def run(batches):
        keys, counts = np.empty(0, kind), np.empty(0, np.int64)
        for batch in batches:
            new, n = np.unique(_numbers(batch.column(0), kind)[0], return_counts=True)
            keys, back = np.unique(np.concatenate((keys, new)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, n)), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    sums = rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return sums.select("pair", F.floor(F.col("pair") / b_size).cast("int").alias("a"), (F.col("pair") % b_size).cast("int").alias("b"), "n")


def with_counts(rows: DataFrame, counts: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` of ``aligned`` with ``n_links``, ``n_best`` (links whose count is the highest of their B id, ties included) and ``count_sum``.

    The table of counts is sent to all tasks: its rows are bounded by the
    vocabularies, not by the corpus, and that bound is checked.
    """
    spark = rows.sparkSession
    a_size, b_size, bound = _sizes(a, b)
    kind = pair_type(a_size, b_size)
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    found = counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")).limit(bound + 1).toArrow()
    if found.num_rows > bound:
        raise ValueError(f"over {bound} pairs of ids are linked; these tokenizers don't spell out the texts")
    order = np.argsort(found["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((found["pair"].to_numpy()[order].astype(kind), found["n"].to_numpy()[order], found["best"].to_numpy()[order]))

    def run(batches):
        keys, ns, best = sent.value
        for batch in batches:
            pairs, sizes = _numbers(batch.column(batch.schema.get_field_index("links")), kind)
            at = np.searchsorted(keys, pairs)
            spans = np.concatenate(([0], np.cumsum(sizes)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(x[at], dtype=np.int64)))[spans]) for x in (best, ns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (sizes, *sums))], names=[*batch.schema.names, "n_links", "n_best", "count_sum"])

    return rows.mapInArrow(run, f"{ALIGNED}, n_links long, n_best long, count_sum long")


def alignment_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = materialize(aligned(table(spark, sf_dir, "documents"), a, b, as_text=False), "aligned")
    return with_counts(rows, materialize(link_counts(rows, a, b), "links"), a, b).withColumnRenamed("groups", "groups_sha256").drop("links")
