"""Token ids of whole texts, by way of units that no token crosses.

A space between two characters that are not white space begins a token in
every tokenizer used here: byte-level BPE splits there before it merges, and no
piece of the sentence model has its space mark behind another character. Texts
are cut at those spaces in one pass over their bytes, each distinct unit of a
slice is encoded once, and the ids of a text are those of its units in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that are white space, and pairs of bytes with which white space may end or begin; some of these are in other characters too.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_ENDS, _BEGINS = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
_ENDS[np.ix_((0xC2, 0x9A, 0x80, 0x81), range(0x80, 0xC0))] = True
_BEGINS[np.ix_((0xC2, 0xE1, 0xE2, 0xE3), (0x80, 0x81, 0x85, 0x9A, 0xA0))] = True


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_bpe(path: str):
    """``(encoding, bytes of each id, special strings)`` of a tokenizers file with byte-level BPE whose ids are in the order of merges.

    Merging is left to tiktoken, which is several times faster; ids are the same.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    special = {t["content"]: t["id"] for t in saved["added_tokens"]}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in saved["model"]["vocab"].items() if token not in special}
    size = max([*ranks.values(), *special.values()]) + 1
    content = [b""] * size
    for token, i in ranks.items():
        content[i] = token
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), content, special


@lru_cache(maxsize=4)
def sentence_pieces(path: str):
    """``(processor, bytes of each id)`` of a sentencepiece model: ``<0xHH>`` is a byte, U+2581 a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    content = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return model, content


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices ``flat[start:start + size]``, one after the other."""
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(flat)) < 1 << 31 else np.int64
    return flat[np.arange(n, dtype=kind) + np.repeat((starts - (ends - sizes)).astype(kind), sizes)]


def slices(batch: pa.RecordBatch, column: str, most_rows: int = 10_000, most_bytes: int = 8 << 20):
    """Parts of an Arrow batch of at most so many rows and bytes of text (or one longer text)."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, min(at + most_rows, int(np.searchsorted(ends, done + most_bytes, "right"))))
        yield batch.slice(at, to - at)
        at = to


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, with two more on either side, ends of the texts with a 0 before them)``."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(offsets[-1] - offsets[0] + 4, np.uint8)
    if len(data) > 4:
        data[2:-2] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def unpadded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, ends of the texts with a 0 before them)``."""
    data, offsets = _bytes(texts)
    return data[2:-2], offsets


def _blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether what ends before the byte ``at`` may be white space."""
    return _BLANK[data[at + 1]] | _ENDS[data[at], data[at + 1]]


def _blank_from(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether what begins with the byte ``at`` may be white space."""
    return _BLANK[data[at + 2]] | _BEGINS[data[at + 2], data[at + 3]]


def cut(texts: pa.Array, spaced: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(distinct units, number of each unit in order, how many each text has)``; nulls and empty texts have none.

    With ``spaced`` a space is put before each text.
    A space begins a unit if the characters beside it are surely not white
    space; where the bytes leave that open, the unit goes on, which is as right.
    """
    data, offsets = _bytes(pc.fill_null(texts, ""))
    if spaced:
        some = offsets[1:] > offsets[:-1]
        data = np.insert(data, 2 + offsets[:-1][some], 32)
        offsets = offsets + np.concatenate(([0], np.cumsum(some)))
    border = np.zeros(len(data), bool)
    border[offsets] = True
    at = np.flatnonzero(data[2:-2] == 32)
    at = at[~border[at] & ~border[at + 1]]
    at = at[~_blank_before(data, at) & ~_blank_from(data, at + 1)]
    starts = np.sort(np.concatenate((offsets[:-1][offsets[1:] > offsets[:-1]], at)), kind="stable")
    counts = np.diff(np.searchsorted(starts, offsets))
    ends = np.append(starts, offsets[-1]).astype(np.int32)
    units = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[2:])]).dictionary_encode()
    return units.dictionary, units.indices.to_numpy().astype(np.int64), counts


def encoded(units: pa.Array, encode: Callable[[str], list[int]], size_of: np.ndarray, alone: np.ndarray | None = None, one: Callable | None = None):
    """``(ids, start of each unit's, how many it has)`` of distinct units.

    Units from space to space are encoded many at a time and told apart by the
    bytes that their ids stand for (``size_of``). The others, and those that
    are to be ``alone``, are encoded by ``one``, each for itself.
    """
    data, offsets = _bytes(units)
    first, end = offsets[:-1], offsets[1:]
    joined = (data[first + 2] == 32) & (end > first + 1) & ~_blank_from(data, first + 1) & ~_blank_before(data, end)
    if alone is not None:
        joined &= ~alone
    at = np.flatnonzero(joined)
    text, ends = _bytes(units.filter(pa.array(joined)))
    parts, starts, sizes, done = [], np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), 0
    for lo, hi in pairwise(np.unique([*np.searchsorted(ends, np.arange(0, ends[-1], 1 << 13)), len(at)]).tolist()):
        ids = np.array(encode(text[2 + ends[lo] : 2 + ends[hi]].tobytes().decode()), np.uint32)
        upto = np.searchsorted(np.cumsum(size_of[ids]), ends[lo + 1 : hi + 1] - ends[lo]) + 1
        sizes[at[lo:hi]] = np.diff(upto, prepend=0)
        starts[at[lo:hi]] = done + upto - sizes[at[lo:hi]]
        parts.append(ids)
        done += len(ids)
    for i in np.flatnonzero(~joined):
        ids = np.array((one or encode)(units[int(i)].as_py()), np.uint32)
        starts[i], sizes[i] = done, len(ids)
        parts.append(ids)
        done += len(ids)
    return np.concatenate(parts) if parts else np.empty(0, np.uint32), starts, sizes


def containing(units: pa.Array, strings) -> np.ndarray:
    """Which units have one of ``strings`` in them."""
    found = np.zeros(len(units), bool)
    for s in strings:
        found |= pc.match_substring(units, s).to_numpy(zero_copy_only=False)
    return found


class Texts:
    """Ids of texts by a byte-level BPE file; strings of its special tokens count as those."""

    def __init__(self, path: str):
        self.encoding, content, self.special = byte_bpe(path)
        self.size_of = np.array([len(c) for c in content], np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, how many each text has)``; nulls and empty texts have none."""
        units, numbers, counts = cut(texts)
        flat, starts, sizes = encoded(
            units, self.encoding.encode_ordinary, self.size_of, containing(units, self.special), lambda u: self.encoding.encode(u, allowed_special="all")
        )
        of = sizes[numbers]
        ends = np.concatenate(([0], np.cumsum(of)))[np.concatenate(([0], np.cumsum(counts)))]
        return gather(flat, starts[numbers], of), np.diff(ends)
