"""Commits of files: tasks write into a staging folder, and a job that succeeds moves what its tasks reported."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import WriterCommitMessage

from cairn.sources import store

#: Folders of this name are no part of a result; readers pass over them.
STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """The files of one task attempt, relative to its folder."""

    folder: str
    names: list[str]


def new_staging(path: str) -> str:
    return f"{path.rstrip('/')}/{STAGING}/{uuid.uuid4().hex}"


def attempt(staging: str) -> str:
    """A folder for this attempt of a task alone, so that attempts side by side don't write the same file."""
    return f"{staging}/{uuid.uuid4().hex}"


def spans(rows: pa.Table, key: list[str]) -> list[tuple[int, int]]:
    """``(start, rows)`` of runs of rows that agree in ``key``."""
    if not rows.num_rows:
        return []
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in key:
        codes = rows[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), np.diff(np.append(starts, rows.num_rows)).tolist()))


def publish(path: str, staging: str, messages: list[Written | None], overwrite: bool) -> None:
    """Move the files of the attempts that count to ``path``; those of failed or doubled attempts go with the staging folder.

    With ``overwrite`` the files that were there before and aren't written anew are deleted after the move.
    """
    root = path.rstrip("/")
    old = {uri for uri, _ in store.files(root, ("",), missing_ok=True)} if overwrite else set()
    for m in messages:
        for name in m.names if m else ():
            store.move(f"{m.folder}/{name}", f"{root}/{name}")
            old.discard(store.canonical(f"{root}/{name}"))
    for uri in old:
        store.delete(uri)
    drop(staging)


def drop(staging: str) -> None:
    store.delete_folder(staging)
