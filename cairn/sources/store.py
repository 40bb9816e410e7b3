"""Files of other tools' formats in any file system that a path names."""

from __future__ import annotations

import io

import numpy as np


def filesystem(uri: str):
    """The file system of ``uri`` and the path in it."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a file, with its folders, in place of what was there."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def npz(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def canonical(uri: str) -> str:
    """The URI that ``files`` gives for ``uri``."""
    return uri if "://" in uri else "file://" + uri.removeprefix("file:")


def files(uri: str, endings: tuple[str, ...], missing_ok: bool = False) -> list[tuple[str, int]]:
    """``(URI, size)`` of the files under ``uri`` with these endings, in order of names; folders that begin with ``_`` are passed over.

    A path that isn't there raises ``FileNotFoundError`` unless ``missing_ok``.
    """
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    kind = fs.get_file_info(path).type
    if kind == pafs.FileType.NotFound:
        if missing_ok:
            return []
        raise FileNotFoundError(f"no such path: {uri}")
    head = canonical(uri).rstrip("/")
    if kind == pafs.FileType.File:
        return [(head, fs.get_file_info(path).size)] if path.endswith(endings) else []
    root = path.rstrip("/")
    inside = ((f.path[len(root) :], f) for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)))
    found = [(head + rest, f.size) for rest, f in inside if f.type == pafs.FileType.File and rest.endswith(endings) and "/_" not in rest and "/." not in rest]
    return sorted(found)


def names(uri: str) -> list[str]:
    """What lies right under ``uri``, but for names that begin with ``_`` or ``.``; a path that isn't there raises ``FileNotFoundError``."""
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name[0] not in "_.")


def inside(uri: str, name: str) -> list[str]:
    """Paths below ``uri``, beginning with ``/``, of the files at or under its entry ``name``; hidden ones are passed over."""
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.File:
        return [f"/{name}"]
    paths = (f.path[len(path) :] for f in fs.get_file_info(pafs.FileSelector(f"{path}/{name}", recursive=True)) if f.type == pafs.FileType.File)
    return [p for p in paths if "/_" not in p and "/." not in p]


def reader(uri: str):
    """An open file that can seek."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def writer(uri: str):
    """An output stream to a new file, whose folders are made."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def move(source: str, target: str) -> None:
    """Rename a file, in place of what was there."""
    fs, a = filesystem(source)
    _, b = filesystem(target)
    fs.create_dir(b.rsplit("/", 1)[0], recursive=True)
    fs.move(a, b)


def delete(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.delete_file(path)


def delete_folder(uri: str) -> None:
    """Delete a folder, and the one above it if that is empty then; nothing happens if it isn't there."""
    from pyarrow import fs as pafs

    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)
    above = path.rsplit("/", 1)[0]
    if fs.get_file_info(above).type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(above)):
        fs.delete_dir(above)
