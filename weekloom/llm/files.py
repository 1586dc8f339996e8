"""Files in the shared folder, by URI, from any executor."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyarrow import fs


@lru_cache(maxsize=64)
def _system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def create(folder: str, name: str):
    """A new file of its own name, so that a repeated task never meets an earlier attempt's file: (uri, stream)."""
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    unique = f"{uuid.uuid4().hex}-{name}"
    return f"{folder}/{unique}", system.open_output_stream(f"{path}/{unique}", compression=None)


def open_range(uri: str):
    """A file opened for reads at any offset."""
    folder, _, name = uri.rpartition("/")
    system, path = _system(folder)
    return system.open_input_file(f"{path}/{name}")


def listed(folder: str) -> list[str]:
    """URIs of the Parquet files of a folder; of none if there is no such folder."""
    system, path = _system(folder)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return []
    names = sorted(info.base_name for info in system.get_file_info(fs.FileSelector(path)) if info.is_file)
    return [f"{folder}/{name}" for name in names if name.endswith(".parquet") and name[0] not in "._"]
