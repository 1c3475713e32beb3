"""Files by path or URI, local or in any store that the Arrow file systems reach."""

from __future__ import annotations

import atexit
import uuid
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession

from readloom.session import checkpoint_dir


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = path[5:]
        path = "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_input(path: str):
    f, p = _at(path)
    return f.open_input_file(p)


def open_output(path: str) -> BinaryIO:
    f, p = _at(path)
    if "/" in p:
        f.create_dir(p.rsplit("/", 1)[0], recursive=True)
    return f.open_output_stream(p, compression=None)  # not by the ending of the name


def read_bytes(path: str) -> bytes:
    with open_input(path) as f:
        return f.read()


def list_files(path: str) -> list[str]:
    """The file itself, or the files of a folder in name order (names that start with `_` or `.` left out)."""
    f, p = _at(path)
    info = f.get_file_info(p)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = sorted(x.path for x in f.get_file_info(fs.FileSelector(p)) if x.type == fs.FileType.File and x.base_name[0] not in "._")
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return [prefix + n if prefix and not n.startswith(prefix) else n for n in names]


def size_of(path: str) -> int:
    f, p = _at(path)
    return f.get_file_info(p).size


def move(path: str, target: str) -> None:
    """By name only where the store can."""
    f, p = _at(path)
    f.move(p, _at(target)[1])


def delete_file(path: str) -> None:
    f, p = _at(path)
    f.delete_file(p)


def delete_folder(path: str) -> None:
    f, p = _at(path)
    f.delete_dir(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the session; its folder is removed when the driver ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/readloom-{uuid.uuid4().hex}"
    atexit.register(_forget, folder)
    return f"{folder}/{name}"


def _forget(folder: str) -> None:
    try:
        delete_folder(folder)
    except OSError:
        pass
