"""Files that tasks write themselves: stores by URI, and a commit by moving.

A Python data source's tasks write under ``_temporary``; the driver moves the
files that committed tasks name to their place, so retried and speculative
tasks leave nothing behind. Stores are those of pyarrow (local, HDFS, object stores).
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow.fs
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql.datasource import WriterCommitMessage


def store(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files under ``path`` whose name matches the regular
    expression ``ending``, sorted; hidden files and folders are left out. A
    path to one file is that file; a path to nothing raises an error."""
    fs, name = store(path)
    info = fs.get_file_info(name)
    if info.type == FileType.File:
        return [(path, info.size)]
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    out, root = [], name.rstrip("/")
    for x in fs.get_file_info(FileSelector(name, recursive=True)):
        own = x.path[len(root) + 1:]
        if x.type == FileType.File and not any(p[:1] in "._" for p in own.split("/")) and re.search(ending, own, re.I):
            out.append((f"{path.rstrip('/')}/{own}", x.size))
    return sorted(out)


@dataclass
class Written(WriterCommitMessage):
    """Names of a task's finished files."""
    files: list[str]


class Commit:
    """One write job's folder under ``_temporary`` and its commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def open(self, name: str):
        """A stream to a new file of this job (in a task)."""
        fs, root = store(self.path)
        fs.create_dir(f"{root}/_temporary/{self.run}", recursive=True)
        return fs.open_output_stream(f"{root}/_temporary/{self.run}/{name}", compression=None)

    def commit(self, messages) -> None:
        fs, root = store(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(FileSelector(root)):
                if x.type == FileType.File:
                    fs.delete_file(x.path)
        for message in messages:
            for file in message.files if message else ():
                fs.move(f"{root}/_temporary/{self.run}/{file}", f"{root}/{file}")
        self.abort()
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self) -> None:
        fs, root = store(self.path)
        if fs.get_file_info(f"{root}/_temporary/{self.run}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_temporary/{self.run}")
        if fs.get_file_info(f"{root}/_temporary").type == FileType.Directory and not fs.get_file_info(FileSelector(f"{root}/_temporary")):
            fs.delete_dir(f"{root}/_temporary")
