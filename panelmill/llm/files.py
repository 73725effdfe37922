"""Files that tasks write and read themselves, in the shared folder of the session."""

from __future__ import annotations

import uuid

import pyarrow.fs as fs
from pyspark.sql import SparkSession

from ..session import checkpoint_folder


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, ...) or of a plain path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


class Attempt:
    """One output file: written under a name of this attempt, moved to its final name when complete.

    A retried or speculative task writes its own file and replaces the same final name with the same bytes.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = resolve(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{name}"
        self.uri = f"{folder}/{name}"
        self.temporary = f"{root}/_{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)
