"""Files of our own formats in the shared folder: temporary names, renames, and order of files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from brokerlens.session import scratch


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one all executors share, as a URI that executors open with ``pyarrow.fs``."""
    folder = scratch(spark, name)
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return folder


class Output:
    """A file written under a name of its own attempt and renamed when complete.

    A task that dies leaves a temporary file that no manifest lists; a repeated task replaces the same final name.
    """

    def __init__(self, folder: str, name: str):
        self.store, base = pafs.FileSystem.from_uri(folder)
        self.final = f"{base}/{name}"
        self.temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.store.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Where in the file the data begins."""
        at, self.size = self.size, self.size + len(data)
        self.stream.write(data)
        return at

    def commit(self) -> None:
        self.stream.close()
        self.store.move(self.temporary, self.final)


@contextmanager
def opened(folder: str, name: str) -> Iterator:
    store, base = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{name}") as file:
        yield file
