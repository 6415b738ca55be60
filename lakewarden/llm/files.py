"""Files that executors write into the shared folder, through the store's own client."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI such as file:///x, hdfs://host/x or s3://bucket/x."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    if uri.startswith("s3a://"):  # Hadoop's name for the same store
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when it is complete.

    A lost or repeated attempt leaves no half-written file under a name that a
    manifest could list, as every attempt writes to a name of its own.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.uri = f"{folder.rstrip('/')}/{self.name}"
        self._fs, folder_path = open_store(folder)
        self._fs.create_dir(folder_path, recursive=True)
        self._path = f"{folder_path.rstrip('/')}/{self.name}"
        self._partial = f"{folder_path.rstrip('/')}/_{self.name}.partial"
        self.stream = self._fs.open_output_stream(self._partial, compression=None)

    def commit(self) -> str:
        self.stream.close()
        self._fs.move(self._partial, self._path)
        return self.uri


def open_input(uri: str):
    store, path = open_store(uri)
    return store.open_input_stream(path, compression=None)


class open_ranges:  # noqa: N801  used like open()
    """A file of the shared folder whose parts are read by offset and length."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self._file = store.open_input_file(path)

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def __enter__(self):
        return self

    def __exit__(self, *problem) -> None:
        self._file.close()
