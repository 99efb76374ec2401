"""Files that executors write to, and read by ranges from, the shared folder."""

from __future__ import annotations

import uuid


def filesystem(uri: str):
    """(file system, path) of a URI or plain path, for any scheme that Arrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class Writer:
    """A file of its own for each task attempt; only a finished attempt's name reaches the manifest, so
    what a lost attempt has written is never read."""

    def __init__(self, folder: str, kind: str):
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        name = f"{kind}-{uuid.uuid4().hex}"
        self.uri, self.at = f"{folder}/{name}", 0
        self.out = system.open_output_stream(f"{path}/{name}")

    def write(self, data: bytes) -> tuple[int, int]:
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start, len(data)

    def close(self) -> None:
        self.out.close()


class Reader:
    """Range reads; the last opened file stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def open(self, uri: str):
        if uri != self.uri:
            self.close()
            system, path = filesystem(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file

    def read(self, uri: str, offset: int, length: int) -> bytes:
        return self.open(uri).read_at(length, offset)

    def ranges(self, uri: str, spans: list[tuple[int, int]], most: int = 8 << 20):
        """The bytes of each (offset, length); neighbouring spans share one read of up to `most` bytes."""
        k = 0
        while k < len(spans):
            start, end, j = spans[k][0], sum(spans[k]), k + 1
            while j < len(spans) and spans[j][0] == end and sum(spans[j]) - start <= most:
                end, j = sum(spans[j]), j + 1
            data = self.read(uri, start, end - start)
            for o, n in spans[k:j]:
                yield data[o - start : o - start + n]
            k = j

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.uri = self.file = None
