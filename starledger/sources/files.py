"""Files that tasks read in ranges or write whole, on any store that pyarrow opens."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    for scheme in ("s3a://", "s3n://"):
        if uri.startswith(scheme):
            uri = "s3://" + uri[len(scheme) :]
    return fs.FileSystem.from_uri(uri)


def visible_files(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder whose names don't begin with . or _, by path."""
    system, path = opened(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda p: any(part[0] in "._" for part in p[len(path) :].split("/") if part)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


def shares(files: list[tuple[str, int]], split: int) -> Iterator[list[tuple[str, int, int]]]:
    """Work of about ``split`` bytes a task: (path, share, shares of that file). Large files are shared out, small ones put together."""
    together: list[tuple[str, int, int]] = []
    size = 0
    for path, n in files:
        parts = max(1, -(-n // split))
        if parts > 1:
            yield from ([(path, i, parts)] for i in range(parts))
            continue
        if together and size + n > split:
            yield together
            together, size = [], 0
        together.append((path, 0, 1))
        size += n
    if together:
        yield together


class RangeFile:
    """A seekable file of a store for readers of archives: reads go out in blocks, so small ones don't each ask the store."""

    def __init__(self, system: fs.FileSystem, path: str, block: int = 1 << 16):
        self.file = system.open_input_file(path)
        self.length, self.at, self.block, self.start, self.held = self.file.size(), 0, block, 0, b""

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.length)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = max(0, self.length - self.at if n is None or n < 0 else min(n, self.length - self.at))
        if self.at < self.start or self.at + n > self.start + len(self.held):
            self.start = self.at
            self.held = self.file.read_at(min(max(n, self.block), self.length - self.at), self.at)
        out = self.held[self.at - self.start : self.at - self.start + n]
        self.at += len(out)
        return out

    def close(self) -> None:
        self.file.close()


def load(spark: SparkSession, source: type, path: str, schema: str | None = None, **options) -> DataFrame:
    """A table of one of this package's data sources; ``schema`` names the columns to read, the others aren't decoded."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load(path)
