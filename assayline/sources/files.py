"""Names and small texts in the file systems that Spark reads, by Spark's own configuration."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

#: The file that Spark writes last into a folder of part files.
MARKER = "_SUCCESS"
#: Small files that are looked at together.
AT_ONCE = 16
HEAD_BYTES = 1 << 16


class Files:
    """Lists, reads and publishes files. Only names and first lines pass through the driver, never data."""

    def __init__(self, spark: SparkSession):
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._settings = spark.sparkContext._jsc.hadoopConfiguration()
        self._codecs = hadoop.io.compress.CompressionCodecFactory(self._settings)

    def _at(self, path: str) -> tuple[JavaObject, JavaObject]:
        where = self._path(path)
        return where.getFileSystem(self._settings), where

    def exists(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where)

    def listed(self, folder: str) -> list[tuple[str, bool]]:
        """Name, and whether it is a folder, of all that lies in a folder, in the order of the names; none if there is no folder."""
        system, where = self._at(folder)
        if not system.exists(where):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in system.listStatus(where))

    def data_files(self, path: str) -> list[str]:
        """The data files at a path or pattern, or below it: names that begin with an underscore or a dot are not data."""
        system, where = self._at(path)
        statuses = [*(system.globStatus(where) or ())]
        if not statuses:
            raise FileNotFoundError(path)
        return [f for s in statuses for f in self._below(system, s)]

    def _below(self, system: JavaObject, status: JavaObject) -> list[str]:
        if not status.isDirectory():
            return [status.getPath().toString()]
        inside = sorted(system.listStatus(status.getPath()), key=lambda s: s.getPath().getName())
        return [f for s in inside if s.getPath().getName()[0] not in "_." for f in self._below(system, s)]

    def is_whole(self, path: str) -> bool:
        """Whether an export is complete: a single file is, since it appears by its name when it is; a folder has a marker."""
        system, where = self._at(path)
        return not system.getFileStatus(where).isDirectory() or self.exists(f"{path.rstrip('/')}/{MARKER}")

    def head(self, path: str, until: bytes = b"\n") -> bytes:
        """The beginning of a file, up to a mark at least, or all of it; unpacked if its name says that it is packed."""
        system, where = self._at(path)
        stream, codec = system.open(where), self._codecs.getCodec(where)
        if codec is not None:
            stream = codec.createInputStream(stream)
        try:
            held = bytes(stream.readNBytes(HEAD_BYTES))
            while until not in held and (more := bytes(stream.readNBytes(HEAD_BYTES))):
                held += more
            return held
        finally:
            stream.close()

    def heads(self, paths: Iterable[str]) -> list[bytes]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(self.head, paths))

    def text(self, path: str) -> str:
        return self.head(path, until=b"\0").decode()

    def _staged(self, path: str, text: str) -> str:
        staged = self.beside(path)
        system, where = self._at(staged)
        stream = system.create(where)
        stream.write(bytearray(text.encode()))
        stream.close()
        return staged

    def publish(self, path: str, text: str) -> None:
        """Writes a small file that is seen whole or not at all; a file of that name is replaced."""
        self.replace(self._staged(path, text), path)

    def publish_new(self, path: str, text: str) -> bool:
        """The same for a name that must be free; whether it was."""
        staged = self._staged(path, text)
        system, new = self._at(staged)
        _, where = self._at(path)
        if not system.exists(where) and system.rename(new, where):
            return True
        system.delete(new, False)
        return False

    def beside(self, path: str) -> str:
        """A new name next to a path, which readers of data leave alone."""
        folder, _, name = path.rstrip("/").rpartition("/")
        return f"{folder}/.{uuid.uuid4().hex}-{name}"

    def replace(self, staged: str, path: str) -> None:
        """Gives what is staged its name. What had the name before goes only when the new one has it."""
        system, new = self._at(staged)
        _, where = self._at(path)
        old = self._path(self.beside(path))
        had = system.exists(where) and system.rename(where, old)
        if not system.rename(new, where):
            if had:
                system.rename(old, where)
            raise OSError(f"{staged} could not be renamed to {path}")
        if had:
            system.delete(old, True)
