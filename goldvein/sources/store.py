"""Small files (catalogue rows, pointers, reports) on any store that Spark reads, through its own file systems.

Nothing is overwritten: a row or pointer is a new file under a name that sorts behind the ones before and that no
other writer draws; it is written aside and renamed, so readers see whole files only."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

CHUNK = 1 << 20


class Store:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str) -> list[str]:
        """The names in a folder, sorted; none if it isn't there."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def make_folder(self, folder: str) -> None:
        fs, p = self._at(folder)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, target: str) -> None:
        """Missing: FileNotFoundError."""
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        there, q = self._at(target)
        moved = fs.rename(p, q) if fs.getUri().equals(there.getUri()) else self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, there, q, True, self.conf)
        if not moved:
            raise OSError(f"can't move {path} to {target}")

    def chunks(self, path: str):
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            while part := bytes(stream.readNBytes(CHUNK)):
                yield part
        finally:
            stream.close()

    def read(self, path: str) -> str:
        return b"".join(self.chunks(path)).decode("utf-8")

    def write(self, path: str, text: str) -> None:
        """A new file; one of that name must not be there yet."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        aside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.part")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if not fs.rename(aside, p):
            raise OSError(f"can't write {path}")

    def append(self, folder: str, row: dict) -> None:
        self.write(f"{folder}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", json.dumps(row))

    def rows(self, folder: str) -> list[dict]:
        """The rows in the order of their writing."""
        return [json.loads(self.read(f"{folder}/{n}")) for n in self.names(folder) if n.endswith(".json")]
