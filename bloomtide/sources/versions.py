"""Folders with versions: a new one is complete before anything points to it.

Below the folder lie ``versions/`` with one folder each, and ``commits/`` with one small
file for each finished version, numbered upwards, which names it. A version counts from
the moment its commit file is there, which is one write; nothing is renamed, so a reader
finds the version before or the one after, never none, on any file system. Of two
writers with the same number the second takes the next one.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Finished versions that stay in any case, and how long one stays that was replaced: readers of it can finish.
KEPT, GRACE_SECONDS = 2, 3600


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._bytes = spark._jvm.org.apache.commons.io.IOUtils

    def new(self) -> str:
        """An unused folder to write a version into."""
        return f"{self.path}/versions/{uuid.uuid4().hex}"

    def _commits(self) -> list[str]:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(n for n in names if n.isdigit())

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._bytes.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> bool:
        """A new small file; False if it is there already."""
        try:
            stream = self._fs.create(self._path(path), False)
        except Py4JJavaError as error:
            if "exist" in str(error).lower():
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def current(self) -> str | None:
        """The folder of the last finished version."""
        for name in reversed(self._commits()):
            version = self.read_text(f"{self.path}/commits/{name}")
            if version:  # an empty one is being written
                return f"{self.path}/versions/{version}"
        return None

    def commit(self, folder: str, grace: float = GRACE_SECONDS) -> None:
        """Let the folder be the current version, and drop those replaced more than ``grace`` seconds ago."""
        while True:
            commits = self._commits()
            number = int(commits[-1]) + 1 if commits else 1
            if self.write_text(f"{self.path}/commits/{number:012d}", folder.rsplit("/", 1)[1]):
                break
        commits = self._commits()
        for name, successor in zip(commits[:-KEPT], commits[1:]):
            version = self.read_text(f"{self.path}/commits/{name}")
            replaced = self._fs.getFileStatus(self._path(f"{self.path}/commits/{successor}")).getModificationTime() / 1000
            if version and time.time() - replaced >= grace:
                self.drop(f"{self.path}/versions/{version}")
                self.drop(f"{self.path}/commits/{name}")

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
