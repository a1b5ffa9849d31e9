"""Folders on whatever file system the cluster uses, through Spark's Hadoop client.

Only names and short control files are handled here; rows are read and written by Spark.
"""
from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """One folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def make(self) -> Folder:
        self._fs.mkdirs(self._path())
        return self

    def names(self, *names: str) -> list[str]:
        """Names in the folder (or one below it), sorted; none if it is missing."""
        path = self._path(*names)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def remove(self, *names: str) -> None:
        self._fs.delete(self._path(*names), True)

    def remove_all(self) -> None:
        """Remove the folder itself."""
        self.remove()

    def read(self, *names: str) -> str:
        stream = self._fs.open(self._path(*names))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, *names: str) -> None:
        """Write a file that appears whole or not at all: a hidden file, then a rename. Fails if the name is taken."""
        target, hidden = self._path(*names), self._path(*names[:-1], "." + names[-1])
        if self._fs.exists(target):
            raise FileExistsError(f"{target} is there already: another writer was first")
        out = self._fs.create(hidden, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._fs.rename(hidden, target):
            raise FileExistsError(f"{target} could not be published")
