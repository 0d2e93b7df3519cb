"""Folders and small texts in any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """The file system of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._system = self._paths.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
        self._bytes = spark.sparkContext._jvm.java.io.ByteArrayOutputStream

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        path = self._paths.Path(folder)
        return [s.getPath().getName() for s in self._system.listStatus(path)] if self._system.exists(path) else []

    def exists(self, path: str) -> bool:
        return self._system.exists(self._paths.Path(path))

    def read(self, path: str) -> str:
        source, found = self._system.open(self._paths.Path(path)), self._bytes()
        self._io.copyBytes(source, found, 65536, True)
        return bytes(found.toByteArray()).decode()

    def write(self, path: str, text: str) -> None:
        """All of the text or nothing under this name: it is written under another one and renamed."""
        target, draft = self._paths.Path(path), self._paths.Path(f"{path}.draft")
        out = self._system.create(draft, True)
        out.write(text.encode())
        out.close()
        if not self._system.rename(draft, target):
            raise OSError(f"{path} cannot be written")

    def remove(self, path: str) -> None:
        self._system.delete(self._paths.Path(path), True)
