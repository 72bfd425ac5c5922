"""Small files of metadata on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: File systems in which a file appears when it is closed and creating one fails if it is there, but renaming copies.
STORES = ("s3a", "s3", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn")


class Files:
    """Text files under a base path, through Hadoop's file system of that path."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark._jvm
        self._none = spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)
        path = self._jvm.org.apache.hadoop.fs.Path(base)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.base = self._fs.makeQualified(path).toString().rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join([self.base, *parts])

    def _of(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._of(path))

    def mkdirs(self, path: str) -> None:
        self._fs.mkdirs(self._of(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._of(path)))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._of(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, replace: bool = False) -> bool:
        """Write a file that is whole as soon as it is there; False if it was there already. Of several writers of one
        path one succeeds: by a hard link on a local disk, by creating it in a store that has no renaming, and by
        renaming, which leaves an existing file alone, elsewhere."""
        target = self._of(path)
        if not replace and self._fs.exists(target):
            return False
        if self._fs.getScheme() in STORES:
            try:
                self._fill(target, text, replace)
            except Py4JJavaError as e:
                if "Exist" not in e.java_exception.getClass().getSimpleName():
                    raise
                return False
            return True
        temporary = self._of(f"{target.getParent().toString()}/.{uuid.uuid4().hex}")
        self._fill(temporary, text, True)
        if replace:
            self._fs.delete(target, False)
        if self._fs.getScheme() == "file":
            local = [self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self._none) for p in (target, temporary)]
            try:
                self._jvm.java.nio.file.Files.createLink(*local)
                done = True
            except Py4JJavaError as e:
                if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                    raise
                done = False
        else:
            done = self._fs.rename(temporary, target)
        if self._fs.exists(temporary):
            self._fs.delete(temporary, False)
        return done

    def _fill(self, path, text: str, overwrite: bool) -> None:
        stream = self._fs.create(path, overwrite)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._of(path), True)

    def directories(self, path: str) -> list[tuple[str, int]]:
        """Paths of the directories in ``path``, and when each was changed last, in milliseconds."""
        if not self.exists(path):
            return []
        return sorted((f"{path}/{s.getPath().getName()}", s.getModificationTime()) for s in self._fs.listStatus(self._of(path)) if s.isDirectory())

    def data_files(self, path: str) -> list[tuple[str, int]]:
        """Paths below ``path``, relative to it, and sizes of the Parquet files there. By listStatus: listFiles asks for
        each file's owner and blocks too, which on a local disk starts a process for each."""
        if not self.exists(path):
            return []
        found, below = [], [("", self._of(path))]
        while below:
            prefix, directory = below.pop()
            for status in self._fs.listStatus(directory):
                inner = status.getPath()
                name = prefix + inner.getName()
                if name.endswith(".parquet"):
                    found.append((name, status.getLen()))
                elif status.isDirectory():
                    below.append((f"{name}/", inner))
        return sorted(found)
