"""File-system calls of the lake, through the Hadoop API so that any Spark path works."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class SharedFiles:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self._local = self._fs.getUri().getScheme() == "file"

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def make_dirs(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def is_file(self, path: str) -> bool:
        return self.exists(path) and self._fs.getFileStatus(self._path(path)).isFile()

    def children(self, path: str) -> list[tuple[str, int]]:
        """(name, modification time in ms) of the entries of a folder."""
        if not self.exists(path):
            return []
        return sorted(
            (s.getPath().getName(), s.getModificationTime())
            for s in self._fs.listStatus(self._path(path))
        )

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def create_exclusive(self, path: str, text: str) -> bool:
        """Publish a complete file under a name nobody has; False when somebody was first.

        Local disks use a hard link and HDFS a rename without overwrite, both atomic.
        """
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        try:
            if self._local:
                local = urlparse(path).path
                try:
                    os.link(urlparse(draft).path, local)
                except FileExistsError:
                    return False
                return True
            return self._rename(draft, path)
        finally:
            self.delete(draft)

    def _rename(self, source: str, target: str) -> bool:
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path(target).toUri(), self._conf
        )
        if self.exists(target):
            return False
        try:
            context.rename(self._path(source), self._path(target), self._gateway.new_array(options, 0))
        except Exception:
            if self.exists(target):
                return False
            raise
        return True
