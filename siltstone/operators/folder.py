"""A folder in any store that Spark reaches: small files read and replaced whole, children listed and deleted."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Reads and writes through Hadoop's file systems, so a root may be a local path, hdfs://, s3a:// and so on."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, str(root).rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path().getFileSystem(self.conf)
        self.fs.setWriteChecksum(False)
        self.fs.setVerifyChecksum(False)

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(self.join(name))

    def join(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str | None:
        """The text of a file, None if there is none."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside the old one and put it in its place by one rename."""
        partial = f"{name}.{uuid.uuid4().hex}.partial"
        stream = self.fs.create(self._path(partial), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        options[0] = overwrite
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.conf)
        context.rename(context.makeQualified(self._path(partial)), context.makeQualified(self._path(name)), options)

    def children(self, name: str = "") -> list[str]:
        """Names of files and folders, sorted."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
