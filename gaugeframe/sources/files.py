"""Files of any Hadoop file system as seekable Python streams, for looking at their first and last bytes on the driver."""

from __future__ import annotations

import io

from pyspark.sql import SparkSession


class HadoopFile(io.RawIOBase):
    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        self.size = fs.getFileStatus(p).getLen()
        self._in, self._at = fs.open(p), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (0, self._at, self.size)[whence]
        return self._at

    def tell(self) -> int:
        return self._at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), max(0, self.size - self._at))
        if n:
            self._in.seek(self._at)
            buffer[:n] = self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._in, n)
            self._at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._in.close()
        super().close()


def opened(spark: SparkSession, path: str) -> io.BufferedReader:
    return io.BufferedReader(HadoopFile(spark, path), 1 << 16)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, size) of the files directly in a directory, or of the file itself, by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.isFile())
