"""Small files on any file system that Spark reaches, for artifacts, their versions and logs.

Everything goes through Hadoop's file systems, so that a path on a cluster's store is that store and not a
folder of the driver. What is read and written here is small: names, lists, reports.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class SharedFile:
    """A file by its path or URI."""

    def __init__(self, spark: SparkSession, path):
        self.spark, context = spark, spark.sparkContext
        self.path = context._jvm.org.apache.hadoop.fs.Path(str(path))
        self.system = self.path.getFileSystem(context._jsc.hadoopConfiguration())

    @property
    def name(self) -> str:
        return self.path.getName()

    def exists(self) -> bool:
        return self.system.exists(self.path)

    def beside(self, name: str) -> SharedFile:
        """A file of another name in the same folder."""
        folder = self.path.getParent()
        return SharedFile(self.spark, f"{folder.toString().rstrip('/')}/{name}" if folder else name)

    def siblings(self) -> list[str]:
        """The names in the file's folder."""
        folder = self.path.getParent()
        if folder is None or not self.system.exists(folder):
            return []
        return sorted(x.getPath().getName() for x in self.system.listStatus(folder))

    def read(self) -> str:
        stream = self.system.open(self.path)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, text: str) -> None:
        """Replaces the file; its folder is made."""
        stream = self.system.create(self.path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def __str__(self) -> str:
        return self.path.toString()
