"""Files of an index on any file system that Hadoop knows; small ones are read and written by the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path, local or with a scheme."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._hadoop, self._conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self.path(name)), "UTF-8")

    def write(self, name: str, text: str) -> None:
        """Replaces a file at once: a reader sees the old text or the new."""
        self._fs.mkdirs(self.path(""))
        out = self._fs.create(self.path(f"{name}.new"), True)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        self.swap(f"{name}.new", name)

    def swap(self, new: str, name: str) -> None:
        to = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        kind = getattr(self._hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        to.rename(self._fs.makeQualified(self.path(new)), self._fs.makeQualified(self.path(name)), how)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self.path(""))] if self.exists("") else []

    def measure(self, name: str) -> list[int]:
        """[files, bytes] below a name."""
        if not self.exists(name):
            return [0, 0]
        x = self._fs.getContentSummary(self.path(name))
        return [x.getFileCount(), x.getLength()]

    def rename(self, old: str, new: str) -> None:
        self._fs.rename(self.path(old), self.path(new))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self.path(name), True)
