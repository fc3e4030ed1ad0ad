"""Folders of stored tables, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A streaming file sink leaves this log; readers then list only what it names.
COMMIT_LOG = "_spark_metadata"


class Folder:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path_of = jvm.org.apache.hadoop.fs.Path
        self.root = self._path_of(path)
        self.files = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.spark = spark
        self.path = path.rstrip("/")

    def _at(self, name: str):
        return self._path_of(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self.files.exists(self._at(name))

    def folders(self, name: str = "") -> list[str]:
        """Names of the folders in this one or in a folder of it."""
        at = self._at(name) if name else self.root
        if not self.files.exists(at):
            return []
        found = self.files.listStatus(at)
        return sorted(f.getPath().getName() for f in found if f.isDirectory())

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)

    def write_text(self, name: str, text: str) -> None:
        out = self.files.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def commit_text(self, name: str, text: str) -> None:
        """Write a new file that others see whole or not at all."""
        self.write_text(f"{name}.part", text)
        if not self.files.rename(self._at(f"{name}.part"), self._at(name)):
            raise OSError(f"{self.path}/{name} exists or can't be made")

    def names(self, name: str = "") -> list[str]:
        """Names of the files in this folder or in a folder of it."""
        at = self._at(name) if name else self.root
        if not self.files.exists(at):
            return []
        found = self.files.listStatus(at)
        return sorted(f.getPath().getName() for f in found if f.isFile())

    def read_text(self, name: str) -> str:
        jvm = self.spark.sparkContext._jvm
        source = self.files.open(self._at(name))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def refuse_commit_log(self) -> None:
        """Fail on a folder that a streaming file sink owns.

        Rows written there by anyone else would be invisible.
        """
        if self.exists(COMMIT_LOG):
            raise ValueError(
                f"{self.path} belongs to a streaming file sink: rows that others add to"
                " it are never read; copy its rows to another folder"
            )
