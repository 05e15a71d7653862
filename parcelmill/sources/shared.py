"""Folders that the driver and all executors share, and files in them that are committed whole or not at all."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local session gets a temporary folder, and a cluster's is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parcelmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, label: str) -> str:
    """The name of a folder not there yet; it goes when the JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    Files(spark, path).forget_at_exit()
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to a new folder and read back: lineage ends here, and a lost executor costs a read."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The few file operations that a store needs, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def size(self, folder: str) -> int:
        return self._fs.getContentSummary(self._at(folder)).getLength()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def forget_at_exit(self) -> None:
        self._fs.deleteOnExit(self._at(""))

    def read_json(self, name: str):
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def commit_json(self, name: str, value) -> bool:
        """Write a file that is seen whole or not at all; False if there is one of this name already."""
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(draft), True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(self._at(draft)), context.makeQualified(self._at(name)), kinds)
        except Exception as e:
            self.delete(draft)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
