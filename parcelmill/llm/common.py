"""Helpers shared by the training-data operators: session set-up, shared storage, hashing, text access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes in one Arrow batch: texts can be long, and a Python worker holds a few batches' worth of objects.
BATCH_BYTES = 1 << 20


def prepare(spark: SparkSession) -> None:
    """The session setting that the operators rely on: Arrow batches of bounded bytes.  Row counts stay as they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.

    Where it is unset, a session whose executors all run on this machine (local mode, as in tests) gets a temporary
    folder; on a cluster that is an error, as each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parcelmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet under the shared folder, and read it back.

    The files go when release() is given the table, and at the latest when the JVM ends; until then a lost executor
    costs a re-read, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidy_driver(spark)
    target, files = _files(spark, path)
    files.deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    _written[id(found)] = (weakref.ref(found), path)
    return found


def tidy_driver(spark: SparkSession) -> None:
    """Let a driver whose heap has grown past half of its bound collect, and give back what it has freed.

    Every small table that a join broadcasts takes some 8 MB of the driver's heap until a collection finds it dead, and
    Spark drops broadcasts only then: a chain of hundreds of joins grows the heap to its bound without need.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        runtime.gc()
        give_back()


def release(*tables: DataFrame) -> None:
    """Drop the files of materialised tables whose readers have all been written."""
    for table in tables:
        held, path = _written.pop(id(table), (None, None))
        if held is not None and held() is table:
            target, files = _files(table.sparkSession, path)
            files.delete(target, True)


_written: dict[int, tuple[weakref.ref, str]] = {}


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def give_back() -> None:
    """Return what this worker has freed to the system: allocators keep it otherwise, and idle workers add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its memory given back at the end of each task."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


_held: list[tuple[tuple, dict]] = []


def worker_cache(*owner) -> dict:
    """The dictionary that its owner keeps in this Python worker between tasks.  A worker holds one at a time, and gives
    the memory of the one before back to the system, so operators that follow each other in a session do not add up."""
    if not _held or _held[0][0] != owner:
        _held[:] = [(owner, {})]
        gc.collect()
        give_back()
    return _held[0][1]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def row_names(docs: DataFrame) -> tuple[DataFrame, str, str | None]:
    """docs with a name (long) for each different (doc_id, text), and a mark for rows whose doc_id others have too.

    A row that has its doc_id alone is named by it.  Rows that share one, or have none, are named by a hash of id and
    text.  The third result is None where there are no such rows.
    """
    name, mark, key = unused(docs, "row_name", "shared_id", "shared_key")
    ids = docs.groupBy(F.col("doc_id").cast("long").alias(key)).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    ids = materialise(ids.select(key, F.lit(True).alias(mark)), "shared-ids")
    own = F.col("doc_id").cast("long")
    if ids.isEmpty():
        release(ids)
        return docs.withColumn(name, own), name, None
    rows = docs.join(ids, own.eqNullSafe(F.col(key)), "left").drop(key)
    return rows.withColumn(name, F.when(F.col(mark), F.xxhash64("doc_id", "text")).otherwise(own)), name, mark


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def map_arrow(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(make, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column without nulls as a numpy array."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t if t is not None else "" for t in column(batch, name)]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
