"""What the corpus operators share: table access, the shared scratch folder and Arrow text buffers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2500
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    if not (path := spark.conf.get("spark.checkpoint.dir", "")):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="terrapulse-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Rows that Python workers get at once: documents are kilobytes each, so Spark's default of 10,000 rows is held twice over in every task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """What this process has freed goes back to the system; allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """``run`` for mapInArrow, after whose last batch the worker forgets and gives back what it no longer needs.

    Spark keeps workers for later tasks, more of them than run at once. Each would hold its peak while the JVM sorts and shuffles, and both count as the executor's.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            give_back()

    return task


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends there and no executor's disk is needed again."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote."""
    for file in df.inputFiles()[:1]:
        remove(spark, file.rsplit("/", 1)[0])


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession, name: str, data: bytes) -> str:
    """Put ``data`` into the shared folder and have every executor fetch it once: the name that ``SparkFiles.get`` takes. Equal data is one file."""
    name = f"{name}-{xxhash.xxh128_hexdigest(data)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        for i in range(0, len(data), 1 << 22):
            out.write(bytearray(data[i : i + (1 << 22)]))
        out.close()
    spark.sparkContext.addFile(str(path.toUri()))
    return name


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids in the order of their hash, one row an id: small enough to broadcast.

    Null ids and null labels are left out; of repeated ids the largest label counts.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = one.groupBy(F.col(id_col).alias("_sample_id")).agg(F.max(label_col).alias("_label"))
    return one.orderBy(F.xxhash64("_sample_id"), "_sample_id").limit(limit)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if where is not None else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, most: int = 2 << 20) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each; a longer row is alone."""
    _, at = utf8(column)
    out, start = [], 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        out.append((start, stop))
        start = stop
    return out
