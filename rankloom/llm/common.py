"""Shared plumbing of the training-data operators: shared work folders and Arrow mapping."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handled at once inside a Python worker; Arrow batches from Spark are cut to this, a larger row comes alone.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Bytes of an Arrow batch between the JVM and a worker.
BATCH_BYTES = 8 << 20
#: Rows of a table of a few numbers that may be broadcast.
MOST_SENT = 1 << 21


def work_folder(spark: SparkSession) -> str:
    """The folder every executor can see: spark.checkpoint.dir; in local mode (tests) one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        base = f"file://{tempfile.gettempdir()}/rankloom-work"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage with a full copy that survives lost executors. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/rankloom-{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, for a broadcast if it has at most MOST_SENT rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, unless the session asks for others than Spark's default of 64 MB.

    A batch is held by the JVM and by the worker, for each task of an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Freed memory goes back to the system, as workers live on and serve other stages beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch within SLICE_ROWS and, but for single rows, SLICE_BYTES."""
    at = 0
    while at < batch.num_rows:
        rows = SLICE_ROWS
        while rows > 1 and batch.slice(at, rows).nbytes > SLICE_BYTES:
            rows //= 2
        yield batch.slice(at, rows)
        at += rows


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver notice that plans which have been written are gone, so that executors delete their shuffle files.

    Spark deletes them when the driver's collector finds their plans unreachable, which may be long after.
    """
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_slices(
    df: DataFrame, columns: list[str], schema: str, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | pa.Table] | pa.RecordBatch | None]
) -> DataFrame:
    """mapInArrow over only the named columns, in slices of bounded rows and bytes, so that memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch):
                    out = fn(part)
                    if out is not None and out.num_rows:
                        yield out
        finally:
            give_back()

    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def train_row(doc_id) -> "F.Column":
    """True where crc32(doc_id as text) mod 5 is not 0: the only rows whose labels may be learned."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def held_out(doc_ids: list[int | None]) -> list[bool | None]:
    return [None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in doc_ids]
