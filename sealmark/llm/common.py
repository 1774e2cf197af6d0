"""Shared plumbing of the corpus operators: input columns, shared tables, batches.

Conventions that hold for every operator of this subpackage:

* a null text counts as an empty one unless the operator's docstring says otherwise;
* inputs may carry extra columns of any name, only the named ones are read;
* repeated rows stay repeated rows in the result;
* an empty input gives an empty result with the same columns.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _trim, _mallopt = ctypes.CDLL(None).malloc_trim, ctypes.CDLL(None).mallopt
except (AttributeError, OSError):  # another C library
    _trim = _mallopt = None

#: Bytes of text that one vectorised step looks at (a longer single text makes its own step).
STEP_BYTES = 1 << 19
#: Bytes of a batch between the JVM and a Python worker; a longer single row makes its own batch.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or an own one where all run in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sealmark-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, lost executors only reread.

    The files go away with the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Frees the shuffle files of steps that are over, which otherwise stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Removes the files of a table() that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(f)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than so many rows, by a distributed count (of a table's, its footers are enough)."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for a broadcast if it is proven to have no more than so many rows."""
    return F.broadcast(df) if small_enough(df, rows) else df


def bounded(f: Callable) -> Callable:
    """f(spark, ...) with Arrow batches of BATCH_BYTES at most, so that a Python worker holds little at a time."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return f(spark, *args)

    return run


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine; allocators keep it otherwise, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def hoard() -> None:
    """From now on this Python worker keeps up to 64 MB of freed memory until release(), for steps that free and get the same arrays again and again."""
    if _mallopt is not None:
        _mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        _mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, at its most


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with freed memory released after each batch and at the end."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            release()

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(fed(batches))
        release()

    return inner


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> pa.Array:
    """A string column without nulls, in one piece with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a large_string column that hold about `limit` bytes each."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)
