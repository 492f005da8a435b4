"""What the training-data operators share: scratch tables, files and small hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL: dict[str, str] = {}
_KEPT: dict = {}
_LIBC = ctypes.CDLL(None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: there, driver and
    executors are one process.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="cloakwork-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/cloakwork-{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    root = scratch_root(df.sparkSession)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root.removeprefix("file://") in folder and "/cloakwork-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Rows that cross to Python at once: bounds a worker's memory when texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def map_batches(df: DataFrame, function, schema: str | StructType, *args) -> DataFrame:
    """``mapInArrow`` with the function's extra arguments bound; batches stream one by one."""
    small_batches(df.sparkSession)
    return df.mapInArrow(functools.partial(_run, function, args), schema)


def _run(function, args, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A worker outlives its tasks: each gives back what it used, and finds nothing kept by another function's tasks."""
    if _KEPT.get("by") != (owner := f"{function.__module__}.{function.__qualname__}"):
        _KEPT.clear()
        give_back()
        _KEPT["by"] = owner
    try:
        yield from function(batches, *args)
    finally:
        give_back()


def kept(key: str, make):
    """``make(key)``, kept in the worker for the next tasks of the running function; one key at a time."""
    if _KEPT.get("key") != key:
        _KEPT.pop("value", None)
        _KEPT["value"], _KEPT["key"] = make(key), key
    return _KEPT["value"]


def give_back() -> None:
    """Return freed memory to the system: allocators keep it for a process that may next run something else."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers (xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as signed 64-bit integers in the same order."""
    bits = x.astype(np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by four counting passes of 16 bits each.

    Each pass brings at most 65,536 counts to the driver, whatever the number of rows.
    """
    if k < 1:
        return None
    rows, prefix = df.select(column).filter(F.col(column).isNotNull()), None
    for shift in (48, 32, 16, 0):
        digits = F.shiftright(F.col(column), shift)
        counts = rows if prefix is None else rows.filter(F.shiftright(F.col(column), shift + 16) == prefix)
        found = sorted(((r[0], r[1]) for r in counts.groupBy(digits.alias("d")).count().collect()), reverse=True)
        for digit, n in found:
            if k <= n:
                prefix = digit
                break
            k -= n
        else:
            return None
    return prefix
