"""Session helpers of the corpus operators: the shared folder, tables that cut
lineage, and packed rows for numpy-side shuffles."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_local_dir: list[str] = []
_made: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only on
    one machine, where that is unset, a temporary folder is made; a cluster needs it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="docmatch-"))
    return _local_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docmatch-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # the session is gone; the folder's owner cleans up
            return


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: later jobs, and
    retries after lost executors, start from the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[made] = path
    return made


def drop(*tables: DataFrame) -> None:
    """Deletes the files of results of ``table`` that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, _paths.pop(t))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Returns a Python worker's freed memory to the system. Workers are kept between
    tasks, so what one task needed at its peak would stay taken from the executor."""
    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def planes(a: np.ndarray) -> bytes:
    """An integer array as byte planes; planes of zeros vanish when Spark compresses."""
    if not len(a):
        return b""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def unplanes(b: bytes, n: int, dtype: str, width: int | None = None) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    out = np.zeros((n, size), np.uint8)
    kept = width or size
    if n:
        out[:, :kept] = np.frombuffer(b, np.uint8).reshape(kept, n).T
    return out.reshape(-1).view(dtype) if n else np.zeros(0, dtype)


def low_planes(a: np.ndarray, width: int) -> bytes:
    """Only the lowest ``width`` bytes of each (little-endian) item."""
    if not len(a):
        return b""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T[:width]).tobytes()


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins; the keys are sorted together."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(starts: np.ndarray, n: int) -> np.ndarray:
    """The group number of each of n items."""
    flag = np.zeros(n, np.int64)
    flag[starts] = 1
    return np.cumsum(flag) - 1
